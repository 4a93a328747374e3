"""Beam decoding against all paths."""

import itertools
import re
from math import log, prod

import numpy as np
from pyspark.sql import functions as F

from framelake.functions.decoding import beams, joined
from framelake.functions.plates import PROVINCES
from framelake.operators.decoding import FRAMES, LETTERS, probabilities
from framelake.queries import QUERIES

SF = "/root/testdata/sf0.001"


def all_paths(probs, least, separated):
    found = []
    for path in itertools.product(range(probs.shape[1]), repeat=len(probs)):
        steps = [probs[t][c] for t, c in enumerate(path)]
        if any(p < least and (c or separated) for p, c in zip(steps, path)):
            continue
        labels, sure, last = [], 1.0, 0
        for p, c in zip(steps, path):
            adds = c and not (labels and labels[-1] == c and (not separated or last))
            if adds:
                labels.append(c)
            if adds or separated:
                sure = min(sure, p)
            last = c
        found.append((prod(steps), tuple(labels), sure))
    return found


def test_all_paths():
    g = np.random.default_rng(1)
    for separated in (False, True):
        for _ in range(40):
            probs = g.dirichlet(np.ones(3), 5)
            paths = all_paths(probs, 0.1, separated)
            got = beams(probs, 10_000, 0.1, separated)
            assert sorted(got) == sorted((labels, sure) for _, labels, sure in paths)
            # each frame's choice is free, so a beam of one finds the most probable path
            if paths:
                best = max(paths)
                assert beams(probs, 1, 0.1, separated) == [best[1:]] and log(best[0]) < 0
    one = np.array([[0.1, 0.9], [0.9, 0.1], [0.1, 0.9]])
    assert beams(one, 1)[0][0] == (1,) and beams(one, 1, separated=True)[0][0] == (1, 1)
    assert beams(np.zeros((0, 2))) == [((), 1.0)]


def test_query(spark):
    rows = {r.event_id: np.array(r.probs) for r in probabilities(spark, SF).limit(20).collect()}
    got = {r.event_id: r for r in QUERIES["sf27_beam_decoded"](spark, SF).collect()}
    for i, probs in rows.items():
        assert probs.shape == (FRAMES, len(LETTERS) + 1) and np.allclose(probs.sum(1), 1)
        for separated, text, sure in ((False, got[i].text, got[i].confidence), (True, got[i].text_separated, got[i].confidence_separated)):
            paths = all_paths(probs, 0.25, separated)
            best = max(paths, default=(0, (), 0.0))
            assert ("".join(LETTERS[k - 1] for k in best[1]), best[2]) == (text, sure)
    assert len(got) > 500


def plain_pairs(upper, lower):
    """All pairs with their places by how sure each line is."""
    valid = lambda t: bool(re.fullmatch("[0-9]{2}[A-Z]{1,2}[0-9]?", t)) and t[:2] in PROVINCES

    def top(text):
        if re.fullmatch("[0-9]{2}[A-Z]{1,2}[0-9]?", text):
            return 1.2 if text[:2] in PROVINCES else 0.9
        return 0.5 if len(text) == 1 else 0.7

    tops, lows = [], []
    for text, sure in upper:
        score, use = top(text), text
        if score < 1.0 and not valid(text):
            fixes = dict(zip("B8D0I1LS5OQ", "8B0D1I15S00"))
            for k, c in enumerate(text):
                if c in fixes and valid(text[:k] + fixes[c] + text[k + 1 :]):
                    use = text[:k] + fixes[c] + text[k + 1 :]
                    score = top(use) * 0.95
                    break
        tops.append((use, sure * score))
    for text, sure in lower:
        lows.append((text, sure * (1.1 if re.fullmatch("[A-Z0-9]{4,6}", text) else 0.8 if text else 0.7)))
    tops.sort(key=lambda x: -x[1])
    lows.sort(key=lambda x: -x[1])
    return sorted([(a, b, min(x, y)) for a, x in tops for b, y in lows], key=lambda r: -r[2])


def test_pairs_of_two_heads(spark):
    from framelake.operators import decoding

    g = np.random.default_rng(2)
    for _ in range(200):
        upper = [("".join(g.choice(list("29158BDAQ"), int(g.integers(0, 5)))), float(g.integers(1, 6)) / 5) for _ in range(int(g.integers(0, 7)))]
        lower = [("".join(g.choice(list("01A"), int(g.integers(0, 8)))), float(g.integers(1, 6)) / 5) for _ in range(int(g.integers(0, 7)))]
        every = plain_pairs(upper, lower)
        for best in (1, 3, 100):
            assert [x[2] for x in joined(upper, lower, best)] == [x[2] for x in every[:best]]
        assert joined(upper, lower, 3) == every[:3] and sorted(joined(upper, lower, 100)) == sorted(every)
    assert joined([("8A8", 1.0)], [("1234", 0.9)])[0][:2] == ("8A8", "1234") and joined([("5OA", 1.0)], [("1234", 0.9)])[0][0] == "50A"
    rows = {r.event_id: r for r in decoding.heads(spark, SF).limit(40).collect()}
    got = {}
    for r in QUERIES["sf28_two_heads"](spark, SF).where(F.col("event_id").isin(list(rows))).collect():
        got.setdefault(r.event_id, []).append((r.place, r.upper, r.lower, r.confidence))
    for i, r in rows.items():
        lines = []
        for probs, letters in ((np.array(r.upper), decoding.UPPER_LETTERS), (np.array(r.lower), decoding.LOWER_LETTERS)):
            paths = sorted(all_paths(probs, 0.25, False), key=lambda x: -x[0])[:10]
            lines.append([("".join(letters[k - 1] for k in labels), sure) for _, labels, sure in paths])
        assert sorted(got.get(i, [])) == [(n, *x) for n, x in enumerate(plain_pairs(*lines)[:3], 1)]
    assert len(got) > 10
