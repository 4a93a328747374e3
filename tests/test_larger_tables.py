"""Small cases of what only larger tables showed."""

import itertools
import random
import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.boxes import Overlapped, Survivors
from framelake.functions.fusion import People
from framelake.functions.kalman import assigned
from framelake.functions.stateful import greedy, overlap
from framelake.operators.arbitration import Arbiter
from framelake.operators.correction import corrected, wn10_forgiven
from framelake.operators.joins import around, fusion_candidates, matched
from framelake.operators.limits import Limiter
from framelake.operators.pixels import greys, inked, otsu
from framelake.operators.quality import ag25_context
from framelake.queries import ORACLE_SQL, QUERIES
from framelake.sources.tables import detections

SF = "/root/testdata/sf0.001"


def test_context_cut_after_a_line_break(spark):
    whole = {(r.camera_id, r.slot): r.context for r in ag25_context(spark, SF, 10**9).collect()}
    most = min(len(t.split("\n")[0]) for t in whole.values() if "\n" in t) + 1
    got = {(r.camera_id, r.slot): r.context for r in ag25_context(spark, SF, most).collect()}
    assert got == {k: t[:most] for k, t in whole.items()} and any(t.endswith("\n") for t in got.values())


def test_second_cut_after_a_first_one_that_fits(spark):
    d = spark.createDataFrame([("13IE20663", 0.999), ("13IE20663", 0.5)], "raw string, confidence double")
    assert [r.plate for r in corrected(d).collect()] == ["11E20663"] * 2


def test_forgiven_readings_have_the_second_cut(spark, tmp_path):
    e = spark.createDataFrame([(148297, datetime(2024, 1, 15), 1177, "error", 500.0, "{}")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in wn10_forgiven(spark, str(tmp_path)).collect()] == [(148297, "11E20663", True)]


@pytest.mark.parametrize("name", ["wn10_forgiven", "sf21_sf22_lengthened"])
def test_readings_without_a_time_come_last_in_their_track(spark, tmp_path, name):
    rng, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(k, None if k % 9 == 0 else start + timedelta(seconds=rng.randrange(3000)), rng.randrange(60), "click", rng.random() * 560, "{}") for k in range(6000)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    e.write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(db.execute(ORACLE_SQL[name]).fetchall())


def test_people_of_a_crowded_window_by_a_plain_loop():
    rng = random.Random(3)
    box = lambda: (x := float(rng.randrange(1600)), y := float(rng.randrange(800)), x + rng.randrange(40, 320), y + rng.randrange(40, 280))
    rows = [(k, rng.choice([-1, k % 150]), *box()) for k in range(400)]
    cars = [(*box(), rng.random() < 0.3) for _ in range(600)]

    def score(v, p):
        (x1, y1, x2, y2, bike), (px1, py1, px2, py2) = v, p[2:]
        if bike:
            s = overlap(v[:4], p[2:])
            return s if s > 0.3 else 0
        cx, cy, h = (px1 + px2) / 2, (py1 + py2) / 2, y2 - y1
        return 1 - (cy - y1) / (0.3 * h + 1e-9) if x1 <= cx <= x2 and y1 - 0.15 * h <= cy <= y1 + 0.3 * h else 0

    people, left = People(rows), list(rows)
    for v in cars:
        at, got = People(rows).near(*v)
        assert {int(k): float(s) for k, s in zip(People(rows).ids[at], got, strict=True)} == {p[0]: s for p in rows if (s := score(v, p)) > 0}
        best = max(((s, -p[0]) for p in left if (s := score(v, p)) > 0), default=None)
        assert people.take(*v) == (best and (-best[1], best[0]))
        if best:
            track = rows[-best[1]][1]
            left = [p for p in left if p[0] != -best[1] and (track < 0 or p[1] != track)]


def test_fusion_meets_no_vehicle_with_all_persons_of_its_window(spark):
    d = detections(spark, SF)
    for got in (fusion_candidates(d), matched(d)):
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_frames_around_by_a_plain_loop(spark):
    rng = random.Random(5)
    events = [(k, f"c{k % 3}", rng.randrange(-3000, 6000)) for k in range(300)] + [(900, None, 5), (901, "c0", None)]
    frames = [(1000 + k, f"c{k % 2}", rng.randrange(-300, 600) * 10) for k in range(120)] + [(2000, None, 5), (2001, "c0", None)]
    got = around(spark.createDataFrame(events, "event_id long, camera_id string, sec long"), spark.createDataFrame(frames, "frame_id long, camera_id string, frame_sec long"), 60, 200)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for e, camera, sec in events:
        own = [(f, at) for f, c, at in frames if camera and c == camera and sec is not None and at is not None]
        near = min(((abs(sec - at), f) for f, at in own if abs(sec - at) <= 60), default=(None, None))
        want[e] = (near[1], near[0], max(((at, f) for f, at in own if 0 <= sec - at <= 200), default=(None, None))[1])
    assert {r.event_id: (r.near, r.gap, r.newest) for r in got.collect()} == want


def test_survivors_and_best_overlaps_by_plain_loops():
    rng = random.Random(7)
    box = lambda: (x := float(rng.randrange(400)), y := float(rng.randrange(300)), x + rng.randrange(40, 320), y + rng.randrange(40, 280))
    boxes = [box() for _ in range(300)]
    for inclusive in (False, True):
        state, held = Survivors(0.45, inclusive), []
        for b in boxes:
            stays = not any(overlap(b, a) >= 0.45 if inclusive else overlap(b, a) > 0.45 for a in held)
            held += [b] * stays
            assert state.keep(*b) == stays
    others = Overlapped([(k, *b) for k, b in enumerate(boxes[:200])])
    for b in boxes[200:]:
        every = {k: overlap(a, b) for k, a in enumerate(boxes[:200])}
        ids, got = others.best(*b, 0.1)
        assert dict(zip(ids.tolist(), got.tolist(), strict=True)) == {k: s for k, s in every.items() if s >= max(0.1, max(every.values()) - 1e-8)}


def test_limiter_from_one_call_that_passes_to_the_next():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randrange(1, 200)
        secs, cameras = np.array(sorted(rng.randrange(400) for _ in range(n))), np.array([f"c{rng.randrange(5)}" for _ in range(n)])
        a, b, cut = Limiter(50, 4, 13), Limiter(50, 4, 13), rng.randrange(n + 1)
        want = [k for k in range(n) if a.step(int(secs[k]), str(cameras[k]))]
        assert b.passing(secs[:cut], cameras[:cut]) + [cut + k for k in b.passing(secs[cut:], cameras[cut:])] == want
        assert a.left(400) == b.left(400)


def test_thresholds_of_many_crops_are_those_of_each(spark):
    d = greys(spark, SF).limit(60).unionByName(spark.createDataFrame([(-1, [[7] * 12] * 24)], "event_id long, grey array<array<int>>"))
    want = {r.event_id: (r.t, [sum(v <= r.t for v in row) for row in r.grey]) for r in d.select("event_id", "grey", otsu(F.flatten(F.col("grey").cast("array<array<long>>"))).alias("t")).collect()}
    assert {r.event_id: (r.threshold, r.ink) for r in inked(d).collect()} == want


def test_a_choice_does_not_count_the_whole_window_again():
    rng, now, start = random.Random(2), 0, time.process_time()
    rule, history = Arbiter(40, 60), []
    step = lambda rule, now, plates: rule.step(SimpleNamespace(sec=now, candidates=[{"source": "s", "text": p, "plain": p, "confidence": 0.5, "boost": 0.0} for p in plates]))
    for _ in range(3000):
        now += rng.choice([0, 1, 3, 39, 41, 61]) if rng.random() < 0.3 else 0
        plates = rng.sample("ABCDEF", 2)
        if history and now - history[-1][0] > 60:
            history = []
        past = [p for _, p in history]
        leader = max(past, key=past.count, default=None)
        best = plates[1] if leader == plates[1] else plates[0]
        assert step(rule, now, plates)[3] == round(0.3 + (0.15 * past.count(best) / len(past) if leader == best else 0), 9)
        history = [h for h in [*history, (now, best)] if h[0] > now - 40]
    rule = Arbiter(86400, 172800)
    for k in range(60000):
        step(rule, k, [f"P{k % 900}"])
    assert time.process_time() - start < 30


def test_full_frames_do_not_meet_all_tracks():
    rng = random.Random(4)
    box = lambda i: (i * 37 % 1600, i * 53 % 800, i * 37 % 1600 + 40 + i * 17 % 280, i * 53 % 800 + 40 + i * 29 % 240)
    for n, m in ((40, 30), (300, 200)):
        tracks, boxes = {f"t{k}": box(rng.randrange(3000)) for k in range(n)}, [box(rng.randrange(3000)) for _ in range(m)]
        scores = [rng.randrange(5) / 10 for _ in boxes]
        for least in (0.01, 0.2, 0.45):
            want: dict = {}
            for *_, k, t in sorted((-s, -scores[k], b, k, j) for j, b in enumerate(tracks.values()) for k, c in enumerate(boxes) if (s := overlap(b, c)) >= least):
                if k not in want and f"t{t}" not in want.values():
                    want[k] = f"t{t}"
            assert greedy(tracks, boxes, scores, least) == want
    start = time.process_time()
    assert len(greedy({k: box(rng.randrange(10**6)) for k in range(8000)}, [box(rng.randrange(10**6)) for _ in range(3000)], [0.5] * 3000, 0.2)) > 2900
    assert time.process_time() - start < 8


def test_least_cost_by_all_ways_and_of_many_equal_boxes():
    g = np.random.default_rng(1)
    total = lambda c, pairs: sum(c[i, j] - 0.7 for i, j in pairs)
    for _ in range(200):
        c = np.where(g.random((n := int(g.integers(1, 5)), m := int(g.integers(1, 5)))) < 0.3, np.inf, g.integers(0, 10, (n, m)) / 10)
        ways = [[(i, j) for i, j in enumerate(p) if j < m and c[i, j] <= 0.7] for p in itertools.permutations(range(m + n), n)]
        assert abs(total(c, assigned(c, 0.7)) - min(total(c, w) for w in ways)) < 1e-9
    start = time.process_time()
    c = np.repeat(np.repeat(g.random((60, 60)), 8, 0), 5, 1)
    assert len(assigned(c, 0.9)) == 300 and time.process_time() - start < 10
