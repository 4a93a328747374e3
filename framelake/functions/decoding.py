"""Beam decoding of label probabilities by frame; label 0 is blank."""

from __future__ import annotations

import re
from heapq import heappop, heappush

import numpy as np

from framelake.functions.plates import PROVINCES


def beams(probs: np.ndarray, width: int = 10, least: float = 0.25, separated: bool = False) -> list[tuple[tuple[int, ...], float]]:
    """``beams_of`` one matrix of probabilities (frames, labels)."""
    return beams_of(probs[None], width, least, separated)[0]


def beams_of(probs: np.ndarray, width: int = 10, least: float = 0.25, separated: bool = False) -> list[list[tuple[tuple[int, ...], float]]]:
    """Of each row of ``probs`` (rows, frames, labels), the label sequences and confidences of its ``width`` most probable paths, best first.

    A label like the last one of its sequence repeats it; with ``separated`` it begins a new one after a blank. Labels under
    ``least`` are passed over, and so is a blank where ``separated``. A confidence is the least probability of the labels
    that a path adds, or of all its steps where ``separated``. Equal paths go by the order of their beams and labels.

    All rows go forward together: a frame is one array of rows, beams and labels.
    """
    rows, frames, labels = probs.shape
    at = np.arange(rows)[:, None]
    text = np.zeros((rows, 1, frames), np.int32)
    size, tail, last = (np.zeros((rows, 1), np.int64) for _ in range(3))  # of a sequence: its length, its last label, the label of the last frame
    sure, total = np.ones((rows, 1)), np.zeros((rows, 1))
    for t in range(frames):
        p = probs[:, t]
        some = (p >= least) | (not separated and np.arange(labels) == 0)
        step = total[:, :, None] + np.where(some, np.log(np.maximum(p, 1e-8)), -np.inf)[:, None, :]
        step = step.reshape(rows, -1)
        best = np.argsort(-step, axis=1, kind="stable")[:, :width]
        beam, label = best // labels, best % labels
        total, size, tail, last, sure, text = np.take_along_axis(step, best, 1), size[at, beam], tail[at, beam], last[at, beam], sure[at, beam], text[at, beam]
        adds = (label > 0) & ~((tail == label) & ((last > 0) | (not separated)))
        own = p[at, label]
        sure = np.where(adds | separated, np.minimum(sure, own), sure)
        r, k = np.nonzero(adds)
        text[r, k, size[r, k]] = label[r, k]
        size, tail, last = size + adds, np.where(adds, label, tail), label
    real = np.isfinite(total)
    return [[(tuple(text[r, k, : size[r, k]].tolist()), float(sure[r, k])) for k in np.flatnonzero(real[r])] for r in range(rows)]


# Forms of the upper and lower line and what they count, and characters put in another's place, one at a time.
UPPER, LOWER = re.compile("([0-9]{2})[A-Z]{1,2}[0-9]?"), re.compile("[A-Z0-9]{4,6}")
FIXES = {"B": "8", "8": "B", "D": "0", "0": "D", "I": "1", "1": "I", "L": "1", "S": "5", "5": "S", "O": "0", "Q": "0"}


def upper_factor(text: str) -> float:
    form = UPPER.fullmatch(text)
    if form:
        return 1.2 if form[1] in PROVINCES else 0.9
    return 0.7 if len(text) >= 2 or not text else 0.5


def lower_factor(text: str) -> float:
    return 1.1 if LOWER.fullmatch(text) else 0.8 if text else 0.7


def mended(text: str) -> str:
    """The text with the first single replacement that makes a valid upper line; or as it is."""
    valid = lambda t: (form := UPPER.fullmatch(t)) is not None and form[1] in PROVINCES
    for k in [] if valid(text) else range(len(text)):
        other = text[:k] + FIXES.get(text[k], text[k]) + text[k + 1 :]
        if valid(other):
            return other
    return text


def joined(upper: list[tuple[str, float]], lower: list[tuple[str, float]], best: int = 3) -> list[tuple[str, str, float]]:
    """The ``best`` pairs of an upper and a lower line by the smaller of their confidences, each by its form. An upper line of
    poor form is mended once, which counts 0.95. Of equal pairs the one with the surer upper line comes first, then the lower.

    Both lists are ranked, and only the pairs next to one already taken are looked at, not all.
    """
    tops, lows = [], []
    for k, (text, sure) in enumerate(upper):
        factor, other = upper_factor(text), text
        if factor < 1 and upper_factor(new := mended(text)) > factor:
            factor, other = upper_factor(new) * 0.95, new
        tops.append((-sure * factor, k, other))
    for k, (text, sure) in enumerate(lower):
        lows.append((-sure * lower_factor(text), k, text))
    tops.sort()
    lows.sort()
    heap, out = [], []
    if tops and lows:
        heappush(heap, (max(tops[0][0], lows[0][0]), 0, 0))
    while heap and len(out) < best:
        less, a, b = heappop(heap)
        out.append((tops[a][2], lows[b][2], -less))
        if b + 1 < len(lows):
            heappush(heap, (max(tops[a][0], lows[b + 1][0]), a, b + 1))
        if b == 0 and a + 1 < len(tops):
            heappush(heap, (max(tops[a + 1][0], lows[0][0]), a + 1, 0))
    return out
