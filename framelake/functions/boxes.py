"""Boxes of one frame or window as arrays: what survives of them, and which overlaps one most."""

from __future__ import annotations

import numpy as np


class Survivors:
    """Boxes kept so far, best first; one that overlaps a kept one by more than ``most``, or by as much where ``inclusive``, goes."""

    def __init__(self, most: float, inclusive: bool = False):
        self.most, self.inclusive, self.n, self.held = most, inclusive, 0, np.empty((5, 64))

    def keep(self, x1: float, y1: float, x2: float, y2: float) -> bool:
        a, area = self.held[:, : self.n], (x2 - x1) * (y2 - y1)
        both = np.maximum(np.minimum(a[2], x2) - np.maximum(a[0], x1), 0.0) * np.maximum(np.minimum(a[3], y2) - np.maximum(a[1], y1), 0.0)
        joint = a[4] + area - both
        over = np.divide(both, joint, out=np.zeros(self.n), where=joint > 0)
        if (over >= self.most if self.inclusive else over > self.most).any():
            return False
        if self.n == self.held.shape[1]:
            self.held = np.concatenate([self.held, np.empty_like(self.held)], 1)
        self.held[:, self.n] = x1, y1, x2, y2, area
        self.n += 1
        return True


class Overlapped:
    """Boxes (event_id, x1, y1, x2, y2) in order of their centres' heights; one meets those whose height in the picture it may share."""

    def __init__(self, rows: list[tuple]):
        box = np.array([r[1:] for r in rows], float).reshape(-1, 4)
        order = np.argsort(box[:, 1] + box[:, 3], kind="stable")
        self.ids, box = np.array([r[0] for r in rows], np.int64)[order], box[order]
        self.x1, self.y1, self.x2, self.y2 = (np.ascontiguousarray(c) for c in box.T)
        self.middle, self.area = (self.y1 + self.y2) / 2, (self.x2 - self.x1) * (self.y2 - self.y1)
        self.tall = float((self.y2 - self.y1).max(initial=0))

    def best(self, x1: float, y1: float, x2: float, y2: float, least: float, apart: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
        """ids and overlaps of those that come within ``apart`` of the greatest overlap, ``least`` or more."""
        far = (y2 - y1 + self.tall) / 2
        strip = slice(self.middle.searchsorted((y1 + y2) / 2 - far, "left"), self.middle.searchsorted((y1 + y2) / 2 + far, "right"))
        w = np.minimum(self.x2[strip], x2) - np.maximum(self.x1[strip], x1)
        at = np.flatnonzero(w > 0)
        p = at + strip.start
        both = w[at] * np.maximum(np.minimum(self.y2[p], y2) - np.maximum(self.y1[p], y1), 0.0)
        joint = (x2 - x1) * (y2 - y1) + self.area[p] - both
        over = np.divide(both, joint, out=np.zeros(len(p)), where=joint > 0)
        top = over >= max(least, over.max(initial=0) - apart)
        return self.ids[p[top]], over[top]
