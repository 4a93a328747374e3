"""Which persons of one camera and window may sit on or in a vehicle, without trying each with each."""

from __future__ import annotations

import numpy as np

#: Boxes that share over 0.3 have centres no farther apart than 1.17 heights of either.
REACH = 1.2


class People:
    """Persons (event_id, track, x1, y1, x2, y2) in order of their centres' heights, so that a vehicle meets a strip of them only.

    On a motorcycle the overlap counts, above 0.3; else the person's centre must lie over the vehicle, and higher is better.
    """

    def __init__(self, rows: list[tuple]):
        box = np.array([r[2:] for r in rows], float).reshape(-1, 4)
        order = np.argsort((box[:, 1] + box[:, 3]) / 2, kind="stable")
        self._hold(np.array([r[0] for r in rows], np.int64)[order], np.array([r[1] for r in rows], np.int64)[order], box[order])

    def _hold(self, ids: np.ndarray, tracks: np.ndarray, box: np.ndarray) -> None:
        self.ids, self.tracks, self.box, self.free, self.left = ids, tracks, box, np.ones(len(ids), bool), len(ids)
        self.x1, self.y1, self.x2, self.y2 = (np.ascontiguousarray(c) for c in box.T)
        self.cx, self.cy = (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2
        self.area = (self.x2 - self.x1) * (self.y2 - self.y1)

    def near(self, x1: float, y1: float, x2: float, y2: float, motorcycle: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the free persons with a score above 0, and their scores."""
        h = y2 - y1
        low, high = ((y1 + y2) / 2 - REACH * h, (y1 + y2) / 2 + REACH * h) if motorcycle else (y1 - 0.15 * h, y1 + 0.3 * h)
        strip = slice(self.cy.searchsorted(low, "left"), self.cy.searchsorted(high, "right"))
        if motorcycle:
            w = np.maximum(np.minimum(x2, self.x2[strip]) - np.maximum(x1, self.x1[strip]), 0.0)
            both = w * np.maximum(np.minimum(y2, self.y2[strip]) - np.maximum(y1, self.y1[strip]), 0.0)
            joint = (x2 - x1) * h + self.area[strip] - both
            # the joint area is above 0 wherever both share something
            k = np.flatnonzero((both > 0.29 * joint) & (joint > 0) & self.free[strip])
            score = both[k] / joint[k]
            fits = score > 0.3
        else:
            k = np.flatnonzero((self.cx[strip] >= x1) & (self.cx[strip] <= x2) & self.free[strip])
            score = 1 - (self.cy[strip][k] - y1) / (0.3 * h + 1e-9)
            fits = score > 0
        return k[fits] + strip.start, score[fits]

    def take(self, x1: float, y1: float, x2: float, y2: float, motorcycle: bool) -> tuple[int, float] | None:
        """The best free person, the smaller id of equals, who with all others of that track is free no longer."""
        at, score = self.near(x1, y1, x2, y2, motorcycle) if self.left else ((), ())
        if not len(at):
            return None
        best = score.max()
        k = min(at[score == best], key=lambda p: self.ids[p])
        found = int(self.ids[k]), float(best)
        self.free[k] = False
        if self.tracks[k] >= 0:
            self.free[self.tracks == self.tracks[k]] = False
        self.left = int(self.free.sum())
        if self.left * 2 < len(self.ids):
            self._hold(self.ids[self.free], self.tracks[self.free], self.box[self.free])
        return found
