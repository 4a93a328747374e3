"""A constant-speed Kalman filter over boxes, and tracks that two rounds of matching carry from frame to frame.

The state is centre, aspect and height with their speeds. ``predict`` moves all tracks by the seconds that really went by;
noise grows with them. Deviations are shares of a box's height.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Deviation of a position and of a speed as a share of the height, and of the aspect and its speed.
PLACE, SPEED, ASPECT, ASPECT_SPEED, READ_ASPECT = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1
#: A squared distance over this (95 % of four degrees of freedom) is no match.
GATE = 9.4877


def measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, aspect and height of boxes (x1, y1, x2, y2)."""
    w, h = boxes[:, 2] - boxes[:, 0], np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    return np.stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, w / h, h], 1)


def boxed(x: np.ndarray) -> np.ndarray:
    w, h = x[:, 2] * x[:, 3], x[:, 3]
    return np.stack([x[:, 0] - w / 2, x[:, 1] - h / 2, x[:, 0] + w / 2, x[:, 1] + h / 2], 1)


def _spread(h: np.ndarray, place: float, aspect: float) -> np.ndarray:
    return np.stack([place * h, place * h, np.full(len(h), aspect), place * h], 1)


def begun(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of new tracks, at rest."""
    std = np.concatenate([_spread(z[:, 3], 2 * PLACE, ASPECT), _spread(z[:, 3], 10 * SPEED, ASPECT_SPEED)], 1)
    return np.concatenate([z, np.zeros_like(z)], 1), np.einsum("ni,ij->nij", std**2, np.eye(8))


def predict(mean: np.ndarray, cov: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """``dt`` in steps of the frame rate that the deviations are meant for."""
    move = np.eye(8)
    move[:4, 4:] = dt * np.eye(4)
    std = np.concatenate([_spread(mean[:, 3], PLACE, ASPECT), _spread(mean[:, 3], SPEED, ASPECT_SPEED)], 1)
    return mean @ move.T, move @ cov @ move.T + np.einsum("ni,ij->nij", std**2 * max(dt, 1e-9), np.eye(8))


def projected(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    std = _spread(mean[:, 3], PLACE, READ_ASPECT)
    return mean[:, :4], cov[:, :4, :4] + np.einsum("ni,ij->nij", std**2, np.eye(4))


def update(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, s = projected(mean, cov)
    gain = np.linalg.solve(s, cov[:, :4, :]).transpose(0, 2, 1)
    return mean + np.einsum("nij,nj->ni", gain, z - y), cov - gain @ s @ gain.transpose(0, 2, 1)


def distances(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Squared distances of tracks and measurements, in deviations."""
    y, s = projected(mean, cov)
    d = z[None, :, :] - y[:, None, :]
    return np.einsum("nki,nki->nk", d, np.linalg.solve(s, d.transpose(0, 2, 1)).transpose(0, 2, 1))


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.maximum(0, np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]))
    h = np.maximum(0, np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]))
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    joint = area(a)[:, None] + area(b)[None, :] - w * h
    return np.where(joint > 0, w * h / np.where(joint > 0, joint, 1), 0.0)


def assigned(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the least total cost, where a pair over ``most`` is worse than none; by shortest
    augmenting paths. The fewer side looks for the other's, where each has a place for being alone, at ``most``."""
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in assigned(cost.T, most))
    size = n + m
    full = np.full((n, size), most, float)
    full[:, :m] = np.where(cost <= most, cost, 1e6)
    u, v, of = np.zeros(n), np.zeros(size + 1), np.full(size + 1, -1)
    for i in range(n):
        of[size], least, way, used = i, np.full(size, np.inf), np.full(size, size), np.zeros(size + 1, bool)
        at = np.array([size])
        while True:  # columns that are equally near are gone through together
            used[at] = True
            rows, free = of[at], np.flatnonzero(~used[:size])
            c = full[np.ix_(rows, free)] - u[rows, None] - v[free]
            k = c.argmin(0)
            c = c[k, np.arange(len(free))]
            better = c < least[free]
            least[free[better]], way[free[better]] = c[better], at[k[better]]
            delta = least[free].min()
            u[of[used]] += delta
            v[used] -= delta
            least[free] -= delta
            at = free[least[free] <= 1e-12]
            if (of[at] < 0).any():
                at = int(at[of[at] < 0][0])
                break
        while at != size:
            of[at], at = of[way[at]], way[at]
    return sorted((int(of[j]), j) for j in range(m) if of[j] >= 0 and cost[of[j], j] <= most)


@dataclass
class Boxes:
    """One camera's tracks, by its frames that have boxes. Sure boxes are matched first with all tracks, by overlap and score,
    then unsure ones with the tracks left over that the frame before had; new tracks are confirmed by their second box, those of
    a first frame at once; lost ones end after ``lost`` seconds. After as long without boxes a camera begins anew."""

    rate: float = 12.0
    high: float = 0.5
    low: float = 0.1
    begin: float = 0.45
    match: float = 0.8
    lost: float = 2.5
    gate: float = GATE
    last: float | None = None
    made: int = 0
    ids: list[int] = field(default_factory=list)
    confirmed: list[bool] = field(default_factory=list)
    seen: list[float] = field(default_factory=list)
    live: list[bool] = field(default_factory=list)  # matched in the last frame
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))
    cov: np.ndarray = field(default_factory=lambda: np.zeros((0, 8, 8)))

    @property
    def quiet(self) -> float:
        return self.lost

    def frame(self, now: float, boxes: np.ndarray, scores: np.ndarray) -> list[int | None]:
        """The track of each box, or none for boxes that are too unsure or whose track is new and unconfirmed."""
        first = self.last is None or now - self.last > self.lost
        dt = 1 / self.rate if first else max(1e-3, now - self.last)
        self.last = now
        stay = [k for k, t in enumerate(self.seen) if now - t <= self.lost]
        self._keep(stay)
        if self.ids:
            self.mean[[not x for x in self.live], 7] = 0  # a lost one doesn't grow
            self.mean, self.cov = predict(self.mean, self.cov, dt * self.rate)
        z = measured(boxes)
        of: dict[int, int] = {}
        high, low = np.flatnonzero(scores >= self.high), np.flatnonzero((scores > self.low) & (scores < self.high))
        firm = [k for k, c in enumerate(self.confirmed) if c]
        self._match(firm, high, boxes, z, of, self.match, scores)
        self._match([k for k in firm if k not in of and self.live[k]], low, boxes, z, of, 0.5, None)
        taken = set(of.values())
        self._match([k for k, c in enumerate(self.confirmed) if not c], np.array([j for j in high if j not in taken], int), boxes, z, of, 0.7, scores)
        taken = set(of.values())
        gone = [k for k, c in enumerate(self.confirmed) if not c and k not in of]
        if of:
            k, j = (np.array(x) for x in zip(*of.items(), strict=True))
            self.mean[k], self.cov[k] = update(self.mean[k], self.cov[k], z[j])
        for k in range(len(self.ids)):
            self.live[k] = k in of
            if k in of:
                self.seen[k], self.confirmed[k] = now, True
        out: list[int | None] = [None] * len(boxes)
        for k, j in of.items():
            out[j] = self.ids[k]
        self._keep([k for k in range(len(self.ids)) if k not in gone])
        new = [j for j in high.tolist() if j not in taken and scores[j] >= self.begin]
        if new:
            mean, cov = begun(z[new])
            self.mean, self.cov = np.concatenate([self.mean, mean]), np.concatenate([self.cov, cov])
            for j in new:
                self.made += 1
                self.ids.append(self.made)
                self.confirmed.append(first)
                self.seen.append(now)
                self.live.append(True)
                out[j] = self.made if first else None
        return out

    def _keep(self, rows: list[int]) -> None:
        self.ids, self.confirmed, self.seen, self.live = ([x[k] for k in rows] for x in (self.ids, self.confirmed, self.seen, self.live))
        self.mean, self.cov = self.mean[rows], self.cov[rows]

    def _match(self, tracks: list[int], some: np.ndarray, boxes: np.ndarray, z: np.ndarray, of: dict[int, int], most: float, scores: np.ndarray | None) -> None:
        if not tracks or not len(some):
            return
        near = overlaps(boxed(self.mean[tracks]), boxes[some])
        cost = 1 - (near * scores[some] if scores is not None else near)
        far = distances(self.mean[tracks], self.cov[tracks], z[some]) > self.gate
        for a, b in assigned(np.where(far, np.inf, cost), most):
            of[tracks[a]] = int(some[b])
