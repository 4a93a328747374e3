"""Rules over a key's ordered events whose outcome depends on earlier outcomes, as steps of plain Python state.

Each rule is a class: ``step(event)`` takes the next event of its key, in order of time and id, and says whether it passes.
A rule forgets everything in ``quiet`` seconds, so that a key's events may be cut wherever a longer gap lies between two.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from math import exp

import numpy as np

# Pairs that are looked at without a search, and the overlaps down to which more are settled at a time.
FEW, BANDS = 4096, (0.98, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance, or most+1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


@dataclass
class Cooldown:
    """Passes ``quiet`` seconds or more after the last that passed, or after the last of all where ``refresh``."""

    quiet: float
    refresh: bool = False
    last: float | None = None

    def step(self, e) -> bool:
        passes = self.last is None or e.sec - self.last >= self.quiet
        if passes or self.refresh:
            self.last = e.sec
        return passes


@dataclass
class Spot:
    """Repeats of one camera and plate: those at the same spot within ``parked`` seconds don't pass and restart the clock;
    others within ``ttl`` pass only if they have moved by more than ``moved`` pixels."""

    ttl: float
    parked: float
    still: float = 140
    moved: float = 200
    last: tuple[float, float, float] | None = None

    @property
    def quiet(self) -> float:
        return max(self.ttl, self.parked)

    def step(self, e) -> bool:
        now, x, y = e.sec, int((e.x1 + e.x2) / 2), int((e.y1 + e.y2) / 2)
        passes, refresh = True, True
        if self.last:
            gap, far = now - self.last[0], ((x - self.last[1]) ** 2 + (y - self.last[2]) ** 2) ** 0.5
            if far <= self.still and gap < self.parked:
                passes = False
            elif gap < self.ttl:
                passes = refresh = far > self.moved
        if refresh:
            self.last = now, x, y
        return passes


def letters(plate: str) -> str:
    return plate.replace("-", "").replace(".", "").replace(" ", "").upper()


@dataclass
class Jitter:
    """Repeats of plates that share a camera and their first three characters, up to one edit apart.

    With ``by_track`` an equal reading of the same track within ``ttl`` doesn't pass and leaves the clock; else, and for
    readings of six characters or more, the earliest remembered one within an edit restarts its clock: by when it was first
    read, or, without ``by_track``, by its clock and text.

    Readings are found by what is left of them without a character, which texts an edit apart share; what expires is at the head of a queue.
    """

    ttl: float
    by_track: bool = True
    seen: dict[tuple, list] = field(default_factory=dict)  # clock and number of a reading
    near: dict[str, dict[tuple, None]] = field(default_factory=dict)
    queue: deque = field(default_factory=deque)
    made: int = 0

    @property
    def quiet(self) -> float:
        return self.ttl

    @staticmethod
    def _parts(text: str) -> set[str]:
        return {text, *(text[:k] + text[k + 1 :] for k in range(len(text)))}

    def _expire(self, now: float) -> None:
        over = (lambda t: now - t > self.ttl) if self.by_track else (lambda t: now - t >= self.ttl)
        while self.queue and over(self.queue[0][0]):
            at, key = self.queue.popleft()
            if key in self.seen and self.seen[key][0] == at:  # its clock has not been restarted
                del self.seen[key]
                for part in self._parts(letters(key[-1])):
                    own = self.near[part]
                    del own[key]
                    if not own:
                        del self.near[part]

    def _mark(self, key: tuple, now: float) -> None:
        if key in self.seen:
            self.seen[key][0] = now
        else:
            self.made += 1
            self.seen[key] = [now, self.made]
            for part in self._parts(letters(key[-1])):
                self.near.setdefault(part, {})[key] = None
        self.queue.append((now, key))

    def step(self, e) -> bool:
        now, own = e.sec, letters(e.plate)
        self._expire(now)
        key = (e.track_id, e.plate) if self.by_track else (e.plate,)
        if self.by_track and key in self.seen and now - self.seen[key][0] < self.ttl:
            return False
        if len(own) >= 6:
            some = {k for part in self._parts(own) for k in self.near.get(part, ())}
            alike = [k for k in some if now - self.seen[k][0] < self.ttl and len(o := letters(k[-1])) >= 6 and own[:3] == o[:3] and edits(own, o, 1) <= 1]
            if alike:
                self._mark(min(alike, key=(lambda k: self.seen[k][1]) if self.by_track else (lambda k: (self.seen[k][0], k))), now)
                return False
        self._mark(key, now)
        return True


@dataclass
class Votes:
    """One camera, track and plate: passes once in ``ttl``, when sure enough or seen ``votes`` times within ``ttl``."""

    ttl: float
    instant: float = 0.85
    votes: int = 2
    times: list[float] = field(default_factory=list)
    passed: float | None = None

    @property
    def quiet(self) -> float:
        return self.ttl

    def step(self, e) -> bool:
        self.times = [t for t in self.times if e.sec - t <= self.ttl] + [e.sec]
        if self.passed is not None and e.sec - self.passed < self.ttl:
            return False
        if e.confidence >= self.instant or len(self.times) >= self.votes:
            self.passed = e.sec
            return True
        return False


@dataclass
class Still:
    """One camera's track: passes while it moves by more than ``moved`` pixels or has stood for less than ``frames`` events;
    after that once in ``every`` seconds."""

    idle: float
    moved: float = 45
    frames: int = 24
    every: float = 10
    last: tuple[float, float] | None = None
    stood: int = 0
    passed: float = 0

    @property
    def quiet(self) -> float:
        return self.idle

    def step(self, e) -> bool:
        here = (e.x1 + e.x2) / 2, (e.y1 + e.y2) / 2
        far = self.last is None or ((here[0] - self.last[0]) ** 2 + (here[1] - self.last[1]) ** 2) ** 0.5 > self.moved
        self.last, self.stood = here, 0 if far else self.stood + 1
        passes = far or self.stood < self.frames or e.sec - self.passed >= self.every
        if passes:
            self.passed = e.sec
        return passes


def overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / joint if joint > 0 else 0.0


def near_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` (boxes) that overlap by ``least`` or more, and by how much. A pair's left and upper edges are no
    further apart than that allows: by the share 1 - ``least`` of the width and height of the box that begins first."""
    if least > 0 and len(a) * len(b) > FEW:
        by_left, wide = np.argsort(a[:, 0], kind="stable"), b[:, 2] - b[:, 0]
        left = a[by_left, 0]
        lo = np.searchsorted(left, b[:, 0] - (1 - least) * np.minimum((a[:, 2] - a[:, 0]).max(), wide / least) - 1e-6)
        n = np.maximum(np.searchsorted(left, b[:, 0] + (1 - least) * wide + 1e-6, "right") - lo, 0)
        k = np.repeat(np.arange(len(b)), n)
        t = by_left[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)]
        above, high = a[:, 1][t] - b[:, 1][k], ((1 - least) * (b[:, 3] - b[:, 1]) + 1e-6)[k]
        close = (above <= high) & (above * least >= -high)
        t, k = t[close], k[close]
    else:
        t, k = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    x, y = a[t], b[k]
    both = np.maximum(np.minimum(x[:, 2], y[:, 2]) - np.maximum(x[:, 0], y[:, 0]), 0) * np.maximum(np.minimum(x[:, 3], y[:, 3]) - np.maximum(x[:, 1], y[:, 1]), 0)
    joint = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) + (y[:, 2] - y[:, 0]) * (y[:, 3] - y[:, 1]) - both
    s = np.where(joint > 0, both / np.where(joint > 0, joint, 1), 0.0)
    enough = s >= least
    return t[enough], k[enough], s[enough]


def greedy(tracks: dict, boxes: list[tuple], scores: list[float], least: float) -> dict[int, object]:
    """Which track each box goes to, of pairs that overlap by ``least`` or more: the largest overlap first, then the highest
    score, then the places of track and box.

    Where there are many, pairs of a large overlap are settled first, and smaller ones are looked for only among what is left, so
    that few pairs are looked at however full a frame is.
    """
    of: dict[int, object] = {}
    if not tracks or not boxes:
        return of
    names, a, b, score = list(tracks), np.array(list(tracks.values()), float), np.array(boxes, float), np.array(scores, float)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    for low in [s for s in BANDS if s > least and len(a) * len(b) > FEW] + [least]:
        rows, own = np.flatnonzero(free_a), np.flatnonzero(free_b)
        if not len(rows) or not len(own):
            break
        t, k, s = near_pairs(a[rows], b[own], low)
        t, k = rows[t], own[k]
        order = np.lexsort((t, k, a[t, 3], a[t, 2], a[t, 1], a[t, 0], -score[k], -s))
        for n, box in zip(t[order].tolist(), k[order].tolist(), strict=True):
            if free_a[n] and free_b[box]:
                of[box], free_a[n], free_b[box] = names[n], False, False
    return of


@dataclass
class Tracker:
    """Boxes of one camera, frame by frame: pairs of a track and a box are joined greedily, then tracks not seen for ``idle``
    seconds end, and boxes left over begin tracks. So a track may go on after any pause, if nothing came in between."""

    idle: float
    least: float = 0.45
    tracks: dict[int, list] = field(default_factory=dict)  # number: box, time, boxes so far
    made: int = 0

    @property
    def quiet(self) -> float:
        return self.idle

    def frame(self, now: float, boxes: list[tuple], scores: list[float]) -> list[tuple[int, int]]:
        """The track of each box, and how many boxes the track has had."""
        of = greedy({n: t[0] for n, t in self.tracks.items()}, boxes, scores, self.least)
        for k, n in of.items():
            self.tracks[n] = [boxes[k], now, self.tracks[n][2] + 1]
        self.tracks = {n: t for n, t in self.tracks.items() if now - t[1] <= self.idle}
        for k, b in enumerate(boxes):
            if k not in of:
                self.made += 1
                of[k] = self.made
                self.tracks[self.made] = [b, now, 1]
        return [(of[k], self.tracks[of[k]][2]) for k in range(len(boxes))]


@dataclass
class Light:
    """One camera's light: a mean in which a reading counts by the seconds since the one before, its place between a floor and a
    ceiling that move slowly with what is read, and nothing or all within ``dead`` of either. After ``idle`` seconds it begins anew."""

    idle: float = 120.0
    tau: float = 2.0
    slow: float = 0.002
    span: float = 30.0
    dead: float = 0.05
    night: float = 0.20
    day: float = 0.80
    mean: float = 100.0
    floor: float = 40.0
    ceiling: float = 150.0
    last: float | None = None
    mode: str = "transition"

    @property
    def quiet(self) -> float:
        return self.idle

    def step(self, e) -> tuple[float, float, str, bool]:
        """The mean, the share of light, the time of day, and whether that has changed."""
        if self.last is None:
            self.mean = e.light
        else:
            gap = e.sec - self.last
            self.mean += (1 - exp(-gap / self.tau) if gap > 0 else 0.05) * (e.light - self.mean)
        pull = lambda x, beyond: x + self.slow * (e.light - x) if beyond else x
        relax = lambda x: x + self.slow / 10 * (e.light - x)
        self.floor, self.ceiling = relax(pull(self.floor, e.light < self.floor)), relax(pull(self.ceiling, e.light > self.ceiling))
        if self.ceiling - self.floor < self.span:
            middle = (self.ceiling + self.floor) / 2
            self.floor, self.ceiling = middle - self.span / 2, middle + self.span / 2
        self.last = e.sec
        share = min(1.0, max(0.0, (self.mean - self.floor) / (self.ceiling - self.floor)))
        share = 0.0 if share < self.dead else 1.0 if share > 1 - self.dead else share
        mode, before = "night" if share < self.night else "day" if share > self.day else "transition", self.mode
        self.mode = mode
        return self.mean, share, mode, mode != before


@dataclass
class Smoothed:
    """One track's box: ``alpha`` of what is read and the rest of the box before, whole pixels by rounding half to even, at least one wide and high."""

    idle: float
    alpha: float = 0.4
    box: tuple[int, ...] | None = None

    @property
    def quiet(self) -> float:
        return self.idle

    def step(self, e) -> tuple[int, ...]:
        new = (e.x1, e.y1, e.x2, e.y2)
        if self.box is not None:
            x1, y1, x2, y2 = (round(self.alpha * n + (1 - self.alpha) * o) for n, o in zip(new, self.box, strict=True))
            new = (x1, y1, max(x2, x1 + 1), max(y2, y1 + 1))
        self.box = new
        return new
