"""Consensus on a track's plate: what each reading of a camera changes, and whether it is to be stored.

``Camera.step`` takes a camera's readings in order of time. A reading has event_id, sec, track_id (below 0: untracked), plate as
read, fixed (look-alikes set right), confidence, sharpness, a box, and written: whether the store took what this reading emits.

A track keeps its last readings. Short texts count for a longer one that they are a part of; the text of the largest sum of
confidence leads. Each place of the text is voted on by confidence and sharpness; a place whose best character has less than
``coverage`` of the weight is doubtful. Hits and misses of the leader move the track between TRACKING, CONFIRMING and CONFIRMED.
A track that wasn't stored at once is deferred until it is confirmed or ``patience`` seconds old; a stored one is revised when
another text leads or its sum has grown by ``gain``, ``wait`` seconds after the last time. Plates that stand still are not
stored again by other tracks. Of equal sums or votes the one read first wins.

State is bounded: texts by the window, tracks and spots by time and by ``cap``, beyond which the longest unseen go.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

from framelake.functions.stateful import edits


@dataclass(frozen=True)
class Rules:
    window: int = 5
    idle: float = 3.0  # a track unseen for longer begins anew
    instant: float = 0.75  # stored at once
    margin: float = 0.10  # or this much less, if the picture is sharp
    sharp: float = 110
    known: float = 0.85  # a reading one edit from a plate this sure counts
    damped: float = 0.9  # so much of its confidence
    coverage: float = 0.60
    doubtful: int = 1  # places of a complete text
    shortest: int = 7
    sure: float = 0.8
    hits: int = 2
    misses: int = 2  # in a row: the leader changes
    revert: int = 4  # in a row: a confirmed track is tracked again
    patience: float = 2.5
    retry: float = 0.15  # surer than at a write that failed: again
    gain: float = 1.0
    wait: float = 2.0
    still: float = 140  # pixels
    parked: float = 600
    ttl: float = 15
    moved: float = 250
    cap: int = 1200
    sweep: int = 10  # readings between two looks for what has expired

    @property
    def quiet(self) -> float:
        return max(self.idle, self.parked, self.ttl)


class Reading(NamedTuple):
    plate: str
    confidence: float
    sharpness: float


@dataclass
class Track:
    plate: str
    fixed: str
    confidence: float
    first: float
    last: float
    shot: int
    sharpness: float
    readings: list[Reading]
    leader: str
    best: float
    status: str = "deferred"  # then pending until it is written, then stored
    state: str = "TRACKING"
    hits: int = 1
    misses: int = 0
    updated: float = 0.0
    written_as: float = 0.0

    def judge(self, leader: str, mean: float, complete: bool, rules: Rules) -> None:
        """Hits and misses of the leader, and the state that follows."""
        if leader == self.leader:
            self.hits, self.misses = self.hits + 1, 0
        else:
            self.misses += 1
            if self.misses >= rules.revert and self.state == "CONFIRMED" and not (complete and mean >= rules.sure):
                self.state, self.hits = "TRACKING", 0
            if self.misses >= rules.misses:
                self.leader, self.hits, self.misses = leader, 1, 0
        if complete and mean >= rules.sure:
            self.state = "CONFIRMED" if self.hits >= rules.hits else "CONFIRMING"
        elif self.state != "CONFIRMED":
            self.state = "TRACKING"


class Outcome(NamedTuple):
    kind: str | None  # new, confirmed, overdue, retry, update, untracked; None: nothing to store
    plate: str
    confidence: float
    shot: int
    state: str | None
    hits: int
    misses: int
    doubtful: int


def drops(short: str, long: str) -> bool:
    """Is ``short`` what is left of ``long`` without one or two characters, with its first five and last two in place?"""
    if not 1 <= len(long) - len(short) <= 2 or short[:5] != long[:5] or short[-2:] != long[-2:]:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def whole(plate: str, readings: list[Reading]) -> str:
    """The most frequent longer reading that a text of under eight characters is a part of; else the text itself."""
    if not plate or len(plate) > 7:
        return plate
    longer = Counter(r.plate for r in readings if len(r.plate) - len(plate) in (1, 2) and (r.plate.startswith(plate) or drops(plate, r.plate)))
    return longer.most_common(1)[0][0] if longer else plate


def voted(readings: list[Reading], coverage: float) -> tuple[str, int]:
    """The text by place, of the length of most confidence (the longer on ties), and how many of its places are doubtful."""
    read = [(whole(r.plate, readings), r) for r in readings if r.plate]
    lengths: dict[int, float] = {}
    for p, r in read:
        lengths[len(p)] = lengths.get(len(p), 0.0) + r.confidence
    if not lengths:
        return "", 0
    n = max(lengths, key=lambda k: (lengths[k], k))
    text, doubtful = "", 0
    for place in range(n):
        votes: dict[str, float] = {}
        for p, r in read:
            if len(p) == n:
                votes[p[place]] = votes.get(p[place], 0.0) + r.confidence * (0.3 + 0.7 * min(r.sharpness / 200.0, 1.0))
        best = max(votes, key=votes.__getitem__)
        text += best
        doubtful += votes[best] / max(1e-6, sum(votes.values())) < coverage
    return text, doubtful


@dataclass
class Camera:
    rules: Rules
    tracks: dict[int, Track] = field(default_factory=dict)
    spots: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    seen: int = 0

    @property
    def quiet(self) -> float:
        return self.rules.quiet

    def step(self, e) -> Outcome:
        if e.track_id < 0:
            out = self._untracked(e)
        else:
            t = self.tracks.get(e.track_id)
            out = self._begin(e) if t is None or e.sec - t.last > self.rules.idle else self._go_on(e, t)
        self.seen += 1
        if self.seen % self.rules.sweep == 0:
            self.forget(e.sec)
        return out

    def forget(self, now: float) -> None:
        """Drop what can't count any more, and of the rest the longest unseen beyond ``cap``."""
        r = self.rules
        self.tracks = {k: t for k, t in self.tracks.items() if now - t.last <= max(r.ttl, r.idle)}
        self.spots = {p: s for p, s in self.spots.items() if now - s[0] <= max(r.ttl, r.parked)}
        for own, age in ((self.tracks, lambda k: self.tracks[k].last), (self.spots, lambda p: self.spots[p][0])):
            for k in sorted(own, key=age)[: max(0, len(own) - r.cap)]:
                del own[k]

    def _here(self, e) -> tuple[int, int]:
        return int((e.x1 + e.x2) / 2), int((e.y1 + e.y2) / 2)

    def _near(self, e, plate: str) -> tuple[float, float] | None:
        """Seconds since the plate was last at a spot, and pixels from there."""
        if plate not in self.spots:
            return None
        at, x, y = self.spots[plate]
        here = self._here(e)
        return e.sec - at, ((here[0] - x) ** 2 + (here[1] - y) ** 2) ** 0.5

    def _free(self, e, plate: str) -> bool:
        """May the plate be stored? Not while it stands where it was; either way its clock restarts."""
        near = self._near(e, plate)
        self.spots[plate] = (e.sec, *self._here(e))
        return near is None or near[0] >= self.rules.parked or near[1] > self.rules.still

    def _untracked(self, e) -> Outcome:
        near, r, passes, restart = self._near(e, e.fixed), self.rules, True, True
        if near:
            gap, far = near
            if far <= r.still and gap < r.parked:
                passes = False
            elif gap < r.ttl:
                passes = restart = far > r.moved
        if restart:
            self.spots[e.fixed] = (e.sec, *self._here(e))
        return Outcome("untracked" if passes else None, e.plate, e.confidence, e.event_id, None, 0, 0, 0)

    def _begin(self, e) -> Outcome:
        r = self.rules
        at_once = e.confidence >= r.instant or (e.confidence >= max(0.0, r.instant - r.margin) and e.sharpness >= r.sharp)
        t = Track(e.plate, e.fixed, e.confidence, e.sec, e.sec, e.event_id, e.sharpness, [Reading(e.fixed, e.confidence, e.sharpness)], e.fixed, e.confidence)
        self.tracks[e.track_id] = t
        if at_once and self._free(e, e.fixed):
            t.status, t.state, t.hits, t.updated = "stored" if e.written else "pending", "CONFIRMED", r.hits, e.sec
            return self._out(t, "new")
        return self._out(t, None)

    def _out(self, t: Track, kind: str | None, doubtful: int = 0) -> Outcome:
        return Outcome(kind, t.plate, t.confidence, t.shot, t.state, t.hits, t.misses, doubtful)

    def _go_on(self, e, t: Track) -> Outcome:
        r, confidence = self.rules, e.confidence
        if t.fixed and t.confidence >= r.known and edits(t.fixed, e.fixed, 1) == 1:
            confidence *= r.damped
        t.readings = [*t.readings, Reading(e.fixed, confidence, e.sharpness)][-r.window :]
        t.last = e.sec
        if e.sharpness > t.sharpness:
            t.sharpness, t.shot = e.sharpness, e.event_id
        sums: dict[str, tuple[float, int]] = {}
        for own in dict.fromkeys(x.plate for x in t.readings):
            name, of = whole(own, t.readings), [x.confidence for x in t.readings if x.plate == own]
            s, n = sums.get(name, (0.0, 0))
            sums[name] = s + sum(of), n + len(of)
        leader = max(sums, key=lambda p: sums[p][0])
        score, n = sums[leader]
        mean = score / n
        text, doubtful = voted(t.readings, r.coverage)
        complete = doubtful <= r.doubtful and len(text) >= r.shortest
        plate = text if len(text) >= r.shortest and doubtful <= r.doubtful + 1 else leader
        t.judge(leader, mean, complete, r)
        kind = None
        if t.status == "deferred":
            due = t.state == "CONFIRMED", e.sec - t.first >= r.patience and t.hits >= 1
            if any(due):
                if self._free(e, leader):
                    kind = "confirmed" if due[0] else "overdue"
                    t.status, t.best, t.written_as = "stored" if e.written else "pending", score, mean
                    t.plate, t.fixed, t.confidence = plate, plate, mean
            elif confidence > t.confidence:
                t.plate, t.fixed, t.confidence = e.plate, e.fixed, confidence
        elif t.status == "pending":
            if confidence > t.confidence:
                t.plate, t.fixed, t.confidence = e.plate, e.fixed, confidence
                if confidence - t.written_as > r.retry:
                    kind, t.written_as, t.status = "retry", confidence, "stored" if e.written else "pending"
        elif complete and (leader != whole(t.fixed, t.readings) or (score > t.best + r.gain and e.sec - t.updated > r.wait)):
            kind, t.best, t.updated = "update", score, e.sec
            t.plate, t.fixed, t.confidence = plate, plate, mean
        return self._out(t, kind, doubtful)

    def packed(self) -> dict:
        """The state as plain values."""
        return {"tracks": {str(k): asdict(t) | {"readings": [list(x) for x in t.readings]} for k, t in self.tracks.items()}, "spots": {p: list(s) for p, s in self.spots.items()}, "seen": self.seen}

    @staticmethod
    def of(rules: Rules, packed: dict) -> Camera:
        tracks = {int(k): Track(**(t | {"readings": [Reading(*x) for x in t["readings"]]})) for k, t in packed["tracks"].items()}
        return Camera(rules, tracks, {p: tuple(s) for p, s in packed["spots"].items()}, packed["seen"])
