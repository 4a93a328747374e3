"""Stateful rules: whole keys in one loop against the registered queries, and cases worked out by hand."""

import itertools
from types import SimpleNamespace as E

import pytest
from pyspark.sql import functions as F

from framelake.functions.stateful import Jitter, Spot, Still, Tracker, Votes, edits
from framelake.operators import gates
from framelake.queries import QUERIES
from framelake.sources.tables import detections

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return sorted(detections(spark, SF).collect(), key=lambda r: (r.sec, r.event_id))


@pytest.mark.parametrize(
    "name,key,rule",
    [
        ("dd4_spot_or_ttl", lambda r: (r.camera_id, r.plate), lambda: Spot(gates.TTL, gates.PARKED)),
        ("dd5_jitter_of_tracks", lambda r: (r.camera_id,), lambda: Jitter(gates.TTL)),
        ("dd6_jitter_of_cameras", lambda r: (r.camera_id,), lambda: Jitter(gates.TTL, by_track=False)),
        ("dd8_votes", lambda r: (r.camera_id, r.track_id, r.plate), lambda: Votes(gates.TTL)),
        ("wn11_still_tracks", lambda r: (r.camera_id, r.track_id), lambda: Still(gates.PARKED, 400, 2, gates.TTL)),
    ],
)
def test_gate(spark, events, name, key, rule):
    """Over each key's whole history. The jitter rules keep one memory for a camera here, and compare first characters."""
    states, want = {}, set()
    for e in events:
        if e.class_name == "person" and name != "wn11_still_tracks" or e.track_id < 0 and name == "wn11_still_tracks":
            continue
        k = key(e) + ((e.plate[:3],) if "jitter" in name else ())
        state = states.setdefault(k, rule())
        state.forget = [*getattr(state, "forget", []), e.sec]
        if len(state.forget) > 1 and state.forget[-1] - state.forget[-2] > state.quiet:
            states[k] = state = rule()
            state.forget = [e.sec]
        if state.step(e):
            want.add(e.event_id)
    got = {r.event_id for r in QUERIES[name](spark, SF).collect()}
    assert got == want and 0 < len(got)


def test_rules_by_hand():
    at = lambda sec, plate="51A12345", track=1, x=0, conf=0.5: E(sec=sec, plate=plate, track_id=track, x1=x, x2=x, y1=0, y2=0, confidence=conf)
    spot = Spot(15, 600)
    assert [spot.step(at(*a)) for a in ((0,), (10,), (100, "", 1, 100), (110, "", 1, 250), (112, "", 1, 500), (900, "", 1, 500))] == [True, False, False, False, True, True]
    jitter = Jitter(15)
    assert [jitter.step(at(*a)) for a in ((0,), (5,), (6, "51A12346"), (20, "51A12345", 2), (22, "51B12345"), (36,))] == [True, False, False, False, True, True]
    shared = Jitter(15, by_track=False)
    assert [shared.step(at(*a)) for a in ((0,), (14,), (28,), (29, "51A9"), (30, "51A9"), (60,))] == [True, False, False, True, True, True]
    votes = Votes(15)
    assert [votes.step(at(s, conf=c)) for s, c in ((0, 0.5), (5, 0.5), (10, 0.9), (21, 0.9), (50, 0.9))] == [False, True, False, True, True]
    still = Still(1000, 45, 3, 10)
    assert [still.step(at(s, x=x)) for s, x in ((0, 0), (1, 10), (2, 20), (3, 20), (4, 20), (13, 20), (14, 100))] == [True, True, True, False, False, True, True]
    for a, b in itertools.product(("", "51A1", "51A2", "51A12", "15A1"), repeat=2):
        row = edits(a, b, 9)
        assert row == edits(b, a, 9) and min(row, 2) == edits(a, b, 1)


def test_tracker_by_hand():
    t = Tracker(idle=2)
    box = (0, 0, 100, 100)
    assert t.frame(0, [box, (500, 0, 600, 100)], [0.9, 0.8]) == [(1, 1), (2, 1)]
    # both boxes lie over the first track: the closer one takes it
    assert t.frame(1, [(20, 0, 120, 100), (5, 0, 105, 100)], [0.9, 0.1]) == [(3, 1), (1, 2)]
    # tracks are matched before they end, so the second one goes on after any pause; those not matched have ended then
    assert t.frame(30, [(500, 0, 600, 100)], [0.5]) == [(2, 2)] and t.frame(31, [(5, 0, 105, 100)], [0.5]) == [(4, 1)]


def plain_tracks(events, idle, least, hits=2):
    """One camera in one loop: lists of tracks, matched before those not seen end."""
    tracks, out, made = [], {}, 0
    for sec, frame in itertools.groupby(events, key=lambda e: e.sec // 900 * 900):
        frame = sorted(frame, key=lambda e: e.event_id)
        pairs = []
        for t in tracks:
            for k, e in enumerate(frame):
                a, b = t["box"], (e.x1, e.y1, e.x2, e.y2)
                w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
                iou = w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)
                if iou >= least:
                    pairs.append((-iou, -e.confidence, a, k, t))
        used, of = [], {}
        for *_, k, t in sorted(pairs, key=lambda p: p[:4]):
            if k not in of and t["n"] not in used:
                used.append(t["n"])
                of[k] = t
                t.update(box=(frame[k].x1, frame[k].y1, frame[k].x2, frame[k].y2), seen=sec, hits=t["hits"] + 1)
        tracks = [t for t in tracks if sec - t["seen"] <= idle]
        for k, e in enumerate(frame):
            if k not in of:
                made += 1
                of[k] = {"n": made, "box": (e.x1, e.y1, e.x2, e.y2), "seen": sec, "hits": 1}
                tracks.append(of[k])
            out[e.event_id] = (of[k]["n"], of[k]["hits"] >= hits)
    return out


@pytest.mark.parametrize("idle,least", [(gates.IDLE, 0.2), (3600, 0.05), (900, 0.01)])
def test_tracks(spark, events, idle, least):
    """Pieces that are stitched at their borders against whole cameras; with short idle times nearly every frame is a piece."""
    d = detections(spark, SF).withColumn("sec", F.expr("sec div 900 * 900"))
    got = {r.event_id: r for r in gates.followed_boxes(d, lambda: Tracker(idle, least), 2).collect()}
    assert set(got) == {e.event_id for e in events}
    over = 0
    for camera in {e.camera_id for e in events}:
        own = [e for e in events if e.camera_id == camera]
        names, at = {}, {e.event_id: e.sec for e in own}
        want = plain_tracks(own, idle, least)
        for i, (n, sure) in want.items():
            assert got[i].confirmed == sure and names.setdefault(n, got[i].track) == got[i].track
        assert len(set(names.values())) == len(names)
        last = {}
        for i in sorted(want, key=lambda i: at[i]):
            over += want[i][0] in last and at[i] - last[want[i][0]] > idle + 900
            last[want[i][0]] = at[i]
    assert over > 0 or idle == gates.IDLE  # tracks that went on over a pause
    assert {r.event_id for r in QUERIES["ge18_j7_tracks"](spark, SF).collect()} == set(got)


class PlainJitter:
    """The rule over a list of what is remembered, looked through at each event."""

    def __init__(self, ttl, by_track):
        self.ttl, self.by_track, self.memory = ttl, by_track, []

    def step(self, e):
        plain = e.plate.upper().replace("-", "").replace(".", "").replace(" ", "")
        self.memory = [m for m in self.memory if (e.sec - m["t"] <= self.ttl if self.by_track else e.sec - m["t"] < self.ttl)]
        for m in self.memory:
            if self.by_track and (m["track"], m["raw"]) == (e.track_id, e.plate) and e.sec - m["t"] < self.ttl:
                return False
        order = self.memory if self.by_track else sorted(self.memory, key=lambda m: (m["t"], m["raw"]))
        if len(plain) >= 6:
            for m in order:
                if e.sec - m["t"] < self.ttl and len(m["p"]) >= 6 and m["p"][:3] == plain[:3] and edits(m["p"], plain, 9) <= 1:
                    m["t"] = e.sec
                    return False
        for m in self.memory:
            if m["raw"] == e.plate and (not self.by_track or m["track"] == e.track_id):
                m["t"] = e.sec
                return True
        self.memory.append({"raw": e.plate, "p": plain, "track": e.track_id, "t": e.sec})
        return True


@pytest.mark.parametrize("by_track", [True, False])
def test_jitter_queue(by_track):
    import random

    g = random.Random(by_track)
    for ttl in (5, 30, 200):
        rule, plain, sec, out = Jitter(ttl, by_track), PlainJitter(ttl, by_track), 0, []
        for _ in range(3000):
            sec += g.choice([0, 0, 1, 1, 2, 7])
            base = g.choice(["51A12345", "51A-1234", "51A99", "51A99999", "51B12345"])
            k = g.randrange(len(base) + 1)
            plate = g.choice([base, base[:k] + base[k + 1 :], base[:k] + g.choice("015-") + base[k:], base[:k] + g.choice("015") + base[k + 1 :]])
            e = E(sec=sec, plate=plate, track_id=g.randrange(3))
            out.append(rule.step(e))
            assert out[-1] == plain.step(e)
        assert True in out and False in out and len(rule.near) < 400


def plain_gates(events):
    """The parked-or-waiting, voting and standing rules with dictionaries over all events, nothing forgotten."""
    spots, votes, stored, still, out = {}, {}, {}, {}, {"dd4_spot_or_ttl": set(), "dd8_votes": set(), "wn11_still_tracks": set()}
    for e in events:
        if e.class_name != "person":
            x, y, key = int((e.x1 + e.x2) / 2), int((e.y1 + e.y2) / 2), (e.camera_id, e.plate)
            old = spots.get(key)
            if old is None:
                passes, renew = True, True
            else:
                gap, far = e.sec - old[0], ((x - old[1]) ** 2 + (y - old[2]) ** 2) ** 0.5
                if far <= 140 and gap < 345600:
                    passes, renew = False, True
                elif gap < 86400:
                    passes = renew = far > 200
                else:
                    passes, renew = True, True
            if renew:
                spots[key] = (e.sec, x, y)
            if passes:
                out["dd4_spot_or_ttl"].add(e.event_id)
            key = (e.camera_id, e.track_id, e.plate)
            votes.setdefault(key, []).append(e.sec)
            if key not in stored or e.sec - stored[key] >= 86400:
                if e.confidence >= 0.85 or sum(e.sec - t <= 86400 for t in votes[key]) >= 2:
                    stored[key] = e.sec
                    out["dd8_votes"].add(e.event_id)
        if e.track_id >= 0:
            key, x, y = (e.camera_id, e.track_id), (e.x1 + e.x2) / 2, (e.y1 + e.y2) / 2
            t = still.get(key)
            if t is None or e.sec - t["seen"] > 345600:
                t = still[key] = {"x": None, "n": 0, "passed": 0, "seen": e.sec}
            far = t["x"] is None or ((x - t["x"]) ** 2 + (y - t["y"]) ** 2) ** 0.5 > 400
            t["n"] = 0 if far else t["n"] + 1
            t.update(x=x, y=y, seen=e.sec)
            if far or t["n"] < 2 or e.sec - t["passed"] >= 86400:
                t["passed"] = e.sec
                out["wn11_still_tracks"].add(e.event_id)
    return out


def test_gates_from_the_rules(spark, events):
    for name, want in plain_gates(events).items():
        assert {r.event_id for r in QUERIES[name](spark, SF).collect()} == want, name
