"""Limits, tracks, merged candidates, light, arbitration and stored batches against plain loops and formulas."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import kalman
from framelake.operators import arbitration, limits, tracking
from framelake.queries import QUERIES
from framelake.sources.tables import detections

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return sorted(detections(spark, SF).collect(), key=lambda r: (r.sec, r.event_id))


def plain_limit(calls, window, most, gap):
    start, count, last, out = -math.inf, 0, {}, set()
    for event, sec, camera in sorted(calls, key=lambda c: (c[1], c[0])):
        if sec - start > window:
            start, count = sec, 0
        if count < most and sec - last.get(camera, -math.inf) >= gap:
            count, last[camera] = count + 1, sec
            out.add(event)
    return out


def test_limits(spark, events):
    want = plain_limit([(e.event_id, e.sec, e.camera_id) for e in events], 10800, 12, 3600)
    assert {r.event_id for r in QUERIES["dd10_limited_calls"](spark, SF).collect()} == want


@pytest.mark.parametrize("most,gap,span", [(5, 3, 20), (60, 3, 11), (3, 0.5, 40)])
def test_limits_of_dense_calls(spark, most, gap, span):
    """No pause anywhere, so that what a slot leaves matters to the next, and either limit is met often."""
    g = np.random.default_rng(most)
    at = np.cumsum(g.integers(0, 2, 900))
    calls = [(k, int(t), f"cam-{g.integers(0, 4)}") for k, t in enumerate(at)] + [(10_000, 5000, "cam-0")]
    df = spark.createDataFrame(calls, "event_id long, sec long, camera_id string")
    got = limits.limited(df, lambda: limits.Limiter(10, most, gap), span)
    assert {r.event_id for r in got.collect()} == plain_limit(calls, 10, most, gap)
    assert limits.limited(df.where("false"), lambda: limits.Limiter(10, most, gap), span).count() == 0


def test_filter_by_formulas():
    """One track, with matrices written out."""
    box = np.array([[10.0, 20.0, 50.0, 120.0]])
    z = kalman.measured(box)
    assert z.tolist() == [[30, 70, 0.4, 100]] and np.allclose(kalman.boxed(z), box)
    mean, cov = kalman.begun(z)
    h = 100
    assert np.allclose(np.sqrt(np.diag(cov[0])), [2 * h / 20, 2 * h / 20, 1e-2, 2 * h / 20, 10 * h / 160, 10 * h / 160, 1e-5, 10 * h / 160])
    a = np.eye(8)
    for k in range(4):
        a[k, k + 4] = 3.0
    q = np.diag([(h / 20) ** 2, (h / 20) ** 2, 1e-4, (h / 20) ** 2, (h / 160) ** 2, (h / 160) ** 2, 1e-10, (h / 160) ** 2]) * 3.0
    m1, c1 = kalman.predict(mean, cov, 3.0)
    assert np.allclose(m1[0], a @ mean[0]) and np.allclose(c1[0], a @ cov[0] @ a.T + q)
    r, hm, z2 = np.diag([(h / 20) ** 2, (h / 20) ** 2, 1e-2, (h / 20) ** 2]), np.eye(4, 8), np.array([[36.0, 70.0, 0.4, 100.0]])
    s = hm @ c1[0] @ hm.T + r
    k = c1[0] @ hm.T @ np.linalg.inv(s)
    m2, c2 = kalman.update(m1, c1, z2)
    assert np.allclose(m2[0], m1[0] + k @ (z2[0] - hm @ m1[0])) and np.allclose(c2[0], (np.eye(8) - k @ hm) @ c1[0])
    d = z2[0] - hm @ m1[0]
    assert np.allclose(kalman.distances(m1, c1, z2), d @ np.linalg.inv(s) @ d)


def test_assignment():
    g = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 5), repeat=2):
        for most in (0.2, 0.6, 1.0):
            cost = g.random((n, m))
            cost[g.random((n, m)) < 0.2] = np.inf
            got = kalman.assigned(cost, most)
            assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and all(cost[a, b] <= most for a, b in got)
            best = min(sum(cost[a, b] - most for a, b in zip(rows, columns)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for columns in itertools.permutations(range(m), k) if all(cost[a, b] <= most for a, b in zip(rows, columns)))
            assert math.isclose(sum(cost[a, b] - most for a, b in got), best, abs_tol=1e-9)
    assert kalman.assigned(np.zeros((0, 3)), 1) == []


def test_paths():
    """Two boxes that move at even speed and cross keep their tracks, at uneven steps and through a short loss."""
    g, tracks = np.random.default_rng(4), kalman.Boxes(rate=10, lost=2.0)
    now, names = 0.0, []
    for k in range(60):
        now += float(g.choice([0.1, 0.1, 0.2]))
        x = np.array([[100 + 60 * now, 100, 220 + 60 * now, 200], [900 - 60 * now, 260, 1020 - 60 * now, 360]]) + g.normal(0, 1, (2, 4))
        if 20 <= k < 24:  # the first one is hidden
            names.append([None, tracks.frame(now, x[1:], np.array([0.9]))[0]])
        else:
            names.append(tracks.frame(now, x, np.array([0.9, 0.3 if k % 5 == 4 else 0.8])))
    assert {n[0] for n in names} == {1, None} and {n[1] for n in names} == {2} and tracks.made == 2
    # a new box is confirmed by its second frame only; an unsure one begins nothing; all end after a pause
    far = np.array([[1500.0, 700, 1600, 800]])
    assert tracks.frame(now + 0.1, far, np.array([0.3])) == [None] and tracks.frame(now + 0.2, far, np.array([0.9])) == [None] and tracks.frame(now + 0.3, far, np.array([0.9])) == [3]
    assert tracks.frame(now + 10, far, np.array([0.9])) == [4]


def test_filtered_tracks(spark, events):
    """Whole cameras in one loop give the same as their pieces."""
    got = {r.event_id: r.track for r in QUERIES["ge19_filtered_tracks"](spark, SF).collect()}
    own = [e for e in events if e.track_id >= 0]
    assert set(got) == {e.event_id for e in own}
    for camera in sorted({e.camera_id for e in own}):
        state, names = kalman.Boxes(rate=1 / 3600, lost=43200, gate=1e9), {}
        for sec, frame in itertools.groupby((e for e in own if e.camera_id == camera), key=lambda e: e.sec // 900 * 900):
            frame = sorted(frame, key=lambda e: e.event_id)
            x = np.array([[e.track_id * 173 % 1500 + e.event_id % 7, e.track_id * 97 % 700 + e.event_id % 5] for e in frame], float)
            found = state.frame(sec, np.concatenate([x, x + [200, 150]], 1), np.array([e.event_id % 10 / 10 for e in frame]))
            for e, n in zip(frame, found):
                assert (got[e.event_id] is None) == (n is None)
                if n is not None:
                    assert names.setdefault(n, got[e.event_id]) == got[e.event_id]
        assert len(set(names.values())) == len(names)


def plain_overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_merged_candidates(spark, events):
    want, groups, replaced = set(), {}, 0
    for e in sorted(events, key=lambda e: e.event_id):
        if e.class_name != "person":
            x, y = e.x1 // 600 * 600 + e.event_id % 40, e.y1 // 300 * 300 + e.event_id % 30
            box = [x, y, x + 150, y + 120] if e.event_id % 29 else None
            groups.setdefault((e.camera_id, e.sec // 21600), ([], []))[e.source == "vehicles"].append({"id": e.event_id, "c": e.confidence, "box": box})
    for key, (first, second) in groups.items():
        if first and second:
            for c in second:
                for x in first:
                    if c["box"] and x["box"] and plain_overlap(c["box"], x["box"]) > 0.55:
                        if c["c"] > x["c"]:
                            x.update(c)
                            replaced += 1
                        break
                else:
                    first.append(dict(c))
            out = []
            for c in sorted(first, key=lambda c: c["c"], reverse=True):
                if c["box"] and not any(plain_overlap(c["box"], x["box"]) > 0.45 for x in out):
                    out.append(c)
        else:
            out = first or second
        want |= {(*key, c["id"], k) for k, c in enumerate(out)}
    assert {tuple(r) for r in QUERIES["so5_merged_candidates"](spark, SF).collect()} == want and replaced > 0


def test_merging_by_hand():
    a, near, off = (0, 0, 100, 100), (10, 0, 110, 100), (30, 0, 130, 100)
    assert tracking.merged([(1, 0.5, a)], [(2, 0.9, near)]) == [(2, 0.9, near)]
    assert tracking.merged([(1, 0.9, a)], [(2, 0.5, near)]) == [(1, 0.9, a)]
    assert tracking.merged([(1, 0.9, a)], [(2, 0.5, off)]) == [(1, 0.9, a)]  # kept apart at 0.54, then suppressed
    assert tracking.merged([], [(2, 0.5, None)]) == [(2, 0.5, None)] and tracking.merged([(1, 0.5, None)], [(2, 0.5, None)]) == []
    # once replaced, the kept box is the new one
    assert [c[0] for c in tracking.merged([(1, 0.5, a)], [(2, 0.9, near), (3, 0.1, (25, 0, 125, 100))])] == [2]


def test_light(spark, events):
    got = {r.event_id: r for r in QUERIES["wn6_light_adaptation"](spark, SF).collect()}
    modes = set()
    for camera in sorted({e.camera_id for e in events}):
        last = None
        for e in (e for e in events if e.camera_id == camera):
            b = e.sharpness * 0.6
            if last is None or e.sec - last > 21600:
                ema, floor, ceiling, mode = b, 40.0, 150.0, "transition"
            else:
                alpha = 1.0 - math.exp(-(e.sec - last) / 7200) if e.sec > last else 0.05
                ema = ema + alpha * (b - ema)
            if b < floor:
                floor = floor + 0.05 * (b - floor)
            if b > ceiling:
                ceiling = ceiling + 0.05 * (b - ceiling)
            floor, ceiling = floor + 0.005 * (b - floor), ceiling + 0.005 * (b - ceiling)
            if ceiling - floor < 30:
                floor, ceiling = (floor + ceiling) / 2 - 15, (floor + ceiling) / 2 + 15
            ratio = max(0.0, min(1.0, (ema - floor) / (ceiling - floor)))
            ratio = 0.0 if ratio < 0.05 else 1.0 if ratio > 0.95 else ratio
            new = "night" if ratio < 0.2 else "day" if ratio > 0.8 else "transition"
            r = got[e.event_id]
            assert math.isclose(r["mean"], ema, abs_tol=1e-6) and math.isclose(r.share, ratio, abs_tol=1e-6) and (r["mode"], r.changed) == (new, new != mode)
            last, mode = e.sec, new
            modes.add(new)
    assert modes == {"night", "day", "transition"} and len(got) == len(events)


def test_arbitration(spark):
    rows = arbitration.candidates(arbitration.noisy(spark, SF)).where("size(candidates) > 0").collect()
    got = {r.event_id: tuple(r)[1:] for r in QUERIES["ag34_sf25_arbitrated"](spark, SF).collect()}
    want, bonus = {}, 0
    for camera in sorted({r.camera_id for r in rows}):
        history = []
        for r in sorted((r for r in rows if r.camera_id == camera), key=lambda r: (r.sec, r.event_id)):
            if history and r.sec - history[-1][0] > 172800:
                history = []
            plates = [p for _, p in history]
            leader = max(dict.fromkeys(plates), key=plates.count) if plates else None
            ratio = plates.count(leader) / len(plates) if plates else 0
            scores = [0.6 * c.confidence + 0.25 * c.boost + 0.15 * (ratio if c.plain == leader else 0) for c in r.candidates]
            k = scores.index(max(scores))
            c = r.candidates[k]
            bonus += c.plain == leader
            want[r.event_id] = (c.source, c.text, c.confidence, round(scores[k], 9))
            history = [h for h in history + [(r.sec, c.plain)] if h[0] > r.sec - 86400]
    assert got == want and bonus > 10 and len({w[0] for w in want.values()}) >= 3


def test_batches_are_stored_once(spark, tmp_path):
    """A batch that fails between its tables, or comes again, leaves one copy in each."""
    from framelake.sources.sinks import store_once, stored

    path, failing = str(tmp_path / "store"), {"on": True}

    def events_of(df):
        if failing["on"]:
            raise RuntimeError("the second table can't be written")
        return df.select("event_id", F.lit("plate").alias("kind"))

    write = store_once(path, {"plates": lambda df: df.select("event_id", "plate"), "events": events_of})
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, plate string")
    with pytest.raises(RuntimeError):
        write(batch, 0)
    read = lambda name, schema: sorted(map(tuple, stored(spark, path, name, schema).collect()))
    assert read("plates", "event_id long, plate string") == []  # half a batch doesn't count
    failing["on"] = False
    for number in (0, 0, 1, 0):
        write(batch, number)
    assert read("plates", "event_id long, plate string") == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    assert read("events", "event_id long, kind string") == [(1, "plate"), (1, "plate"), (2, "plate"), (2, "plate")]
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a stream that loses its checkpoint runs its batches again
        source = spark.readStream.schema("event_id long, plate string").parquet(str(tmp_path / "in"))
        q = source.writeStream.foreachBatch(store_once(str(tmp_path / "s"), {"plates": lambda df: df, "events": events_of})).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert stored(spark, str(tmp_path / "s"), "plates", "event_id long, plate string").count() == 2


def test_argmax_tracks(spark, events):
    """The tracker over every frame of a camera, frames without a box too."""
    got = {r.event_id: r.track for r in QUERIES["j8_argmax_tracks"](spark, SF).collect()}
    own, ended = [e for e in events if e.track_id >= 0], 0
    for camera in sorted({e.camera_id for e in own}):
        by_frame = {}
        for e in own:
            if e.camera_id == camera:
                by_frame.setdefault(e.sec // 900, []).append(e)
        tracks, made, names = {}, 0, {}
        for f in range(min(by_frame), max(by_frame) + 1):
            boxes = []
            for e in sorted(by_frame.get(f, []), key=lambda e: e.event_id):
                x, y = e.track_id * 173 % 1500 + e.event_id * 13 % 120, e.track_id * 97 % 700 + e.event_id * 7 % 60
                boxes.append((e.event_id, [x, y, x + 200, y + 150]))
            table = [(np.float32(plain_overlap(b, tracks[n]["box"])), -k, -t, n) for k, (_, b) in enumerate(boxes) for t, n in enumerate(tracks)]
            of, used = {}, set()
            for iou, k, _, n in sorted(table, reverse=True):
                if iou >= np.float32(0.3) and -k not in of and n not in used:
                    of[-k] = n
                    used.add(n)
            for n in list(tracks):
                if n not in used:
                    tracks[n]["age"] += 1
                    if tracks[n]["age"] > 30:
                        del tracks[n]
                        ended += 1
            for k, (event, b) in enumerate(boxes):
                if k not in of:
                    made += 1
                    of[k] = made
                tracks[of[k]] = {"box": b, "age": 0}
                assert names.setdefault(of[k], got[event]) == got[event]
        assert len(set(names.values())) == len(names)
    assert ended > 10 and len(set(got.values())) < len(got)
