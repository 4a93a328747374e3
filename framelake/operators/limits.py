"""A rate limit over all cameras and one over each, exactly, without one task for all time.

The limits depend on what passed before, over all cameras together. Time is cut into slots much longer than the limits'
memory. All slots are run at once, as if nothing came before; then those that a neighbour leaves with another state than they
began with run again, until none is left. What a slot leaves is mostly what happens near its end, so that few rounds are needed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.plans.registry import query
from framelake.sources.sinks import kept
from framelake.sources.tables import detections


@dataclass
class Limiter:
    """At most ``most`` calls pass in a window, which begins with the first call more than ``window`` seconds after the last
    one began; and of a camera one in ``gap`` seconds. A call refused by either limit counts for neither."""

    window: float = 1.0
    most: int = 60
    gap: float = 1 / 15
    began: float | None = None
    passed: int = 0
    last: dict[str, float] = field(default_factory=dict)

    def step(self, sec: float, camera: str) -> bool:
        if self.began is None or sec - self.began > self.window:
            self.began, self.passed = sec, 0
        if self.passed >= self.most or (camera in self.last and sec - self.last[camera] < self.gap):
            return False
        self.passed += 1
        self.last[camera] = sec
        return True

    def passing(self, secs: np.ndarray, cameras: np.ndarray) -> list[int]:
        """Places of the calls that pass, as ``step`` would tell, of calls in order: goes from one that passes to the next."""
        out, i, n = [], 0, len(secs)
        own = {c: np.flatnonzero(cameras == c) for c in np.unique(cameras)}

        def upcoming(c) -> int:
            k, t = own[c].searchsorted(i), self.last.get(str(c))
            if t is not None:
                k = max(k, np.searchsorted(secs[own[c]] - t >= self.gap, True))
            return int(own[c][k]) if k < len(own[c]) else n

        nearest = [(upcoming(c), c) for c in own]
        while i < n:
            if self.began is None or secs[i] - self.began > self.window:
                self.began, self.passed = secs[i].item(), 0
            end = i + int(np.searchsorted(secs[i:] - self.began > self.window, True))
            while self.passed < self.most and i < end:
                nearest = [(k if k >= i else upcoming(c), c) for k, c in nearest]
                k, c = min(nearest)
                if k >= end:
                    break
                out.append(k)
                self.passed, self.last[str(c)], i = self.passed + 1, secs[k].item(), k + 1
            i = end
        return out

    def left(self, now: float) -> str:
        """What still counts at ``now``, when a slot ends."""
        window = [self.began, self.passed] if self.began is not None and now - self.began <= self.window else None
        return json.dumps([window, sorted((c, t) for c, t in self.last.items() if now - t < self.gap)])

    def resume(self, left: str) -> Limiter:
        window, last = json.loads(left)
        self.began, self.passed = window or (None, 0)
        self.last = dict(last)
        return self


def _run(calls: DataFrame, entries: DataFrame, span: int, rule: Callable[[], Limiter], schema: str, rows: Callable) -> DataFrame:
    """``rows`` of each slot of ``entries`` (slot, entry), whose calls go in order through a rule that begins with the entry."""
    own = calls.join(entries, "slot").select("slot", "entry", "sec", "event_id", "camera_id").repartition("slot").sortWithinPartitions("slot", "sec", "event_id")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        def done():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows(now, state.left((now + 1) * span), passed)], names=names)

        now = state = None
        for b in batches:
            slots = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
            for start, end in zip(cuts, cuts[1:]):
                part = b.slice(start, end - start)
                if not part.num_rows:
                    continue
                if now != slots[start].item():
                    if state:
                        yield done()
                    now, state, passed = slots[start].item(), rule().resume(part.column(1)[0].as_py()), []
                passed += part.column(3).take(pa.array(state.passing(part.column(2).to_numpy(), np.array(part.column(4).to_pylist())), pa.int64())).to_pylist()
        if state:
            yield done()

    return own.mapInArrow(run, schema)


def limited(calls: DataFrame, rule: Callable[[], Limiter], span: int) -> DataFrame:
    """event_id of the calls (event_id, sec, camera_id) that pass; a slot has ``span`` seconds, longer than the limits remember."""
    if max(rule().window, rule().gap) > span:
        raise ValueError("a slot must be longer than the limits remember")
    none = rule().left(0)
    calls = calls.select("event_id", "sec", "camera_id", F.floor(F.col("sec") / span).cast("long").alias("slot"))
    leaves = lambda slot, left, passed: ([slot], [left])
    slots = kept(calls.select("slot").distinct())
    asked = slots.withColumn("entry", F.lit(none))
    done = kept(_run(calls, asked, span, rule, "slot long, left string", leaves).join(asked, "slot"))
    while True:
        # a row a slot; a slot after an empty one begins with nothing
        by = Window.orderBy("slot")
        before = F.when(F.lag("slot").over(by) == F.col("slot") - 1, F.lag("left").over(by))
        other = kept(done.withColumn("due", F.coalesce(before, F.lit(none))).where("due <> entry").select("slot", F.col("due").alias("entry")))
        if other.isEmpty():
            break
        again = _run(calls, other, span, rule, "slot long, left string", leaves).join(other, "slot")
        done = kept(done.join(other.select("slot"), "slot", "left_anti").unionByName(again))
    return _run(calls, done.select("slot", "entry"), span, rule, "event_id long", lambda slot, left, passed: (pa.array(passed, pa.int64()),))


@query(
    'SELECT event_id FROM r WHERE ok',
    """n AS (SELECT event_id, sec, CAST(substr(camera_id, 5) AS INT) AS c, row_number() OVER (ORDER BY sec, event_id) AS k FROM det),
  r AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, false AS ok, CAST(-100000 AS BIGINT) AS began, CAST(0 AS BIGINT) AS passed, list_value(-100000, -100000, -100000, -100000, -100000, -100000, -100000, -100000)::BIGINT[] AS last
    UNION ALL SELECT k, event_id, ok, began, CASE WHEN ok THEN so_far + 1 ELSE so_far END, CASE WHEN ok THEN last[:c] || [sec] || last[c + 2:] ELSE last END FROM (
      SELECT *, so_far < 12 AND sec - last[c + 1] >= 3600 AS ok FROM (
        SELECT n.k, n.event_id, n.sec, n.c, r.last, CASE WHEN n.sec - r.began > 10800 THEN n.sec ELSE r.began END AS began, CASE WHEN n.sec - r.began > 10800 THEN 0 ELSE r.passed END AS so_far FROM r JOIN n ON n.k = r.k + 1)))""",
    recursive=True,
)
def dd10_limited_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most twelve calls in a window of three hours, and one an hour of a camera, in slots of a day. Tested by a plain loop."""
    return limited(detections(spark, sf_dir), lambda: Limiter(10800, 12, 3600), 86400)
