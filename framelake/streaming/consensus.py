"""Plate consensus per camera, over tables and over streams, by the rules of ``functions.consensus``.

Readings are camera_id, track_id, event_id, sec, plate, fixed, confidence, sharpness, x1, y1, x2, y2 and written. Tracks of a
camera share where plates stand, so a camera's readings go together: in order, a pass that holds what can still count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.consensus import Camera, Rules

READ = ["track_id", "plate", "fixed", "confidence", "sharpness", "x1", "y1", "x2", "y2", "written"]
OUT = "camera_id string, track_id long, event_id long, kind string, plate string, confidence double, shot long, state string, hits long, misses long, doubtful long"
NAMES = [c.split()[0] for c in OUT.split(", ")]


def followed(events: DataFrame, rules: Rules) -> DataFrame:
    """What each reading of a table leads to: what is stored (``kind``, null for nothing), and the track's state after it.

    A camera begins anew after a pause in which all its state expires, and its readings are cut there.
    """
    from framelake.operators.gates import stepped

    return stepped(events, ["camera_id"], lambda: Camera(rules), READ, OUT, lambda e, got: (e.camera_id, e.track_id, e.event_id, *got))


def emitted(events: DataFrame, rules: Rules) -> DataFrame:
    """The readings at which something is stored."""
    return followed(events, rules).where("kind is not null")


def stream(events: DataFrame, rules: Rules, late: str = "2 days") -> DataFrame:
    """``followed`` over a stream; a batch's readings go by time, and readings older than earlier batches count as they come.

    A camera's state goes once the watermark, ``late`` behind the newest reading, is past its last one by ``rules.quiet``: it
    would begin anew. Within it, tracks and plates go by time and by ``rules.cap``. Readings behind the watermark are dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, packed = state.get if state.exists else (None, None)
        camera, out = Camera.of(rules, json.loads(packed)) if packed else Camera(rules), []
        own = pd.concat(list(frames)).sort_values(["sec", "event_id"])
        for row in own.to_dict("records"):
            e = SimpleNamespace(**row)
            if last is not None and e.sec - last > rules.quiet:
                camera = Camera(rules)
            last = e.sec if last is None else max(last, e.sec)
            out.append((*key, e.track_id, e.event_id, *camera.step(e)))
        state.update((float(last), json.dumps(camera.packed(), default=lambda x: x.item())))
        state.setTimeoutTimestamp(max(int((last + rules.quiet) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=NAMES)

    timed = events.withColumn("_at", F.timestamp_seconds("sec")).withWatermark("_at", late)
    return timed.groupBy("camera_id").applyInPandasWithState(run, OUT, "last double, camera string", "append", "EventTimeTimeout")

