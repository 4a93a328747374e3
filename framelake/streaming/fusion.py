"""Windows in processing time: a camera's window opens at the first event that comes and closes after a while."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def several(spark: SparkSession, paths: dict[str, str], schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Streams of Parquet files read as one; ``stream`` says where a row comes from."""
    from pyspark.sql import functions as F

    out = None
    for name, path in paths.items():
        one = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("stream", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def step(now: int, opened: int | None, held: list[str], new: list[str], window: float, ttl: float, timed_out: bool) -> tuple[int | None, list[str], list[str]]:
    """(when the window opened, what it holds, what is to be handed on) after events or the end of the wait, in milliseconds.

    A window that could not be handed on within ``ttl`` seconds is dropped.
    """
    if timed_out:
        return None, [], held if now - opened <= ttl * 1000 else []
    opened = now if opened is None else opened
    held = held + new
    return (None, [], held) if now - opened >= window * 1000 else (opened, held, [])


def windows(events: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, window: float = 2.0, ttl: float = 10.0) -> DataFrame:
    """``f`` of each camera's events of a window, in the order they came. What ``f`` fails on is tried again with its batch, as
    the checkpoint doesn't move on."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, late = state.getCurrentProcessingTimeMs(), state.hasTimedOut
        opened, held = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        new = [] if late else [json.dumps(r) for frame in frames for r in json.loads(frame.to_json(orient="records"))]
        opened, held, out = step(now, opened, held, new, window, ttl, late)
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((opened, held))
            state.setTimeoutDuration(max(1, int(opened + window * 1000 - now)))
        if out:
            yield f(pd.DataFrame([json.loads(r) for r in out]))

    return events.groupBy("camera_id").applyInPandasWithState(run, schema, "opened long, held array<string>", "append", "ProcessingTimeTimeout")
