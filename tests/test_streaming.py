"""Streams over a replayed directory give what the batch gives."""

from pyspark.sql import functions as F

from framelake.operators.dedup import cooldown as batch_cooldown
from framelake.sources.tables import detections
from framelake.streaming.events import SCHEMA, cooldown, counts_by_window, source

SF = "/root/testdata/sf0.001"


def replayed(spark, tmp_path, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    d = detections(spark, SF).where("track_id >= 0").withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    parts = d.orderBy("ts").randomSplit([1.0], 1)[0].toPandas()
    for k in range(3):
        own = parts.iloc[k * len(parts) // 3 : (k + 1) * len(parts) // 3]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = source(spark, str(tmp_path / "in"))
    got = replayed(spark, tmp_path, cooldown(events, 7200), "cooled", "append")
    want = batch_cooldown(d, ["camera_id", "track_id"], 7200)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())
    n = replayed(spark, tmp_path, counts_by_window(events), "counted", "complete")
    assert sum(r.n for r in n.collect()) == d.count()


def test_windows_by_hand():
    from framelake.streaming.fusion import step

    assert step(1000, None, [], ["a"], 2, 10, False) == (1000, ["a"], [])
    assert step(2500, 1000, ["a"], ["b"], 2, 10, False) == (1000, ["a", "b"], [])
    assert step(3000, 1000, ["a", "b"], ["c"], 2, 10, False) == (None, [], ["a", "b", "c"])
    assert step(3001, 1000, ["a"], [], 2, 10, True) == (None, [], ["a"])
    assert step(99_000, 1000, ["a"], [], 2, 10, True) == (None, [], [])


def test_windows_stream(spark, tmp_path):
    """Two streams; each camera's events come out once, a window at a time."""
    import time

    from framelake.streaming.fusion import several, windows

    schema = "event_id long, camera_id string"
    for name, first in (("vehicles", 0), ("humans", 100)):
        for k in range(2):
            rows = [(first + 10 * k + i, f"cam-{i % 2}") for i in range(4)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    events = several(spark, {n: str(tmp_path / n) for n in ("vehicles", "humans")}, schema)
    fused = windows(events, lambda w: w.groupby("camera_id", as_index=False).agg(n=("event_id", "count"), first=("event_id", "min")), "camera_id string, n long, first long", window=1.0, ttl=600)
    q = fused.writeStream.format("memory").queryName("fused").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    deadline = time.time() + 90
    try:
        while time.time() < deadline and sum(r.n for r in spark.table("fused").collect()) < 16:
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.table("fused").collect()
    assert sum(r.n for r in rows) == 16 and {r.camera_id for r in rows} == {"cam-0", "cam-1"}
