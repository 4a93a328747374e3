import base64
import hashlib

from pyspark.sql import functions as F

from framelake.sources.files import listed, manifest, paired, payload, videos, weights, write_examples
from framelake.sources.sinks import append, deleted, events_json, export_csv, latest, read_or_empty
from framelake.sources.tables import detections

SF = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"img{k}.jpg").write_bytes(b"x" * (k + 1))
    (tmp_path / "img1.txt").write_text("label")
    assert listed(spark, str(tmp_path), "*.jpg", 0).count() == 1 and listed(spark, str(tmp_path), "*.jpg", 9, 1).count() == 3
    assert {r.md5 for r in manifest(spark, str(tmp_path), "img2.jpg").collect()} == {hashlib.md5(b"xxx").hexdigest()}
    pairs = paired(listed(spark, str(tmp_path), "*.jpg"), listed(spark, str(tmp_path), "*.txt")).collect()
    assert [r.stem for r in pairs] == ["img1"]
    good = base64.b64encode(b"hello").decode()
    got = spark.createDataFrame([(good,), ("data:image/png;base64," + good,), ("***",), ("",), (None,)], "x string").select(payload("x").alias("y")).collect()
    assert [None if r.y is None else bytes(r.y) for r in got] == [b"hello", b"hello", None, None, None]


def test_sinks(spark, tmp_path):
    d = detections(spark, SF).select("event_id", "ts", "camera_id", "plate", "confidence")
    append(d, str(tmp_path / "t"))
    append(d.where("event_id < 5").withColumn("ts", F.col("ts") + F.expr("interval 1 day")).withColumn("plate", F.lit("new")), str(tmp_path / "t"))
    now = latest(spark, str(tmp_path / "t"), ["event_id"], ["ts"])
    assert now.count() == d.count() and now.where("plate = 'new'").count() == d.where("event_id < 5").count()
    export_csv(d.limit(3), str(tmp_path / "c"))
    assert all(r.confidence.endswith("%") for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect())
    assert events_json(spark.createDataFrame([(1, None)], "a int, b string")).first().value == '{"a":1,"b":null}'


def test_deletes_and_missing_tables(spark, tmp_path):
    rows = [(1, "2024-01-01", "a", False), (2, "2024-01-01", "b", False), (1, "2024-01-02", "a", True)]
    schema = "id int, ts string, name string, deleted boolean"
    append(spark.createDataFrame(rows, schema), str(tmp_path / "t"))
    assert [(r.id, r.name) for r in deleted(spark, str(tmp_path / "t"), ["id"], ["ts"]).collect()] == [(2, "b")]
    assert read_or_empty(spark, str(tmp_path / "none"), schema).count() == 0
    assert read_or_empty(spark, str(tmp_path / "t"), schema).count() == 3


def test_listings_by_ending(spark, tmp_path):
    import os

    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    for k in range(12):
        f = tmp_path / "a" / "deep" / f"w{k}.{['pt', 'onnx', 'engine'][k % 3]}"
        f.write_bytes(b"w")
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    for name in ("x.PT", "notes.txt", "clip.MP4", "clip.mkv", "mp4"):
        (tmp_path / "b" / name).write_bytes(b"v")
    got = [r.path.rsplit("/", 1)[1] for r in weights(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()]
    assert got == [f"w{k}.{['pt', 'onnx', 'engine'][k % 3]}" for k in range(11, 1, -1)]
    assert sorted(r.path.rsplit("/", 1)[1] for r in videos(spark, [str(tmp_path / "b"), str(tmp_path / "b")]).collect()) == ["clip.MP4", "clip.mkv"]


def test_written_examples(spark, tmp_path):
    rows = [(f"29A{k:05}", ["car", "motorcycle"][k % 2], k % 3 == 0, k % 5, bytes([k])) for k in range(40)]
    df = spark.createDataFrame(rows, "plate string, vehicle_type string, two_lines boolean, variant int, image binary").repartition(5)
    write_examples(df, str(tmp_path / "d"))
    lines = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "d" / "manifest"))
    assert lines.columns == ["image_name", "plate_string", "vehicle_type", "is_2line", "variant_idx"]
    images = {r.name: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "d" / "images")).collect()}
    labels = {r.name: r.label for r in spark.read.parquet(str(tmp_path / "d" / "labels")).collect()}
    assert sorted(images) == [f"{k:06}.jpg" for k in range(40)] and len(labels) == 40
    want = {p: (v, "2line" if t else "1line", str(n), i) for p, v, t, n, i in rows}
    for r in lines.collect():
        stem = r.image_name[:-4]
        assert labels[f"{stem}.txt"] == r.plate_string and want[r.plate_string] == (r.vehicle_type, r.is_2line, r.variant_idx, images[r.image_name])
