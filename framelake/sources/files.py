"""Files as rows: listings, checksums and base64 payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def listed(spark: SparkSession, path: str, pattern: str = "*", limit: int = 50, offset: int = 0) -> DataFrame:
    """path, modificationTime and length, newest first; the limit is held within 1 and 500. Contents aren't read."""
    rows = files(spark, path, pattern).select("path", "modificationTime", "length")
    return rows.orderBy(F.desc("modificationTime"), "path").offset(max(0, offset)).limit(min(max(limit, 1), 500))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and md5 of each file."""
    return files(spark, path, pattern).select("path", "length", F.md5("content").alias("md5"))


def payload(column: str | Column, most: int = 10 << 20) -> Column:
    """Bytes of a base64 text, after any ``data:`` prefix; null if it isn't base64, is empty or is too large."""
    c = F.regexp_replace(F.col(column) if isinstance(column, str) else column, "^data:[^,]*,", "")
    raw = F.try_to_binary(c, F.lit("base64"))
    return F.when(F.octet_length(raw).between(1, most), raw)


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the label of the same file stem; images without one are left out."""

    def stem(c: str) -> Column:
        return F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)

    return images.withColumn("stem", stem("path")).join(labels.select(stem("path").alias("stem"), F.col("path").alias("label_path")), "stem")


#: Endings of weights and of videos.
WEIGHTS, VIDEOS = ("pt", "pth", "onnx", "engine", "trt"), ("mp4", "avi", "mov", "mkv")


def _ending(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def weights(spark: SparkSession, paths: list[str], most: int = 10) -> DataFrame:
    """path and modificationTime of the newest files of weights anywhere under ``paths``."""
    rows = files(spark, paths).select("path", "modificationTime").where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*WEIGHTS))
    return rows.orderBy(F.desc("modificationTime"), "path").limit(most)


def videos(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Each video file right in one of ``paths`` once, whatever the case of its ending."""
    rows = spark.read.format("binaryFile").load([f"{p.rstrip('/')}/*" for p in paths]).select("path")
    return rows.where(_ending().isin(*VIDEOS)).distinct()


def write_examples(df: DataFrame, path: str) -> None:
    """Examples (plate, vehicle_type, two_lines, variant, image) numbered over all: pictures and labels as tables under their
    names, and a manifest of tab-separated lines with a header.

    Numbers are a part's first, from the parts' counts, and the place within it, so that no task sees all rows.
    """
    from framelake.sources.sinks import kept

    rows = kept(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # a row a part
    number = F.lpad((F.col("_before") + F.col("_at") - F.col("_first")).cast("string"), 6, "0")
    rows = rows.join(parts, "_part").withColumn("number", number)
    rows.select(F.concat("number", F.lit(".jpg")).alias("name"), F.col("image").alias("content")).write.mode("overwrite").parquet(f"{path}/images")
    rows.select(F.concat("number", F.lit(".txt")).alias("name"), F.col("plate").alias("label")).write.mode("overwrite").parquet(f"{path}/labels")
    lines = F.when(F.col("two_lines"), "2line").otherwise("1line")
    manifest = rows.select(F.concat("number", F.lit(".jpg")).alias("image_name"), F.col("plate").alias("plate_string"), "vehicle_type", lines.alias("is_2line"), F.col("variant").alias("variant_idx"))
    manifest.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/manifest")
