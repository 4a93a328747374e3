"""Tables that grow by appended versions, batches stored once, intermediate tables, and exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    """Append rows, in parts by day of ``ts``, so that retention and time filters skip whole folders."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def latest(spark: SparkSession, path: str, key: list[str], version: list[str]) -> DataFrame:
    """The newest version of each key: what an update in place would have left."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(v) for v in version]))
    return spark.read.parquet(path).withColumn("_place", place).where("_place = 1").drop("_place")


def export_csv(df: DataFrame, path: str) -> None:
    """One line a row, quoted, with a header; confidence as a percentage with one decimal."""
    percent = F.format_string("%.1f%%", F.col("confidence") * 100)
    df.withColumn("confidence", percent).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def events_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def deleted(spark: SparkSession, path: str, key: list[str], version: list[str], tombstone: str = "deleted") -> DataFrame:
    """``latest`` without the keys whose newest version is a tombstone: what a delete would have left."""
    return latest(spark, path, key, version).where(~F.coalesce(F.col(tombstone), F.lit(False))).drop(tombstone)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or no rows of ``schema`` where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names: computed once, and safe from lost executors. A
    temporary folder is used where that is unset and Spark runs on one machine; on a cluster it must be set."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/framelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_once(path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch goes to several tables as one. A table's rows lie in a folder of the batch's number, which
    a batch that is run again replaces; the batch counts once its number is in ``_batches``, which comes last. A batch that counts
    is not written again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not read_or_empty(spark, f"{path}/_batches", "number long").where(F.col("number") == number).isEmpty():
            return
        batch.persist()
        try:
            for name, of in tables.items():
                of(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{path}/_batches")
        finally:
            batch.unpersist()

    return write


def stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of a table of ``store_once``, of the batches that count."""
    rows = read_or_empty(spark, f"{path}/{name}", f"{schema}, batch long")
    return rows.join(read_or_empty(spark, f"{path}/_batches", "number long").distinct(), F.col("batch") == F.col("number"), "left_semi").drop("batch")
