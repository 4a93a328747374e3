"""Readings out of label probabilities."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.decoding import beams_of, joined
from framelake.plans.registry import query
from framelake.sources.tables import detections

LETTERS, FRAMES = "0159AB", 6
#: Rows whose beams go forward together.
ROWS = 512


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and probs: of each frame, blank and the letters, derived from the event's id."""
    weight = F.transform(
        F.sequence(F.lit(0), F.lit(FRAMES - 1)),
        lambda t: F.transform(F.sequence(F.lit(0), F.lit(len(LETTERS))), lambda c: F.pow(F.pmod(F.col("event_id") * (t * 3 + 7) + c * (t + 5) * 11, F.lit(97)) + 1.0, F.lit(3.0))),
    )
    share = F.transform(weight, lambda row: F.transform(row, lambda x: x / F.aggregate(row, F.lit(0.0), lambda s, y: s + y)))
    return detections(spark, sf_dir).where("class_name <> 'person'").select("event_id", share.alias("probs"))


def decoded(df: DataFrame, letters: str, frames: int, width: int = 10, least: float = 0.25) -> DataFrame:
    """event_id, text and confidence by either rule of repeats, of rows (event_id, probs: frames of blank and letters)."""

    def run(batches):
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            x = b.column(1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, frames, len(letters) + 1)
            columns = [b.column(0)]
            for separated in (False, True):
                found = [own[0] if own else ((), 0.0) for own in beams_of(x, width, least, separated)]
                columns += [pa.array(["".join(letters[k - 1] for k in labels) for labels, _ in found]), pa.array([sure for _, sure in found])]
            yield pa.RecordBatch.from_arrays(columns, names=["event_id", "text", "confidence", "text_separated", "confidence_separated"])

    return df.select("event_id", "probs").mapInArrow(run, "event_id long, text string, confidence double, text_separated string, confidence_separated double")


@query(
    """SELECT event_id, coalesce(j.text, '') AS text, coalesce(j.sure, 1) AS confidence, CASE WHEN lacks THEN '' ELSE coalesce(s.text, '') END AS text_separated, CASE WHEN lacks THEN 0 ELSE least_p END AS confidence_separated
  FROM (SELECT event_id, count(c) < 6 AS lacks, min(p) AS least_p FROM sep GROUP BY event_id) e LEFT JOIN j USING (event_id) LEFT JOIN s USING (event_id)""",
    """w AS (SELECT event_id, t, c, CAST(((event_id * (t * 3 + 7) + c * (t + 5) * 11) % 97 + 1) AS DOUBLE) ** 3 AS x FROM det, range(6) a(t), range(7) b(c) WHERE class_name <> 'person'),
  p AS (SELECT event_id, t, c, x / sum(x) OVER (PARTITION BY event_id, t) AS p FROM w),
  fr AS (SELECT DISTINCT event_id, t FROM p),
  best AS (SELECT event_id, t, c, p FROM p WHERE p >= 0.25 OR c = 0 QUALIFY row_number() OVER (PARTITION BY event_id, t ORDER BY p DESC, c) = 1),
  run AS (SELECT *, lag(c) OVER (PARTITION BY event_id ORDER BY t) AS before FROM best WHERE c > 0),
  j AS (SELECT event_id, string_agg(substr('0159AB', CAST(c AS INT), 1), '' ORDER BY t) AS text, min(p) AS sure FROM run WHERE before IS NULL OR before <> c GROUP BY event_id),
  own AS (SELECT event_id, t, c, p FROM p WHERE p >= 0.25 QUALIFY row_number() OVER (PARTITION BY event_id, t ORDER BY p DESC, c) = 1),
  sep AS (SELECT event_id, t, c, p, lag(c) OVER (PARTITION BY event_id ORDER BY t) AS before FROM fr LEFT JOIN own USING (event_id, t)),
  s AS (SELECT event_id, string_agg(substr('0159AB', CAST(c AS INT), 1), '' ORDER BY t) AS text FROM sep WHERE c > 0 AND (before IS NULL OR before <> c) GROUP BY event_id)""",
)
def sf27_beam_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best paths of a beam; as each frame's choice is free, the SQL takes each frame's best. Tested by trying all paths too."""
    return decoded(probabilities(spark, sf_dir), LETTERS, FRAMES)


UPPER_LETTERS, LOWER_LETTERS = "2915AB8", "012345"


def two_heads(df: DataFrame, upper: str, lower: str, width: int = 10, least: float = 0.25, best: int = 3) -> DataFrame:
    """event_id, place (from 1), upper, lower and confidence of the best pairs of both heads' beams, of rows (event_id, upper,
    lower: frames of blank and letters)."""

    def run(batches):
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            lines = []
            for column, letters in ((b.column(1), upper), (b.column(2), lower)):
                x = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1, len(letters) + 1)
                lines.append([[("".join(letters[c - 1] for c in labels), sure) for labels, sure in own] for own in beams_of(x, width, least)])
            out = [(event, n, *pair) for event, a, c in zip(b.column(0).to_pylist(), *lines, strict=True) for n, pair in enumerate(joined(a, c, best), 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["event_id", "place", "upper", "lower", "confidence"])

    return df.select("event_id", "upper", "lower").mapInArrow(run, "event_id long, place long, upper string, lower string, confidence double")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, upper and lower: probabilities by frame of two heads, derived from the event's id."""

    def probs(letters: str, frames: int, seed: int):
        weight = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(len(letters))), lambda c: F.pow(F.pmod(F.col("event_id") * (t * 5 + seed) + c * (t + 3) * seed, F.lit(89)) + 1.0, F.lit(4.0))))
        return F.transform(weight, lambda row: F.transform(row, lambda x: x / F.aggregate(row, F.lit(0.0), lambda s, y: s + y)))

    return detections(spark, sf_dir).where("class_name <> 'person'").select("event_id", probs(UPPER_LETTERS, 4, 13).alias("upper"), probs(LOWER_LETTERS, 5, 17).alias("lower"))


@query()
def sf28_two_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by trying all pairs."""
    return two_heads(heads(spark, sf_dir), UPPER_LETTERS, LOWER_LETTERS)
