"""What each filter removes in every order of filters: counts by part, order and step.

Each document gets a mask of the filters it fails. Documents are counted by part and mask, and each such cell folds across the
array of all orders, which makes a weighted struct for each order and step; the cells of a part merge by elementwise sums.
After the masks nothing depends on the number of documents: a part has 32 cells at most.

Null texts are empty: without words they fail A only (and E after an equal text). A text is a repeat if a smaller doc_id has an
equal one (by its 128-bit digest) anywhere in the table; a null doc_id is neither smaller nor larger than others, so that its row
is no repeat and makes none, and rows that share doc_id and text are no repeats of each other. A document with several labels
has quality or toxic 1 if one of them has. An empty table gives no parts and no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import table, written

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, MARKS = 100, 80, 10, "[#$%&*|]"
_STEPS = "array<struct<f:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"


def failures(text: Column) -> list[Column]:
    """Does the text fail A, B, C, D?"""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct, upper = F.size(words), F.size(F.array_distinct(words)), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * F.length(text), text.rlike(MARKS)]


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit k: fails filter k) of each document."""
    text = F.coalesce("text", F.lit(""))
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(failures(text))), F.lit(0))
    own = written(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("same"), mask.alias("mask")))
    # an equal text's rows meet under their own ids, so that no group of copies comes together
    first = own.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeat = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return own.join(first, ["same", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + repeat.cast("int") * 16).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents: n, good and toxic."""
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return masked(docs).join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def folded(orders: Column) -> Column:
    """A struct for each order and step: of a cell (mask, n, good, toxic), how it fares at that step's filter."""
    mask, n, good, toxic = (F.col(c) for c in ("mask", "n", "good", "toxic"))

    def step(seen: Column, f: Column) -> Column:
        fails, before = mask.bitwiseAND(f) != 0, mask.bitwiseAND(seen) != 0
        when = lambda c, v: F.when(c, v).otherwise(F.lit(0).cast("bigint"))
        own = [when(~fails & ~before, n), when(fails & ~before, n), when(fails & before, n), when(mask == f, n), when(fails & ~before, good), when(fails & ~before, toxic)]
        return F.array(F.struct(f.alias("f"), *(v.alias(c) for v, c in zip(own, COUNTS, strict=True))))

    start = F.struct(F.lit(0).alias("seen"), F.array().cast(_STEPS).alias("steps"))
    walk = lambda acc, f: F.struct(acc.seen.bitwiseOR(f).alias("seen"), F.concat(acc.steps, step(acc.seen, f)).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, walk, lambda acc: acc.steps)))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step."""
    orders = ["".join(o) for o in permutations(FILTERS)]
    bits = F.lit([[1 << FILTERS.index(f) for f in o] for o in orders])
    names = F.lit([o for o in orders for _ in FILTERS])
    plus = lambda a, b: F.struct(a.f.alias("f"), *((a[c] + b[c]).alias(c) for c in COUNTS))
    of_part = F.collect_list("steps")  # 32 cells at most
    merged = F.aggregate(F.slice(of_part, 2, 31), of_part[0], lambda acc, x: F.zip_with(acc, x, plus))
    parts = cells(docs, labels).select("part", folded(bits).alias("steps")).groupBy("part").agg(merged.alias("steps"))
    removed = lambda f: F.aggregate("steps", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x.f == f, x.removed).otherwise(0))
    value = F.create_map(*(x for k in range(len(FILTERS)) for x in (F.lit(1 << k), removed(1 << k))))
    out = parts.select("part", value.alias("value"), F.posexplode("steps").alias("at", "s"))
    return out.select("part", names[F.col("at")].alias("filter_order"), (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"), *(F.col(f"s.{c}").alias(c) for c in COUNTS), F.col("value")[F.col("s.f")].alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: DuckDB SQL for op12_filter_audit: each document's failures, joined with every order and step.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM t JOIN g USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
bad AS (SELECT part, n, good, toxic, concat(CASE WHEN fails.A THEN 'A' ELSE '' END, CASE WHEN fails.B THEN 'B' ELSE '' END, CASE WHEN fails.C THEN 'C' ELSE '' END, CASE WHEN fails.D THEN 'D' ELSE '' END, CASE WHEN fails.E THEN 'E' ELSE '' END) AS letters FROM c),
r AS (SELECT part, filter_order, step, n, good, toxic, letters, contains(letters, substr(filter_order, step::int, 1)) AS here,
    letters <> translate(letters, substr(filter_order, 1, step::int - 1), '') AS before FROM bad CROSS JOIN s),
q AS (SELECT part, filter_order, step::int AS step, sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END)::bigint AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END)::bigint AS removed,
    sum(CASE WHEN here AND before THEN n ELSE 0 END)::bigint AS redundant, sum(CASE WHEN letters = substr(filter_order, step::int, 1) THEN n ELSE 0 END)::bigint AS unique_fails,
    sum(CASE WHEN here AND NOT before THEN good ELSE 0 END)::bigint AS good_lost, sum(CASE WHEN here AND NOT before THEN toxic ELSE 0 END)::bigint AS toxic_lost FROM r GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::bigint AS shapley FROM q
"""
