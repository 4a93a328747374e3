"""Mixing sources to target weights: blocks of fixed length, multinomial draws per shard, pseudorandom permutations.

A document's size is its number of words. Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share
the words of all sources; a target stops at ``MOST`` times its source's words and the excess is shared again by weight.

Each source's words, in an order of hashed doc_ids and texts, form blocks of ``BLOCK`` words (the last one may be shorter), and its
target over the mean words of its blocks is its goal of slots. An output shard has a fixed number of slots; a multinomial
draw gives each source its count of them. A source's slots, numbered over all shards, go through the permutation of its
block numbers that belongs to their round (slot div blocks); in a round each block is taken once. Slots beyond its goal
don't count, and one more shard draws what sources still lack, so that what is taken strays from a target by less than
two blocks. Slots and blocks meet in a join on (source, block).

Documents without words, and null texts, are taken 0 times. Rows that repeat a doc_id, and rows with a null doc_id, are
documents of their own; equal rows are told apart by an arbitrary number. Texts of any length are taken from whole. An
empty table gives none; other columns, whatever their names, are kept by the stage and ignored by the query. Reruns agree:
draws are seeded by shard. Only one row a source comes to the driver, never a document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import WORD, table, with_sizes, written

BLOCK, MOST, SHARD_SLOTS = 64, 3, 1 << 14
#: Sources whose targets are worked out on the driver.
SOURCES = 100_000
word_spans = re.compile(WORD).finditer


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size."""
    out, free, rest = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: Feistel rounds over an even number of bits, walked until they land below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for k in range(4):
                h = (right + np.uint64((key * 4 + k + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
            x[todo] = left << np.uint64(half) | right
            todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def goals(sizes: list[int], aims: list[float]) -> list[int]:
    """Slots of each source: its target over the mean words of its blocks, to the nearest; MOST times its blocks at most."""
    blocks = [-(-s // BLOCK) for s in sizes]
    return [min(MOST * b, int(t * b / s + 0.5)) if s else 0 for s, t, b in zip(sizes, aims, blocks, strict=True)]


def drawn_counts(goal: np.ndarray, shard: int, seed: int) -> np.ndarray:
    """The multinomial draw of a shard: how many of its slots each source has."""
    slots = int(goal.sum())
    return np.random.default_rng([seed, shard]).multinomial(min(SHARD_SLOTS, slots - shard * SHARD_SLOTS), goal / slots)


def blocks_of_slots(slot: np.ndarray, blocks: int, key: int) -> np.ndarray:
    """The block of each of a source's slots: each round of ``blocks`` slots has a permutation of its own."""
    out = np.zeros(len(slot), np.int64)
    for turn in np.unique(slot // blocks):
        own = slot // blocks == turn
        out[own] = feistel(slot[own] % blocks, blocks, key * 8 + int(turn))
    return out


def _slots(spark: SparkSession, sources: DataFrame, goal: list[int], seed: int) -> DataFrame:
    """source and block of every slot. sources: source (its number), blocks and goal, one row a source.

    Draws that go beyond a source's goal don't count; what sources lack after all shards is the draw of one more shard.
    """
    p = np.array(goal, np.int64)

    def draw(batches):
        for b in batches:
            rows = [(int(k), int(i), int(c[i])) for k in b.column(0).to_numpy() for c in (drawn_counts(p, int(k), seed),) for i in np.flatnonzero(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["shard", "source", "n"])

    slots = int(p.sum())
    shards = -(-slots // SHARD_SLOTS)
    drawn = written(spark.range(0, shards, 1, min(max(1, shards // 8), 2000)).mapInArrow(draw, "shard long, source long, n long").withColumn("chunk", F.expr("shard div 1024")))
    # running sums in two steps, so that no source has all its shards in one task
    sums = drawn.groupBy("source", "chunk").agg(F.sum("n").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("source").orderBy("chunk")) - F.col("sum")).drop("sum")
    within = F.sum("n").over(Window.partitionBy("source", "chunk").orderBy("shard")) - F.col("n")
    placed = drawn.withColumn("within", within).join(before, ["source", "chunk"]).select("source", (F.col("before") + F.col("within")).alias("first"), "n")
    lacks = sources.join(sums.groupBy("source").agg(F.sum("sum").alias("got")), "source", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    lacks = lacks.where("goal > got").select("source", F.explode(F.expr(f"sequence(got, goal - 1, {SHARD_SLOTS})")).alias("first")).withColumn("n", F.lit(SHARD_SLOTS).cast("long"))
    placed = placed.unionByName(lacks).join(F.broadcast(sources), "source").withColumn("n", F.least("n", F.col("goal") - F.col("first"))).where("n > 0")

    def place(batches):
        for b in batches:
            for source, blocks, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = blocks_of_slots(np.arange(first, first + n), blocks, source + seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, source)), pa.array(block)], names=["source", "block"])

    # a row stands for thousands of slots: by slots, not by rows, are they dealt
    placed = placed.select("source", "blocks", "first", "n").repartition(max(spark.sparkContext.defaultParallelism, slots >> 18))
    return placed.mapInArrow(place, "source long, block long")


def spans(docs: DataFrame, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, name, digest, copy, size, source, at, source_size, target; takes: source, block, times).

    ``at`` is the number of words before the document in its source; digest and copy tell rows of one doc_id apart.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").alias("name"), F.xxhash64("text").alias("digest"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = written(rows)
    totals = rows.groupBy("name").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    totals.sort(key=lambda r: (r.name is None, r.name or ""))
    aims = targets([r.size for r in totals], [i % 3 + 1 for i in range(len(totals))])
    goal = goals([r.size for r in totals], aims)
    schema = "name string, source long, source_size long, target double, blocks long, goal long"
    sources = F.broadcast(spark.createDataFrame([(r.name, i, r.size, aims[i], -(-r.size // BLOCK), goal[i]) for i, r in enumerate(totals)], schema))  # at most SOURCES rows
    parts = max(64, rows.count() // 20_000)
    named = rows.join(sources, rows.name.eqNullSafe(sources.name)).drop(sources.name)
    named = named.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)))
    sums = named.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("source").orderBy("part")) - F.col("sum")).drop("sum")
    order = Window.partitionBy("source", "part").orderBy("doc_id", "digest", "size")
    same = Window.partitionBy("source", "part", "doc_id", "digest").orderBy("size")
    out = named.withColumn("copy", F.row_number().over(same)).withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    out = written(out.join(before, ["source", "part"]).withColumn("at", F.col("before") + F.col("within")).drop("part", "before", "within", "blocks", "goal"))
    if not sum(goal):
        return out, spark.createDataFrame([], "source long, block long, times long")
    slots = _slots(spark, sources.select("source", "blocks", "goal").where("goal > 0"), goal, seed)
    return out, slots.groupBy("source", "block").agg(F.count("*").alias("times"))


def overlaps(rows: DataFrame, takes: DataFrame) -> DataFrame:
    """Each row of spans() with each of its blocks (null if it has no words): block, first and last word in the document, times taken."""
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {BLOCK}"), F.expr(f"(at + size - 1) div {BLOCK}")))
    each = rows.withColumn("block", F.explode_outer(blocks))
    first = F.greatest(F.col("block") * BLOCK - F.col("at"), F.lit(0))
    last = F.least((F.col("block") + 1) * BLOCK - F.col("at"), F.col("size"))
    return each.withColumn("first", first).withColumn("last", last).join(takes, ["source", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mixed(docs: DataFrame, seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of ``docs`` (doc_id, text, source)."""
    rows, takes = spans(docs, seed)
    taken = F.coalesce(F.sum(F.col("times") * (F.col("last") - F.col("first"))), F.lit(0)).alias("taken")
    by = overlaps(rows, takes).groupBy("source", "at", "doc_id", "digest", "copy", "size", "source_size", "target").agg(taken)
    return by.select("doc_id", "size", "source_size", "target", "taken")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: for each round that takes any of its blocks, a row with the words that the round takes.

    White space inside what is taken stays. Documents that the mix doesn't take are left out.
    """
    rows, takes = spans(docs)
    piece = F.struct("first", "last", "times")
    lists = overlaps(rows, takes).where("times > 0").groupBy("doc_id", "name", "digest", "copy").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    same = Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy(F.lit(1))
    own = docs.withColumn("_copy", F.row_number().over(same)).withColumn("_digest", F.xxhash64("text"))
    on = own.doc_id.eqNullSafe(lists.doc_id) & own.source.eqNullSafe(lists.name) & (own._digest == lists.digest) & (own._copy == lists["copy"])
    both = own.join(lists, on).select(*[own[c] for c in docs.columns], "pieces")
    at = docs.columns.index("text")
    names = docs.columns

    def cut(batches):
        for b in batches:
            out, keep = [], []
            for k, (text, pieces) in enumerate(zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)):
                places = [m.span() for m in word_spans(text)]
                for turn in range(1, MOST + 1):
                    some = [text[places[p["first"]][0] : places[p["last"] - 1][1]] for p in pieces if p["times"] >= turn]
                    if some:
                        out.append(" ".join(some))
                        keep.append(k)
            taken = b.take(pa.array(keep, pa.int64()))
            columns = [taken.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = with_sizes(both).mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
