"""The trie of rebuilt conversations, as balanced parentheses per shard.

Turns are numbered over range parts by (conv_id, turn), so that no conversation needs one task. Each conversation gives up its
first h turns for those of its family's first one. The rebuilt ones become paths of 128-bit turn hashes; equal paths fall
together, and the different ones are dealt by range in their order, so that a shard holds a run of the trie's leaves.

A shard writes its part of the trie as balanced parentheses. ``Parens`` finds the closing parenthesis of a node by blocks of
least excess; a node's subtree lies between both. Counts of leaf pairs and cumulative sums of conversations and of bytes, at
both ends, give the subtree's figures. What shards share is the path down to the common prefix of neighbours: those spines
carry keys of their own and merge by sums, since each shard counts only what did not occur in the one before.

Turns are ordered by turn (null first), then role and text. A null role or text is empty. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. Texts may be long: only their hashes and sizes go on. A
path, with 24 bytes a turn, is one row. An empty table has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import table, with_sizes, written

#: Conversations of a family lend their first turns; how many varies by conversation below LENT.
FAMILY, LENT, BLOCK = 5, 9, 64
NONE = hashlib.sha256(b"").hexdigest()
_FIGURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")


class Parens:
    """Balanced parentheses (1 opens) with the least excess of blocks, of pairs of blocks, and so on."""

    def __init__(self, opens: np.ndarray):
        self.excess = np.cumsum(np.where(opens, 1, -1))
        far, blocks = np.iinfo(np.int64).max, -(-len(opens) // BLOCK)
        rows = np.full(blocks * BLOCK, far)
        rows[: len(opens)] = self.excess
        self.least = [rows.reshape(-1, BLOCK).min(1)]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            self.least.append(np.append(low, [far] * (len(low) % 2)).reshape(-1, 2).min(1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at ``at`` close: the first place after with one less excess."""
        goal, out = self.excess[at] - 1, np.full(len(at), -1)

        def scan(own: np.ndarray, pos: np.ndarray) -> np.ndarray:
            """Go on from ``pos`` to the ends of their blocks; those that have not met their goal."""
            ends = np.minimum((pos // BLOCK + 1) * BLOCK, len(self.excess))
            while (live := pos < ends).any():
                own, pos, ends = own[live], pos[live], ends[live]
                hit = self.excess[pos] == goal[own]
                out[own[hit]] = pos[hit]
                own, pos, ends = own[~hit], pos[~hit] + 1, ends[~hit]
            return np.flatnonzero(out < 0)

        inside = (at + 1) % BLOCK > 0  # else the next place begins another block
        scan(np.flatnonzero(inside), at[inside] + 1)
        own = np.flatnonzero(out < 0)
        node, found = at[own] // BLOCK + 1, []
        for level, low in enumerate(self.least):  # up: a right one is looked at, a left one is part of what lies above
            right = node % 2 == 1
            hit = right & (low[node] <= goal[own])
            found.append((level, own[hit], node[hit]))
            own, node = own[~hit], (node[~hit] + right[~hit]) // 2
        for level, own, node in found:  # down: to the first block that reaches the goal
            for low in reversed(self.least[:level]):
                node = 2 * node + (low[2 * node] > goal[own])
            scan(own, node * BLOCK)
        return out


def shared_turns(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero((a[:n] != b[:n]).any(1))
    return int(differ[0]) if len(differ) else n


def _key(path: np.ndarray, depth: int) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(path[:depth]).tobytes(), digest_size=16).digest()


def nodes(paths: list[np.ndarray], sizes: list[np.ndarray], n: np.ndarray, low: np.ndarray, left: int, right: int) -> dict[str, np.ndarray | list]:
    """The nodes of a shard in preorder, from its different paths (turns x 2 hashes) in order, how many conversations have each
    and the smallest. left, right: turns that the first and last path share with those of the next shards, -1 without one."""
    lengths = np.array([len(p) for p in paths])
    common = np.array([0, *(shared_turns(a, b) for a, b in pairwise(paths))])
    opened, closed = lengths - common, np.append(0, lengths[:-1]) - common
    closed[0] = 0
    runs = np.concatenate([[1], np.stack([closed, opened], 1).reshape(-1), [lengths[-1] + 1]])
    opens = np.repeat(np.append(1, np.tile([0, 1], len(paths) + 1))[: len(runs)], runs).astype(bool)
    at = np.flatnonzero(opens)
    close = Parens(opens).findclose(at)
    span = (close - at + 1) // 2
    ends = np.cumsum(opened)
    depth, size, parent, line = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), -1), np.zeros(lengths.max() + 1, np.int64)
    for c, m, last, own in zip(common.tolist(), lengths.tolist(), ends.tolist(), sizes, strict=True):
        new = np.arange(last - (m - c) + 1, last + 1)
        line[c + 1 : m + 1] = new
        depth[new], size[new], parent[new] = np.arange(c + 1, m + 1), own[c:m], line[c:m]
    # both ends of a subtree in cumulative arrays; only what the shard before lacks counts as new
    total = lambda x: (lambda s: s[np.arange(len(at)) + span] - s[: len(at)])(np.append(0, np.cumsum(x)))
    fresh, here = np.arange(len(at)) > left, np.zeros(len(at), np.int64)
    here[ends] = n
    convs = total(here)
    leaf = opens[:-1] & ~opens[1:]
    if right == lengths[-1]:
        leaf[at[ends[-1]]] = False  # the next shard goes on from it
    rank = np.append(0, np.cumsum(leaf))
    smallest = np.full(len(at), np.iinfo(np.int64).max)
    smallest[ends] = low
    up, least = parent.tolist(), smallest.tolist()
    for v in range(len(at) - 1, 0, -1):
        if least[v] < least[up[v]]:
            least[up[v]] = least[v]
    shared = np.zeros(len(at), bool)
    shared[: left + 1] = True
    shared[line[: right + 1]] = True
    keys = {v: _key(p, d) for p, spine in ((paths[0], range(left + 1)), (paths[-1], line[: right + 1].tolist())) for d, v in enumerate(spine)}
    children = np.bincount(parent[1:][fresh[1:]], minlength=len(at))
    return {
        "key": [keys.get(v) for v in range(len(at))], "parent_key": [keys.get(v) for v in up], "depth": depth, "conv_id": least,
        "parent_conv_id": [None if v < 0 or shared[v] else least[v] for v in up], "n_convs": convs, "n_children": children,
        "n_leaves": rank[np.minimum(close, len(rank) - 1)] - rank[at], "saved_tokens": total(convs * size - fresh * size), "end": ends,
    }


def rebuilt(talks: DataFrame) -> DataFrame:
    """conv_id, path (two hashes a turn) and sizes (bytes a turn) of each rebuilt conversation."""
    parts = int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = F.lit("")
    rows = talks.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    dealt = rows.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    turn = F.struct(F.monotonically_increasing_id().alias("at"), F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.octet_length("text").cast("long").alias("size"))
    whole = written(dealt.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int")
    lent = whole.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, LENT - 1).alias("lent"))
    own = whole.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(lent, "base", "left")
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    both = own.select("conv_id", F.when(F.col("lent").isNull(), tail).otherwise(F.concat(F.slice("lent", F.lit(1), F.col("h")), tail)).alias("t"))
    return both.select("conv_id", F.flatten(F.transform("t", lambda x: F.array(x.a, x.b))).alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def hashed_members(paths: DataFrame) -> DataFrame:
    """k1, k2 and ends_sha256: of the sorted conv_ids of each path. Lists are made in pieces all over; a hash runs over the pieces in order."""
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["k1", "k2", "first", "ids"]

    def runs(columns: list[np.ndarray]) -> np.ndarray:
        new = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
        return np.append(np.flatnonzero(new), len(columns[0]))

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k1, k2, own = (c.to_numpy() for c in b.columns)
                at = runs([k1, k2])
                text = [",".join(map(str, own[i:j].tolist())) for i, j in pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(k1[at[:-1]]), pa.array(k2[at[:-1]]), pa.array(own[at[:-1]]), pa.array(text)], names=names)

    def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        row = lambda: [*key, state.hexdigest()]
        for b in batches:
            out = []
            for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if key == (k1, k2):
                    state.update(b",")
                else:
                    out += [row()] if key else []
                    key, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row()], names=["k1", "k2", "ends_sha256"])

    own = paths.select("k1", "k2", "conv_id").repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = with_sizes(own, 20_000).mapInArrow(listed, "k1 long, k2 long, first long, ids string")
    return pieces.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digested, "k1 long, k2 long, ends_sha256 string")


def _shared(a: str, b: str) -> Column:
    """Turns that two different paths share at their start; -1 if one is null."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.floor((F.array_position(differ, True) - 1) / 2), F.lit(-1)).cast("int")


def tried(talks: DataFrame) -> DataFrame:
    """A row per node of the trie."""
    spark = talks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = written(rebuilt(talks).withColumns({"k1": F.xxhash64(F.lit(1), "path"), "k2": F.xxhash64(F.lit(2), "path")}))
    different = paths.groupBy("k1", "k2").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    different = different.join(hashed_members(paths), ["k1", "k2"]).drop("k1", "k2")
    dealt = different.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("shard", F.shiftright("at", 33).cast("int")))
    end = lambda f: f(F.struct("at", "path"))["path"]
    borders = dealt.groupBy("shard").agg(end(F.min).alias("first"), end(F.max).alias("last"))
    by = Window.orderBy("shard")  # a row a shard
    borders = borders.withColumns({"earlier": F.lag("last").over(by), "later": F.lead("first").over(by)})
    borders = borders.select("shard", _shared("earlier", "first").alias("left"), _shared("last", "later").alias("right"))
    # three numbers a shard, and no more shards than shuffle partitions
    own = dealt.join(F.broadcast(borders), "shard").repartition(parts, "shard").sortWithinPartitions("shard", "at")
    schema = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list) -> Iterator[pa.RecordBatch]:
            flat, sizes, n, low, sha, (left, *_), (right, *_) = zip(*rows, strict=True)
            got = nodes([p.reshape(-1, 2) for p in flat], sizes, np.array(n), np.array(low), left, right)
            ends = [None] * len(got["depth"])
            for v, x in zip(got.pop("end").tolist(), sha, strict=True):
                ends[v] = x
            table = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*got.values(), ends], types, strict=True)], names=names)
            for k in range(0, table.num_rows, 10_000):
                yield table.slice(k, 10_000)

        shard, rows = None, []
        for b in batches:
            lists = [[c.values.to_numpy()[i:j] for i, j in pairwise(c.offsets.to_pylist())] for c in (b.column("path"), b.column("sizes"))]
            rest = [b.column(c).to_pylist() for c in ("shard", "n", "low", "ends_sha256", "left", "right")]
            for path, sizes, of, *more in zip(*lists, *rest, strict=True):
                if of != shard and rows:
                    yield from result(rows)
                    rows = []
                shard = of
                rows.append((path, sizes, *more))
        if rows:
            yield from result(rows)

    parted = written(with_sizes(own.select("shard", "path", "sizes", "n", "low", "ends_sha256", "left", "right"), 5000).mapInArrow(run, schema))
    sums = [F.sum(c).alias(c) for c in _FIGURES]
    one = [F.max(c).alias(c) for c in ("parent_key", "depth", "ends_sha256")]
    spines = written(parted.where("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *one, *sums))
    above = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    out = ["conv_id", "depth", "parent_conv_id", *_FIGURES, "ends_sha256", "parent_key"]
    rows = parted.where("key is null").select(*out).unionByName(spines.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out))
    under = rows.where("parent_key is not null").join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    both = rows.where("parent_key is null").select(*out[:-1]).unionByName(under.select(*out[:-1]))
    return both.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tried(table(spark, sf_dir, "conversations"))
