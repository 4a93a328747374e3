"""Jaccard self-join of documents on word n-grams by token-combination prefixes.

Tokens are 64-bit hashes of shingles. Documents of equal sets form one class, which its smallest doc_id stands for.

1. Of each set, the 2t+1 tokens of smallest hash are counted over all sets, where t is how many of its tokens a linked
   set may lack. Over t+1 tokens that no other set counts rule out every link, over t where t is 0; most sets end here.
   A linked set may count two tokens fewer, so one more than t can look like own: 10 shingles against 9 of them at 90.
2. The other sets' tokens are ordered by how many of these sets hold them. Tokens up to ``RARE`` index a set by
   themselves, more frequent ones by pairs of the same hash group; the prefix is extended until whatever t tokens a
   linked set lacks, a whole combination remains. Small sets use single tokens throughout.
3. In each combination's group all members are verified against the one whose tokens are the most frequent; what that
   links is one component. Pairs across components follow, all that the place of the first shared key leaves possible.

Documents are told apart by their texts' hashes, not by doc_id, which may be null or stand for several texts: a component's
id is its smallest doc_id, null if it has none. Empty texts and nulls have no tokens, link with nothing and have their own
doc_id as component. Repeated rows belong to one class. Texts of any length are read whole. An empty table gives none;
other columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import WORD, map_batches, table, written
from framelake.llm.components import components

RARE, GROUPS, SMALL = 24, 96, 200
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 250_000
_G = np.random.default_rng(20240229)
_BYTE = _G.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _G.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hash of each word of UTF-8 text, A-Z lower-cased; a word's hash depends on its bytes and their places only."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.flatnonzero(inside)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        x = _BYTE[b[at]] * _LANE[place & 63]
        far = place >> 6
        if far.any():
            x = _mix(x + far.astype(np.uint64))
        x = x ^ (x >> np.uint64(32))
        return _mix(np.add.reduceat(x, firsts) + sizes.astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, as signed 64-bit integers."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        n = max(1, len(w) - width + 1)
        h = np.full(n, np.uint64(len(w) if len(w) < width else width))
        for k in range(min(width, len(w))):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(h).view(np.int64)


def lacking(n, percent: int):
    """How many of n tokens a set may have that a linked one lacks."""
    return n * (100 - percent) // 100


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, node, n, set (128 bits of the sorted tokens, as two longs) and the first 2t+1 tokens."""

    def f(batch: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": batch["doc_id"], "node": batch["node"], "n": [], "s1": [], "s2": [], "head": []}
        for text in batch["text"]:
            t = np.sort(shingles(text, width))
            a, b = np.frombuffer(hashlib.blake2b(t.tobytes(), digest_size=16).digest(), "<i8").tolist()
            out["n"].append(len(t))
            out["s1"].append(a)
            out["s2"].append(b)
            out["head"].append(t[: 2 * lacking(len(t), percent) + 1])
        return out

    return map_batches(docs, f, "doc_id long, node long, n long, s1 long, s2 long, head array<long>", ["doc_id", "node", "text"])


def _tokens(docs: DataFrame, width: int) -> DataFrame:
    def f(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], "tokens": [shingles(t, width) for t in batch["text"]]}

    return map_batches(docs, f, "doc_id long, tokens array<long>", ["doc_id", "text"])


def signatures(count: np.ndarray, token: np.ndarray, n: int, percent: int) -> dict[int, int]:
    """Index keys of a set of n tokens, given how many sets hold each (1 for its own), ordered by count and token.

    Each key comes with the most tokens that the set has in common with another if this is the first key, in this
    order, that both have: all tokens from the key on, and before a pair one for each hash group at most.
    """
    need, out = lacking(n, percent) + 1, {}
    if n * percent < SMALL * 100:  # as small as half of a pair that has a small set
        for k, (c, t) in enumerate(zip(count[:need].tolist(), token[:need].tolist(), strict=True)):
            if c > 1:
                out[t] = n - k
    if n * 100 < SMALL * percent:
        return out
    have, groups = 0, {}
    pairs, tops = [], []
    hashed = (token.astype(np.uint64) % np.uint64(GROUPS)).tolist()
    for k, (c, t, g) in enumerate(zip(count.tolist(), token.tolist(), hashed, strict=True)):
        if have >= need:
            break
        if c <= RARE:
            have += 1
            if c > 1:
                out[t] = n - k
            continue
        others = groups.setdefault(g, [])
        have += len(others) > 0
        for first, top in others:
            pairs.append((first, t))
            tops.append(top)
        others.append((t, n - k + len(groups)))
    if have < need:  # at least n - GROUPS of a set's tokens count, which is enough from 60 percent up
        raise ValueError("the threshold is too low for pairs of tokens")
    if pairs:
        x = np.array(pairs, np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            out.update(zip(_mix(x[:, 0] * np.uint64(0x9E3779B97F4A7C15) + x[:, 1] + np.uint64(1)).view(np.int64).tolist(), tops, strict=True))
    return out


def links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, node, n, s1, s2; classes: s1, s2, rep, members, first; links between representatives: a, b).

    A row's node is its text's hash; the smallest of a class is its rep, and its smallest doc_id is first.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("node"), "text")
    signed = written(_signed(docs, width, percent))
    rows = signed.select("doc_id", "node", "n", "s1", "s2")
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("node").alias("rep"), F.first("n").alias("n"), F.count("*").alias("members"), F.min("doc_id").alias("first"))
    own = (
        signed.where("n > 0").select("s1", F.explode("head").alias("t")).groupBy("t").agg(F.min("s1").alias("s1"), F.max("s1").alias("last"))
        .where("s1 = last").groupBy("s1").agg(F.count("*").alias("own"))
    )
    most = f"n * {100 - percent} div 100 + least(n * {100 - percent} div 100, 1)"
    maybe = written(classes.join(own, "s1", "left").where(F.expr(f"coalesce(own, 0) <= {most}")).select(F.col("rep").alias("doc_id"), "n"))
    few = maybe.count() <= BROADCAST_IDS
    ids = maybe.select("doc_id")
    kept = docs.select(F.col("node").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = written(_tokens(kept.groupBy("doc_id").agg(F.first("text").alias("text")), width))  # one copy of each text
    each = sets.select("doc_id", F.explode("tokens").alias("t"))
    shared = each.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    ordered = each.join(shared, "t").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("x"))
    ordered = written(ordered.join(maybe, "doc_id").where(f"n - size(x) <= n * {100 - percent} div 100").select("doc_id", "n", F.col("x.c").alias("c"), F.col("x.t").alias("t")))

    def f(batch: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": [], "n": [], "rarity": [], "key": [], "top": []}
        for d, n, c, t in zip(*(batch[k] for k in ("doc_id", "n", "c", "t")), strict=True):
            own = n - len(t)
            count = np.array([1] * own + c, np.int64)
            keys = signatures(count, np.array([0] * own + t, np.int64), n, percent)
            for name, x in (("doc_id", d), ("n", n), ("rarity", float((1 / count).sum()))):
                out[name].extend([x] * len(keys))
            out["key"].extend(keys)
            out["top"].extend(keys.values())
        return out

    keys = written(map_batches(ordered, f, "doc_id long, n long, rarity double, key long, top long", ["doc_id", "n", "c", "t"]))
    # the first key that two linked sets share leaves the link possible
    possible = F.expr(f"least(a.top, b.top) * {100 + percent} >= (a.n + b.n) * {percent}")
    hubs = keys.groupBy("key").agg(F.min(F.struct("rarity", "doc_id", "n", "top")).alias("h"), F.count("*").alias("k")).where("k > 1")
    hubs = hubs.select("key", "h.doc_id", "h.n", "h.top")
    stars = keys.alias("a").join(hubs.alias("b"), "key").where(F.col("a.doc_id") != F.col("b.doc_id")).where(possible)
    sure = written(_verified(stars.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct(), ordered, percent))
    found = components(sure)
    several = keys.join(found, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n", "top", F.coalesce("component", "doc_id").alias("component"))
    mixed = several.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    left = written(several.join(mixed, "key"))
    rest = left.alias("a").join(left.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & possible)
    rest = rest.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b")).distinct()
    more = written(_verified(rest, ordered, percent))
    return rows, classes, sure.unionByName(more)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; tokens of one set only are in n but not in t, and in no intersection."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("t").alias("ta"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("t").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("k", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return both.where(F.expr(f"k * 100 >= (na + nb - k) * {percent}")).select("a", "b")


def membership(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, node, n, members (rows of the same set), component (a node of it) and component_id of each row; the last
    three are null without tokens."""
    rows, classes, pairs = links(docs, width, percent)
    named = classes.join(components(pairs), F.col("rep") == F.col("node"), "left").select("s1", "s2", "members", "first", F.coalesce("component", "rep").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(smallest, "component"), ["s1", "s2"], "left").select("doc_id", "node", "n", "members", "component", "component_id")


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and class_size (rows of the same set) of each row of ``docs`` (doc_id, text)."""
    out = membership(docs, width, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("members", F.lit(1)).alias("class_size"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id (null first, then by the text's hash).

    Of rows that repeat a doc_id and its text one stays. Documents without words all stay. No rows give none.
    """
    of = written(membership(docs.select("doc_id", "text"), width, percent).where("n > 0"))
    best = of.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("best"), F.count("*").alias("k")).where("k > 1").drop("k")
    gone = written(of.join(best, "component").where(~F.struct("doc_id", "node").eqNullSafe(F.col("best"))).select(F.struct("doc_id", "node").alias("g")).distinct())
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.struct("doc_id", F.xxhash64("text").alias("node")).alias("g"))
    same = F.expr("d.g.doc_id <=> gone.g.doc_id and d.g.node = gone.g.node")
    kept = d.alias("d").join((F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone).alias("gone"), same, "left_anti")
    if not of.groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        worded = F.col("d.text").isNotNull() & F.col("d.text").rlike(WORD)
        kept = kept.where(worded).dropDuplicates(["g"]).unionByName(kept.where(~worded))
    return kept.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"), 3, 90)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: DuckDB SQL for op9_ngram_jaccard: all pairs that share a shingle, then reachability.
OP9_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS root FROM t UNION SELECT r.doc_id, ways.y FROM r JOIN ways ON r.root = ways.x),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, CASE WHEN n IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY same) END AS class_size
FROM t JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
