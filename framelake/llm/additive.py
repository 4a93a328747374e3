"""Nearest neighbours by additive quantisation: a vector is near a sum of one codeword from each of full-width codebooks.

Codebooks are fitted on the driver on half of at most ``SAMPLE`` vectors, those of smallest hashed id: k-means on residuals,
then turns of beam-search encoding and least squares for all codewords at once. Every vector is encoded by beam search
and stored as its codes, the squared norm of the sum they stand for, and a hash of its values. A query's score is
looked up: that norm less twice the inner products of the query with the codewords, from one table per query.

The other half of the sample, which the fit has not seen, says how deep a search must go: the share of rows that held ``SURE``
of the nearest by score. A query's limit is its score at that share of this half, so that about so many of all rows, wherever
they lie, are reranked by exact distance, with the vectors that the codes bring along. The queries go to all tasks together, a
pass for so many as ``BROADCAST_BYTES`` hold; a pass reads the index once.

Vectors that are null, zero, of another length than the sample's first, or hold null or non-finite components take no
part; nor do rows with a null id. Of vectors that are equal, only as many as a result can hold compete for a query's places in a part, those of
smallest id, which loses no result. Rows that repeat an id are candidates of their own. Fewer candidates than asked
for give all of them. An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import table, with_sizes, written

BOOKS, WORDS, BEAM, SAMPLE, TURNS = 12, 256, 8, 16384, 4
#: Vectors a codeword is fitted on at least; fewer words, where the sample is small.
PER_WORD = 8
TOP, ROWS, SURE = 10, 1 << 13, 0.98
#: Bytes of queries that one pass sends to all tasks, through the driver.
BROADCAST_BYTES = 32 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine & F.exists("v", lambda x: x != 0)).where(F.col("vec_id").isNotNull())


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) by beam search over all codebooks in turn, and the squared norm of each sum."""
    m, k, _ = books.shape
    flat = books.reshape(m * k, -1)
    cross = (flat @ flat.T).reshape(m, k, m, k)
    own = np.einsum("mkd,mkd->mk", books, books)
    dots = (x @ flat.T).reshape(len(x), m, k)
    codes = np.zeros((len(x), 1, m), np.int64)
    cost = np.zeros((len(x), 1))  # squared distance to the vector, less the vector's own norm
    rows = np.arange(len(x))[:, None]
    for j in range(m):
        step = (own[j] - 2 * dots[:, j])[:, None, :] + cost[:, :, None]
        for i in range(j):
            step = step + 2 * cross[i, :, j, :][codes[:, :, i]]
        step = step.reshape(len(x), -1)
        n = min(beam, step.shape[1])
        best = np.argpartition(step, n - 1, axis=1)[:, :n]
        cost = step[rows, best]
        codes = codes[rows, best // k]
        codes[:, :, j] = best % k
    pick = cost.argmin(1)
    codes = codes[np.arange(len(x)), pick]
    total = books[np.arange(m), codes].sum(1)
    return codes, np.einsum("nd,nd->n", total, total)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    g, (n, d) = np.random.default_rng(seed), x.shape
    words = max(1, min(words, n // PER_WORD))
    out, rest = np.zeros((books, words, d)), x.copy()
    for j in range(books):
        c = rest[g.choice(n, words, replace=False)]
        for _ in range(6):
            at = ((c * c).sum(1) - 2 * rest @ c.T).argmin(1)
            size = np.bincount(at, minlength=words)
            order = np.argsort(at, kind="stable")
            has = np.flatnonzero(size)
            c[has] = np.add.reduceat(rest[order], (np.cumsum(size) - size)[has], axis=0) / size[has, None]
        out[j] = c
        rest = rest - c[((c * c).sum(1) - 2 * rest @ c.T).argmin(1)]
    for _ in range(TURNS):
        codes = np.concatenate([encode(x[k : k + 1024], out)[0] for k in range(0, n, 1024)]) + np.arange(books) * words
        gram = np.zeros((books * words,) * 2)
        for i in range(books):
            for j in range(books):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1)
        right = np.zeros((books * words, d))
        for i in range(books):
            np.add.at(right, codes[:, i], x)
        gram[np.diag_indices(books * words)] += 0.1
        out = np.linalg.solve(gram, right + 0.1 * out.reshape(-1, d)).reshape(out.shape)
    return out


def depth(x: np.ndarray, codes: np.ndarray, norm: np.ndarray, books: np.ndarray, top: int = TOP, sure: float = SURE) -> float:
    """The share of the rows of ``x``, by score, that holds ``sure`` of the ``top`` nearest; over up to 256 of them as queries."""
    places = []
    for q in range(0, len(x), max(1, len(x) // 256)):
        away = ((x - x[q]) ** 2).sum(1)
        away[q] = np.inf
        place = np.empty(len(x), np.int64)
        place[np.argsort(scored(x[q], codes, norm, books), kind="stable")] = np.arange(len(x))
        places.append(place[np.argsort(away, kind="stable")[: min(top, len(x) - 1)]])
    return float(np.quantile(np.concatenate(places), sure) + 1) / len(x) if len(x) > 1 else 1.0


def scored(q: np.ndarray, codes: np.ndarray, norm: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of a query to the sums that codes stand for, less its own norm, by its tables."""
    s = norm.copy()
    for t, c in zip(-2 * books @ q, codes.T, strict=True):
        s += t[c]
    return s


def encoded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(x):
        return np.zeros((0, len(books)), np.uint8), np.zeros(0)
    codes, norm = (np.concatenate(p) for p in zip(*(encode(x[k : k + 512], books) for k in range(0, len(x), 512)), strict=True))
    return codes.astype(np.uint8), norm


def _column(batch: pa.RecordBatch, k: int, width: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def indexed(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code (binary), norm, same (a hash of the vector) and v (its doubles, binary) of each vector."""
    shared, width = vectors.sparkSession.sparkContext.broadcast(books), books.shape[2]

    def run(batches):
        for b in batches:
            x = _column(b, 1, width)
            codes, norm = encoded(x, shared.value)
            columns = [b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), b.column(2), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "code", "norm", "same", "v"])

    return with_sizes(vectors.select("vec_id", "v", F.xxhash64("v").alias("same")), ROWS).mapInArrow(run, "vec_id long, code binary, norm double, same long, v binary")


class Search:
    """What a pass sends to all tasks: codebooks, queries, and each query's limit."""

    def __init__(self, books: np.ndarray, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, top: int):
        self.books, self.ids, self.queries, self.limits, self.top = books, ids, queries, limits, top

    def run(self, batches):
        """query_id, vec_id and score: of each batch of the index, the nearest of those that each query's limit leaves."""
        m, width, top = len(self.books), self.books.shape[2], self.top
        for b in batches:
            ids, same = b.column(0).to_numpy(), b.column(3).to_numpy()
            if not len(ids):
                continue
            order = np.lexsort((ids, same))
            heads = np.flatnonzero(np.diff(same[order], prepend=~same[order][0]) != 0)
            place = np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order)))
            keep = np.sort(order[place <= top])  # of equal vectors, a result and the query itself hold no more
            codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, m)[keep]
            x = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float64).reshape(-1, width)[keep]
            ids, norm, out = ids[keep], b.column(2).to_numpy()[keep], []
            for who, q, limit in zip(self.ids, self.queries, self.limits, strict=True):
                s = scored(q, codes, norm, self.books)
                least = np.partition(s, top)[top] if len(s) > top else np.inf  # enough for a result, whatever the limit
                some = np.flatnonzero(s <= max(limit, least))
                some = some[ids[some] != who]
                away = np.sqrt(((x[some] - q) ** 2).sum(1))
                best = np.lexsort((ids[some], away))[:top]
                out.append((np.full(len(best), who), ids[some[best]], away[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


def fitted(x: DataFrame, top: int, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Codebooks, the codes and norms of vectors they were not fitted on, and the share of rows to be reranked; of one sample,
    by hash. None where there are no vectors."""
    rows = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow().column("v").to_pylist()
    if not rows:
        return None
    own = np.array([v for v in rows if len(v) == len(rows[0])])
    half = -(-len(own) // 2)
    books = fit(own[:half])
    unseen = own[half:] if len(own) > 1 else own
    codes, norm = encoded(unseen, books)
    return books, codes, norm, depth(unseen, codes, norm, books, top)


def limits(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norm: np.ndarray, share: float) -> np.ndarray:
    """Each query's score at ``share`` of the given codes."""
    k = min(len(norm), int(np.ceil(share * len(norm)))) - 1
    return np.array([np.partition(scored(q, codes, norm, books), k)[k] for q in queries])


def nearest(vectors: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest found of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    x = written(usable(vectors))
    found = fitted(x, top)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books, codes, norm, share = found
    width = books.shape[2]
    x = x.where(F.size("v") == width)
    index = written(indexed(x, books))
    queries = written(x.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"))
    passes = max(1, -(-queries.count() * width * 8 // BROADCAST_BYTES))
    every_pass = None
    for k in range(passes):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).toArrow()
        q = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        shared = spark.sparkContext.broadcast(Search(books, own.column("query_id").to_numpy(), q, limits(q, books, codes, norm, share), top))
        met = with_sizes(index, ROWS).mapInArrow(lambda batches, shared=shared: shared.value.run(batches) if len(shared.value.ids) else iter(()), "query_id long, vec_id long, score double")
        every_pass = met if every_pass is None else every_pass.unionByName(met)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every_pass.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op2_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
