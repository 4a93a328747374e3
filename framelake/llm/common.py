"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names. Where that is unset a temporary one is used, if Spark
    runs on one machine; on a cluster its executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/framelake-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, or at ``path``: computed once, its lineage cut, safe from lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_sizes(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Arrow batches of bounded bytes, so that very long texts don't fill a Python worker; set in the session."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def map_batches(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str, names: list[str], rows: int = 250) -> DataFrame:
    """Apply ``f`` to ``rows`` rows at a time as lists by column; ``names`` are the columns it needs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = with_sizes(df).sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, rows) for x in batches for k in range(0, x.num_rows, rows)):  # results may be larger than texts
            got = f({n: b.column(i).to_pylist() for i, n in enumerate(names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in arrow], schema=arrow)

    return df.select(*names).mapInArrow(run, out)


def fold(column) -> F.Column:
    """``crc32`` of an id as text, which the contracts use to split folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))


def filter_batches(df: DataFrame, keep: Callable[[list], list[bool]], name: str) -> DataFrame:
    """The rows whose ``name`` column ``keep`` accepts, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    at = df.columns.index(name)
    return with_sizes(df).mapInArrow(run, df.schema)


def training_texts(docs: DataFrame, ids: DataFrame, most_bytes: int) -> Iterator[tuple[object, str]]:
    """(y, text) of the documents of ``ids`` (doc_id, y; few rows), in order of doc_id, whole: one text a doc_id, and of each y
    as many as fit in its share of ``most_bytes``, by a hash of the ids. The driver holds a size per id, and then one part of
    what is left at a time."""
    own = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("text"))
    sizes = own.groupBy("doc_id", "y").agg(F.min(F.struct("h", F.octet_length("text").alias("n"))).alias("s")).collect()
    room = dict.fromkeys((r.y for r in sizes), most_bytes // max(1, len({r.y for r in sizes})))
    chosen = []
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        if r.s.n <= room[r.y]:
            room[r.y] -= r.s.n
            chosen.append((r.doc_id, r.s.h))
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long")
    rows = own.join(F.broadcast(few), ["doc_id", "h"]).dropDuplicates(["doc_id"]).orderBy("doc_id")
    return ((r.y, r.text) for r in rows.select("y", "text").toLocalIterator())


#: The pre-token pattern for which ``encode_spaced`` holds.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = ("  ", " \n", "\n ", "\n\n\n", *"\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
_odd = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def spaced(text: str) -> bool:
    """Is white space in the text only single spaces, and one or two line feeds apart from spaces?"""
    if any(x in text for x in _RARE) or text.endswith("\n\n"):
        return False
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1")) and "\x85" not in text and "\xa0" not in text
    except UnicodeEncodeError:
        return not _odd(text)


class Memory:
    """Values by string in a Python worker: ``most`` that are in use, and as many from before; learned many at once."""

    def __init__(self, learn: Callable[[list[str]], list], most: int):
        self.learn, self.most, self.new, self.old = learn, most, {}, {}

    def holding(self, keys: Iterable[str]) -> dict[str, object]:
        """The memory, with all of ``keys`` in it until the next call."""
        keys = set(keys)
        lacking = keys.difference(self.new)
        if lacking and len(self.new) > self.most:
            self.old, self.new, lacking = self.new, {}, keys
        old = self.old
        self.new.update((k, old[k]) for k in lacking if k in old)
        lacking = [k for k in lacking if k not in old]
        if lacking:
            self.new.update(zip(lacking, self.learn(lacking), strict=True))
        return self.new


def encode_spaced(texts: list[str], matches: Callable[[str], list[str]], memory: Memory, width: int) -> list[bytes]:
    """The ids of ``spaced`` texts, ``width`` bytes each; ``memory`` has the ids of what ``matches`` finds by ``SPACED``.

    Texts come apart before each space and around each line feed, where no match reaches across, so that each different
    piece of a batch is matched and looked up once.
    """
    own = pa.array(texts, pa.large_string())
    for old, new in (("\n", "\0\n\0"), (" ", "\0 ")):
        own = pc.replace_substring(own, old, new)
    parts = pc.split_pattern(own, "\0")
    coded = parts.values.dictionary_encode()
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    # one match is all of a piece of letters, and of white space; others are matched together, a line each
    others = [k for k, p in enumerate(pieces) if p and not (p.isalpha() or p.isspace() or p[0] == " " and p[1:].isalpha())]
    found = matches("\n".join([pieces[k] for k in others]))
    mixed = set(others)
    ids = memory.holding(found + [p for k, p in enumerate(pieces) if p and k not in mixed])
    values, of = [b"" if not p or k in mixed else ids[p] for k, p in enumerate(pieces)], iter(found)
    for k in others:
        values[k] = b"".join([ids[m] for m in takewhile("\n".__ne__, of)])
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    flat, starts, at = np.frombuffer(b"".join(values), f"<u{width}"), np.cumsum(sizes) - sizes, coded.indices.to_numpy()
    n = sizes[at]
    ends = np.cumsum(n)
    out = flat[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    bounds = (width * np.concatenate([[0], ends])[parts.offsets.to_numpy()]).tolist()
    return [out[a:b] for a, b in pairwise(bounds)]
