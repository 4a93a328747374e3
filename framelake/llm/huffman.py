"""Token ids as canonical length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

Documents in ascending doc_id order (null first, ties by text) are tokenized and each gets an end id. Ids are counted
over all documents; the code lengths follow from the counts by the coin-collector's method and give the code, so that
the files hold lengths only. A block holds whole documents, at least ``BLOCK`` ids unless it is the last of its part, and a
checkpoint every ``STEP`` ids, from which all are decoded side by side through one table.

Files are Parquet tables in the shared folder, a row per block, so that Spark's commit decides which exist. Null texts
are empty and hold the end id only. Repeated rows are documents of their own. Long texts make long blocks. An empty table
gives no blocks and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import SPACED, Memory, encode_spaced, spaced, table, with_sizes, written

BLOCK, STEP, MOST_BITS, END = 1 << 16, 128, 16, 2
HEADER = struct.Struct("<4sIII")
#: Pre-tokens whose ids a Python worker holds at once: so many that are in use, and as many from before.
MEMO = 500_000


def lengths_of(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for counts above 0; 0 elsewhere. Coins are paired level by level."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    most = max(most, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    levels, row = [np.ones(len(coins), bool)], coins
    for _ in range(most - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(coins))
        row = both[by]
    take, own = 2 * len(coins) - 2, np.zeros(len(coins), np.int64)
    for level in reversed(levels):
        k = int(level[:take].sum())
        own[:k] += 1
        take = 2 * (take - k)
    out[order] = own
    return out


def _reversed(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(values)
    for k in range(bits):
        out |= ((values >> k) & 1) << (bits - 1 - k)
    return out


class Codebook:
    """The canonical code of given lengths, written from the lowest bit; decoding goes by the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.sizes, self.codes = lengths.astype(np.int64), np.zeros(len(lengths), np.int64)
        order = used[np.lexsort((used, lengths[used]))]
        own = lengths[order].astype(np.int64)
        self.bits = top = int(own[-1]) if len(own) else 0
        n = 1 << (top - own)
        self.codes[order] = _reversed(np.cumsum(n) - n, top)
        at = _reversed(np.arange(1 << top), top)
        symbols, sizes = np.repeat(order, n), np.repeat(own, n)
        symbols, sizes = (np.resize(x, 1 << top) if len(x) else np.zeros(1 << top, np.int64) for x in (symbols, sizes))
        self.table = (symbols[at] << 8 | sizes[at]).astype(np.int64)

    def encode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = np.zeros((int(ends[-1] if len(ends) else 0) >> 5) + 2, np.uint64)
        if len(ids):
            at, value = starts >> 5, self.codes[ids].astype(np.uint64) << (starts & 31).astype(np.uint64)
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[heads]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
            words[at[heads] + 1] += np.add.reduceat(value >> np.uint64(32), heads)
        payload, marks = words.astype("<u4").tobytes(), starts[::STEP].astype("<u8").tobytes()
        return HEADER.pack(b"HUFB", len(ids), STEP, zlib.crc32(marks + payload)) + marks + payload

    def decode(self, block: bytes) -> np.ndarray:
        magic, n, step, crc = HEADER.unpack_from(block)
        if magic != b"HUFB" or zlib.crc32(memoryview(block)[HEADER.size :]) != crc:
            raise ValueError("the block is damaged")
        lanes = -(-n // step)
        at = np.frombuffer(block, "<u8", lanes, HEADER.size).astype(np.int64)
        raw = np.zeros(len(block) - HEADER.size - 8 * lanes + 4 + step * self.bits // 8, np.uint32)
        own = np.frombuffer(block, np.uint8, offset=HEADER.size + 8 * lanes)
        raw[: len(own)] = own
        word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        out, mask = np.empty((step, lanes), np.int64), (1 << self.bits) - 1
        for k in range(step):
            got = self.table[(word[at >> 3] >> (at & 7)) & mask]
            out[k] = got >> 8
            at += got & 255
        return out.T.reshape(-1)[:n]


class Tokenizer:
    """Ids by the tokenizers library, as ``encode(text, add_special_tokens=False)`` gives them.

    Where the file splits texts by the byte-level pattern alone, pre-tokens are looked up and only those not met before
    go to the library's model; texts that hold an added token or other white space, and other files, go to it whole.
    """

    def __init__(self, spec: str, pattern: str, width: int, specials_as_text: bool = False):
        from tokenizers import Tokenizer as Library

        self.library, parts = Library.from_str(spec), json.loads(spec)
        self.library.encode_special_tokens = specials_as_text
        self.library.no_truncation()
        split, model = parts["pre_tokenizer"] or {}, parts["model"]
        plain = not parts["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"] and model["type"] == "BPE"
        self.cut = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and pattern == SPACED
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.split, self.width, self.memory = regex.compile(pattern).findall, width, Memory(self._tokens, MEMO)
        self.packed = [k.to_bytes(width, "little") for k in range(max(parts["model"]["vocab"].values()) + 1)]
        at = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a vocabulary file
        rest = iter(range(256, 512))
        self.letters = {b: chr(b if b in at else next(rest)) for b in range(256)}

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.cut and spaced(t) and not any(a in t for a in self.added) for t in texts]
        own = iter(encode_spaced([t for t, p in zip(texts, plain, strict=True) if p], self.split, self.memory, self.width))
        return [next(own) if p else self._whole(t) for t, p in zip(texts, plain, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def _tokens(self, tokens: list[str]) -> list[bytes]:
        model, letters, packed = self.library.model.tokenize, self.letters, self.packed
        return [b"".join([packed[t.id] for t in model(p.encode().decode("latin-1").translate(letters))]) for p in tokens]


_tokenizers: dict[str, Tokenizer] = {}


def tokenized(docs: DataFrame, spec: str, pattern: str, end: int = END, specials_as_text: bool = False) -> DataFrame:
    """part, seq, doc_id and ids (little-endian, of 2 bytes if the vocabulary allows) of each document, in range parts by doc_id."""
    wide = 2 if max(json.loads(spec)["model"]["vocab"].values()) < 1 << 16 else 4
    shared, key = docs.sparkSession.sparkContext.broadcast(spec), f"{zlib.crc32(spec.encode())} {len(spec)} {pattern} {wide} {specials_as_text}"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        if key not in _tokenizers:
            _tokenizers[key] = Tokenizer(shared.value, pattern, wide, specials_as_text)
        own = _tokenizers[key]
        part, seq, tail = TaskContext.get().partitionId(), 0, end.to_bytes(wide, "little")
        for b in batches:
            ids = [x + tail for x in own.encode([t or "" for t in b.column(1).to_pylist()])]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(seq, seq + n)), b.column(0), pa.array(ids, pa.binary())], names=["part", "seq", "doc_id", "ids"])
            seq += n

    return written(with_sizes(dealt, 4000).mapInArrow(run, "part long, seq long, doc_id long, ids binary")), wide


def counted(ids: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs; the vocabulary bounds what a task and the driver get."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), f"<u{width}"), minlength=len(total))
            n[: len(total)] += total
            total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([0, *(r.id for r in rows)]) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def stored(ids: DataFrame, width: int, counts: np.ndarray, path: str | None = None) -> DataFrame:
    """The files' rows: part, seq of the first document, doc_ids, sizes, n_ids, code (its lengths, packed) and block."""
    lengths = lengths_of(counts)
    code = zlib.compress(lengths.astype(np.uint8).tobytes())

    def run(batches):
        book = Codebook(lengths)
        names = ["part", "seq", "doc_ids", "sizes", "n_ids", "code", "block"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]

        def row(own):
            x = np.concatenate([o[3] for o in own])
            values = [own[0][0], own[0][1], [o[2] for o in own], [len(o[3]) for o in own], len(x), code, book.encode(x)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        own, n = [], 0
        for b in batches:
            for part, seq, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if own and (n >= BLOCK or own[-1][:2] != (part, seq - 1)):
                    yield row(own)
                    own, n = [], 0
                x = np.frombuffer(raw.as_buffer(), f"<u{width}")
                own.append((part, seq, doc, x))
                n += len(x)
        if own:
            yield row(own)

    return written(with_sizes(ids).mapInArrow(run, "part long, seq long, doc_ids array<long>, sizes array<long>, n_ids long, code binary, block binary"), path)


def read_back(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    sizes = blocks.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a part
    firsts = sizes.join(parts, "part").withColumn("first", F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))

    def run(batches):
        books = {}  # one: all files have the same code
        for b in batches:
            for part, seq, docs, own, code, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if code not in books:
                    books = {code: Codebook(np.frombuffer(zlib.decompress(code), np.uint8))}
                book = books[code]
                ids = book.decode(block).astype("<u4")
                ends = np.cumsum(own)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), own, strict=True)]
                k = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part)), pa.array(np.full(k, seq)), pa.array(docs, pa.int64()), pa.array(ends - own), pa.array(own, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    decoded = blocks.select("part", "seq", "doc_ids", "sizes", "code", "block").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(firsts.select("part", "seq", "first"), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def coded(docs: DataFrame, tokenizer_path: str, pattern: str, path: str | None = None, specials_as_text: bool = False) -> DataFrame:
    """Tokenize, count and store ``docs`` (doc_id, text), in files at ``path`` if it is given, and read the files back.

    With ``specials_as_text`` the strings of added tokens in a text are text; else they are those tokens.
    """
    spec = open(tokenizer_path, encoding="utf-8").read()
    if len(spec) > 64 << 20:
        raise ValueError("the tokenizer file is too large to be sent to each task")
    ids, width = tokenized(docs, spec, pattern, specials_as_text=specials_as_text)
    return read_back(stored(ids, width, counted(ids, width), path))


def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return coded(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)
