"""Best-fit packing of documents into sequences of a fixed number of tokens, by minimum bin slack.

Documents are tokenized, get an end id, and only those longer than a sequence are cut into whole sequences, the remainder first.
Pieces of one length are alike to the packing, so it works on how many there are of each length: a bin starts with the
longest length left, a dynamic program over the available lengths with bitsets of reachable sums finds the fullest bin that
holds it (or one a few tokens short that takes longer lengths, which leaves short ones for later bins: a few such allowances
are tried), and as long as the lengths last, the next bins would be filled the same: the combination is removed as often as that.
A piece then takes its place by its number among the pieces of its length.

The histogram has a number per length, and the plan has few rows: each combination leaves some length less often than it uses
it, which halves that length's count at least, so that ``rows`` bounds them by the sequence length alone. Pieces are numbered
within their input part and length while they are made, and parts by their counts, so that no length comes together in a task.

Null texts are empty and hold the end id only. Repeated rows, and rows with null or equal doc_id, are documents of their own.
Texts of any length are cut. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import table, with_sizes, written
from framelake.llm.huffman import END, Tokenizer

SEQUENCE = 1024
#: A bin may stay so many tokens short of the fullest where that takes longer lengths; the plan of fewest sequences is used.
SLACKS = (0, 1, 2, 4, 8, 16, 32, 64)
_tokenizers: dict[str, Tokenizer] = {}


def fullest(counts: list[int], room: int, slack: int = 0) -> list[int]:
    """Lengths, longest first, whose sum is as near to ``room`` as the available ones allow, or up to ``slack`` less; of several
    such, with the longest lengths."""
    lengths = [k for k in range(1, min(room, len(counts) - 1) + 1) if counts[k]]
    sums, mask = [1], (1 << room + 1) - 1  # bit s: the lengths so far can make s
    for k in lengths:
        own, copies, step = sums[-1], min(counts[k], room // k), 1
        while copies > 0:  # any number of copies is a sum of these steps
            step = min(step, copies)
            own |= own << k * step & mask
            copies, step = copies - step, step * 2
        sums.append(own)
    best, out = sums[-1].bit_length() - 1, []
    goals = (1 << best + 1) - (1 << max(0, best - slack))  # bit s: the lengths still to choose may make s
    for at in range(len(lengths), 0, -1):
        k = lengths[at - 1]
        n = min(counts[k], best // k)
        while not goals >> n * k & sums[at - 1]:
            n -= 1
        out += [k] * n
        goals >>= n * k
    return out


def bins(counts: np.ndarray, slack: int = 0) -> list[tuple[list[int], int]]:
    """Combinations of lengths, longest first, and how many bins have each. counts: of pieces by length, up to that of a bin."""
    left, size, out = [int(c) for c in counts], len(counts) - 1, []
    for longest in range(size, 0, -1):
        while left[longest]:
            left[longest] -= 1
            own = [longest, *fullest(left, size - longest, slack)]
            left[longest] += 1
            used = {k: own.count(k) for k in set(own)}
            times = min(left[k] // n for k, n in used.items())
            for k, n in used.items():
                left[k] -= n * times
            out.append((own, times))
    return out


@dataclass
class Plan:
    """Where the pieces of each length go: by combination, the length, the number of the first piece, pieces a bin, first bin and offset."""

    length: np.ndarray
    first: np.ndarray
    a_bin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    @staticmethod
    def of(counts: np.ndarray) -> Plan:
        rows, taken, sequence = [], [0] * len(counts), 0
        for own, times in min((bins(counts, slack) for slack in SLACKS), key=lambda x: sum(n for _, n in x)):
            offset = 0
            for k in sorted(set(own), reverse=True):
                n = own.count(k)
                rows.append((k, taken[k], n, sequence, offset))
                taken[k] += n * times
                offset += n * k
            sequence += times
        x = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return Plan(*x.T, sequence)

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        starts = np.searchsorted(self.length, np.arange(self.length.max(initial=0) + 2))
        for k in np.unique(length):
            mine, rows = length == k, slice(starts[k], starts[k + 1])
            x = number[mine]
            at = np.searchsorted(self.first[rows], x, "right") - 1
            x = x - self.first[rows][at]
            a_bin = self.a_bin[rows][at]
            sequence[mine] = self.sequence[rows][at] + x // a_bin
            offset[mine] = self.offset[rows][at] + x % a_bin * k
        return sequence, offset


def pieces(docs: DataFrame, spec: str, pattern: str, size: int, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, with its input part and its number among those of its length there."""
    wide = 2 if max(json.loads(spec)["model"]["vocab"].values()) < 1 << 16 else 4
    shared, key = docs.sparkSession.sparkContext.broadcast(spec), f"{zlib.crc32(spec.encode())} {len(spec)} {pattern} {wide}"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]

    def run(batches):
        if key not in _tokenizers:
            _tokenizers[key] = Tokenizer(shared.value, pattern, wide)
        own, tail, part = _tokenizers[key], end.to_bytes(wide, "little"), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            coded = [np.frombuffer(x + tail, f"<u{wide}").astype("<u4") for x in own.encode([t or "" for t in b.column(1).to_pylist()])]
            n = np.array([len(x) for x in coded], np.int64)
            k = -(-n // size)
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            head = (n - (k - 1) * size)[doc]  # of the first piece; the rest is whole
            start = np.where(piece > 0, head + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, head)
            crc = [zlib.crc32(coded[d][s : s + m].tobytes()) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            number = np.empty(len(by), np.int64)
            number[order] = seen[by] + np.arange(len(by)) - np.searchsorted(by, by)
            seen += np.bincount(length, minlength=size + 1)
            values = [b.column(0).take(pa.array(doc)), piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(doc), part), number]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long"
    return written(with_sizes(docs.select("doc_id", "text"), 4000).mapInArrow(run, schema))


def packed(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = SEQUENCE) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their sequence_id and offset."""
    spec = open(tokenizer_path, encoding="utf-8").read()
    own = pieces(docs, spec, pattern, size)
    counts = own.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = written(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")))
    histogram = np.zeros(size + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():  # ``size`` rows at most
        histogram[r.length] = r.n
    shared = docs.sparkSession.sparkContext.broadcast(Plan.of(histogram))

    def run(batches):
        for b in batches:
            length, number, earlier = (b.column(i).to_numpy() for i in (3, 5, 6))
            sequence, offset = shared.value.places(length, number + earlier)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    numbered = own.join(before.drop("n"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "number", "before")
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packed(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)
