"""Byte-level BPE by two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Texts in which white space is single spaces and line feeds come apart there, and each different piece of a batch is
matched once; others are matched whole. A worker remembers the ids of pre-tokens it has met; when it holds ``MEMO`` of
them, those of before are dropped.

Nulls encode as the empty text, to no ids. Repeated rows give repeated results, other columns are ignored, an empty table
gives none. Texts of any length are encoded whole; a batch ends after 250 texts.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import SPACED, Memory, encode_spaced, map_batches, spaced, table

#: Pre-tokens whose ids a Python worker holds at once: so many that are in use, and as many from before.
MEMO = 400_000


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hash and displace: n keys, n slots.

    ``slots`` gives each key a slot; a key outside the set gets a slot too, so callers compare the bytes stored there.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        buckets = max(1, n // 4)
        self.shift = np.zeros(buckets, np.int64)
        self.at = np.full(n, -1, np.int64)  # slot -> index of key
        h = self._hash(keys)
        order = np.argsort(h % np.uint64(buckets), kind="stable")
        bounds = np.searchsorted((h % np.uint64(buckets))[order], np.arange(buckets + 1, dtype=np.uint64))
        taken = np.zeros(n, bool)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) < 2:
                break
            for d in range(1, 1 << 24, 256):  # 256 displacements at a time
                tries = np.arange(d, d + 256)
                s = self._slot(h[own][None, :], tries[:, None])
                fits = ~taken[s].any(1) & (np.diff(np.sort(s, 1), axis=1) > 0).all(1)
                if fits.any():
                    k = int(fits.argmax())
                    d, s = d + k, s[k]  # noqa: PLW2901
                    break
            else:
                raise ValueError("two keys have the same hash")
            taken[s], self.shift[b], self.at[s] = True, d, own
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):  # negative: the slot itself
            s = next(free)
            self.shift[b], self.at[s] = -1 - s, order[bounds[b]]

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, keys), np.uint64, len(keys))

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = self._hash(keys)
        d = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slot(h, d))


class Vocabulary:
    """Ranks by token bytes, as in a rank file; a token's rank is its id."""

    def __init__(self, lines: bytes):
        pairs = [line.split() for line in lines.splitlines() if line]
        self.tokens = [base64.b64decode(t) for t, _ in pairs]
        self.ids = [int(r) for _, r in pairs]
        self.hash = PerfectHash(self.tokens)
        rank = dict(zip(self.tokens, self.ids, strict=True))
        self.byte = [rank[bytes([b])] for b in range(256)]
        after: dict[int, dict[int, int]] = {r: {} for r in self.ids}  # by left id: id of the join by right id
        for t, r in rank.items():
            for k in range(1, len(t)):
                if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None:
                    after[a][b] = r
        nothing: dict[int, int] = {}
        self.join = [after.get(a, nothing).get for a in range(max(self.ids) + 1)]
        self.packed = {r: r.to_bytes(4, "little") for r in self.ids}
        sizes = np.zeros(max(self.ids) + 1, np.int64)
        sizes[self.ids] = [len(t) for t in self.tokens]
        by_id = b"".join(t for _, t in sorted(zip(self.ids, self.tokens, strict=True)))
        self.bytes = np.frombuffer(by_id, np.uint8), np.cumsum(sizes) - sizes, sizes

    def whole(self, pieces: list[bytes]) -> list[int]:
        """First tier: the id of each piece that is a token itself, else -1."""
        at, tokens, ids = self.hash.at, self.tokens, self.ids
        return [ids[k] if tokens[k] == p else -1 for k, p in zip(at[self.hash.slots(pieces)].tolist(), pieces, strict=True)]

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        ids = [*map(self.byte.__getitem__, piece)]
        n, join = len(ids), self.join
        bits = 14 if n < 1 << 14 else 40  # small numbers are quicker
        mask = (1 << bits) - 1
        heap, i = [], 0
        for a, b in pairwise(ids):
            if (x := join[a](b)) is not None:
                heap.append(x << bits | i)
            i += 1
        if not heap:
            return ids
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapify(heap)
        while heap:
            k = heappop(heap)
            i, r = k & mask, k >> bits
            j = after[i]
            if j == n or ids[i] < 0 or join[ids[i]](ids[j]) != r:
                continue  # one of the two has been joined to another meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            joins = join[r]
            if k < n:
                before[k] = i
                if (x := joins(ids[k])) is not None:
                    heappush(heap, x << bits | i)
            k = before[i]
            if k >= 0 and (x := join[ids[k]](r)) is not None:
                heappush(heap, x << bits | k)
        return [x for x in ids if x >= 0]


class Codec:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.split, self.cut = vocabulary, regex.compile(pattern).findall, pattern == SPACED
        self.memory = Memory(self._tokens, MEMO)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.cut and spaced(t) for t in texts]
        own = iter(encode_spaced([t for t, p in zip(texts, plain, strict=True) if p], self.split, self.memory, 4))
        return [next(own) if p else self._whole(t) for t, p in zip(texts, plain, strict=True)]

    def _whole(self, text: str) -> bytes:
        tokens = self.split(text)
        return b"".join(map(self.memory.holding(tokens).__getitem__, tokens))

    def _tokens(self, tokens: list[str]) -> list[bytes]:
        merged, packed, raw = self.v.merged, self.v.packed, [t.encode() for t in tokens]
        return [packed[k] if k >= 0 else b"".join([packed[x] for x in merged(b)]) for b, k in zip(raw, self.v.whole(raw), strict=True)]

    def decode(self, packed: bytes) -> bytes:
        ids, (flat, starts, sizes) = np.frombuffer(packed, "<u4"), self.v.bytes
        n = sizes[ids]
        ends = np.cumsum(n)
        return flat[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_codecs: dict[str, Codec] = {}


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids``
    also ids (array) and decoded (binary).

    The rank file is read on the driver and sent to the tasks: its size is the vocabulary's, whatever the input.
    """
    lines = open(ranks_path, "rb").read()
    if len(lines) > 64 << 20:
        raise ValueError("the rank file is too large to be sent to each task")
    key = hashlib.sha256(lines).hexdigest() + pattern
    shared = docs.sparkSession.sparkContext.broadcast(lines)

    def f(batch: dict[str, list]) -> dict[str, list]:
        if key not in _codecs:
            _codecs[key] = Codec(Vocabulary(shared.value), pattern)
        codec, out = _codecs[key], {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for ids in codec.encode([t or "" for t in batch["text"]]):
            decoded = codec.decode(ids)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                out["ids"].append(np.frombuffer(ids, "<u4").astype("<i4"))
                out["decoded"].append(decoded)
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return map_batches(docs, f, schema, ["doc_id", "text"], 250 if with_ids else 1000)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encoded(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
