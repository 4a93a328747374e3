"""Language of texts by a linear-chain conditional random field over words.

Every word is labelled, so that code-switched text gets a language word by word: a word's score for a language is the
sum of learned weights of its affixes, inner character n-grams and itself (a lexicon), all hashed; transitions between
languages are learned too. Marginals come from the forward-backward recursion over each line; a line of more than ``CHAIN``
words goes in pieces that hand their messages on, which gives the same marginals. A document has the language of the
largest sum of marginals, and its share as score.

Training takes documents with a known language outside the held-out fold, at most ``TRAIN_ROWS`` a language by hashed
id, whole. Texts come apart into runs of a few to ``CHAIN`` words; half of the training chains join runs of several texts, so
that switches between languages are learned with the rest.

Null and empty texts, and those without a letter, give ``und`` with score 0; so does every text where no language is
known. Equal sums go to the language that sorts first. Repeated rows score alike. Texts of any length are read whole. An
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import fold, map_batches, table, training_texts

CHAIN, BUCKETS = 128, 1 << 16
#: Training documents of a language, and bytes of all their texts.
TRAIN_ROWS, TRAIN_BYTES = 100, 12 << 20
MEMO = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (word, bucket) of each word's features in word order, and whether the word has a letter.

    2- and 3-grams over the word with its ends marked hold the affixes; the whole word is the lexicon feature.
    """
    plain = [w.lower() for w in words]
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    owner = np.repeat(np.arange(len(plain)), sizes)
    firsts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        code = _mix(flat * _P)
        out, h = [], code
        for n in (2, 3):
            h = _mix(h[: max(0, len(flat) - n + 1)] * _P + code[n - 1 :])
            same = owner[: len(h)] == owner[n - 1 :]
            out.append((owner[: len(h)][same], h[same]))
        place = (np.arange(len(flat)) - np.repeat(firsts, sizes)).astype(np.uint64)
        whole = np.add.reduceat(_mix(code + place * np.uint64(0x94D049BB133111EB)), firsts) if len(plain) else code
        out.append((np.arange(len(plain)), _mix(whole + np.uint64(1))))
    owners, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(owners, kind="stable")
    letters = np.fromiter((any(map(str.isalpha, w)) for w in plain), bool, len(plain))
    return owners[order], (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), letters


@dataclass
class Field:
    """weights: buckets by languages; moves: transition scores; names: languages."""

    weights: np.ndarray
    moves: np.ndarray
    names: list[str]

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owner, bucket, letters = features(words)
        out = np.zeros((len(words), len(self.names)), np.float32)
        if len(words):
            n = np.bincount(owner, minlength=len(words))
            out[:] = np.add.reduceat(self.weights[bucket], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
        out[~letters] = 0
        return out, letters


def forward_backward(scores: np.ndarray, live: np.ndarray, moves: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (steps, chains, languages), log partition, and expected transitions of chains laid side by side.

    scores: (steps, chains, languages); live: (steps, chains), a chain's words come first. before: the forward message of
    what precedes each chain, zeros where nothing does; after: the backward message at its last word.
    """
    steps = len(scores)
    e = np.exp(scores - scores.max(2, keepdims=True))
    t = np.exp(moves)
    a, scale = np.empty_like(e), np.ones(e.shape[:2], e.dtype)
    for k in range(steps):
        x = (a[k - 1] @ t) * e[k] if k else e[k] if before is None else np.where(before.any(1)[:, None], before @ t, 1) * e[k]
        scale[k] = x.sum(1)
        a[k] = x / scale[k][:, None]
        if k:
            a[k] = np.where(live[k][:, None], a[k], a[k - 1])
    b = np.ones_like(e)
    if after is not None:
        b[steps - 1] = after
    pairs = np.zeros((e.shape[2],) * 2)
    for k in range(steps - 1, 0, -1):
        y = e[k] * b[k]
        own = live[k]
        pairs += t * (a[k - 1][own].T @ (y[own] / ((a[k - 1][own] @ t) * y[own]).sum(1, keepdims=True)))
        z = y @ t.T
        b[k - 1] = np.where(own[:, None], z / z.sum(1, keepdims=True), b[k])
    p = a * b
    p /= p.sum(2, keepdims=True)
    log_z = ((np.log(scale) + scores.max(2)) * live).sum(0)
    return p, log_z, pairs


def messages(scores: np.ndarray, pieces: np.ndarray, live: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages into each piece of lines that are cut, from what precedes it and from what follows.

    scores: (steps, pieces, languages); pieces: the place of each in its line, from 0; a line's pieces stand together. Each
    piece's product of transfer matrices is worked out over all pieces at once; then lines go on a piece at a time.
    """
    t, n = np.exp(moves), scores.shape[2]
    e = np.exp(scores - scores.max(2, keepdims=True))
    through = np.broadcast_to(np.eye(n, dtype=e.dtype), (len(pieces), n, n)).copy()
    for k in range(len(scores)):
        step = (through @ t if k else np.where((pieces > 0)[:, None, None], through @ t, through)) * e[k][:, None, :]
        through = np.where(live[k][:, None, None], step / step.sum((1, 2), keepdims=True), through)
    before, after = np.zeros((len(pieces), n), e.dtype), np.ones((len(pieces), n), e.dtype)
    for k in range(1, int(pieces.max()) + 1 if len(pieces) else 0):
        own = np.flatnonzero(pieces == k)
        x = (before[own - 1] if k > 1 else np.ones((len(own), n), e.dtype))[:, None, :] @ through[own - 1]
        before[own] = x[:, 0] / x.sum(2)
    for k in range(int(pieces.max()) - 1 if len(pieces) else -1, -1, -1):
        own = np.flatnonzero((pieces == k) & (np.append(pieces[1:], 0) == k + 1))
        x = (through[own + 1] @ after[own + 1][:, :, None])[:, :, 0]
        after[own] = x / x.sum(1, keepdims=True)
    return before, after


def training_chains(texts: list[str], labels: list[int], g: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Words and labels of chains: runs of a text, by themselves or joined to up to three of others."""
    runs = []
    for text, label in zip(texts, labels, strict=True):
        words, at = text.split(), 0
        while at < len(words):
            n = int(g.integers(4, CHAIN + 1))
            runs.append((words[at : at + n], label))
            at += n
    order, out, at = g.permutation(len(runs)), [], 0
    while at < len(runs):
        n = int(g.integers(2, 5)) if g.random() < 0.5 else 1
        own = [runs[i] for i in order[at : at + n]]
        cut = CHAIN // len(own)
        for first in range(0, max(len(w) for w, _ in own), cut):  # so that chains stay within CHAIN
            parts = [(w[first : first + cut], y) for w, y in own]
            out.append(([x for w, _ in parts for x in w], [y for w, y in parts for _ in w]))
        at += n
    return out


def fit(texts: list[str], labels: list[str], passes: int = 4, seed: int = 3) -> Field:
    names = sorted(set(labels))
    g, n = np.random.default_rng(seed), len(names)
    field = Field(np.zeros((BUCKETS, n), np.float32), np.zeros((n, n)), names)
    chains = training_chains(texts, [names.index(x) for x in labels], g)
    if n < 2 or not chains:
        return field
    square, square_moves = np.full((BUCKETS, n), 1e-6, np.float32), np.full((n, n), 1e-6)
    for _ in range(passes):
        order = g.permutation(len(chains))
        for first in range(0, len(order), 64):
            own = [chains[i] for i in order[first : first + 64]]
            words = sorted({w for c, _ in own for w in c})
            at = {w: i for i, w in enumerate(words)}
            owner, bucket, letters = features(words)
            size = np.sqrt(np.bincount(owner, minlength=len(words)))
            scores, _ = field.emissions(words)
            steps = max(len(c) for c, _ in own)
            index, gold = np.full((steps, len(own)), -1), np.zeros((steps, len(own)), np.int64)
            for k, (c, y) in enumerate(own):
                index[: len(c), k], gold[: len(c), k] = [at[w] for w in c], y
            live = index >= 0
            p, _, pairs = forward_backward(np.where(live[:, :, None], scores[index], 0), live, field.moves)
            d = p - np.eye(n)[gold]
            d = np.where(live[:, :, None] & letters[index][:, :, None], d, 0) / len(own)
            by_word = np.zeros((len(words), n))
            np.add.at(by_word, index[live], d[live])
            order_ = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.diff(bucket[order_], prepend=-1))
            step = np.add.reduceat((by_word / size[:, None])[owner[order_]], heads, axis=0) + 1e-4 * field.weights[bucket[order_][heads]]
            rows = bucket[order_][heads]
            square[rows] += step**2
            field.weights[rows] -= (0.5 * step / np.sqrt(square[rows])).astype(np.float32)
            there = np.zeros((n, n))
            np.add.at(there, (gold[:-1][live[1:]], gold[1:][live[1:]]), 1)
            move = (pairs - there) / len(own) + 1e-3 * field.moves
            square_moves += move**2
            field.moves = field.moves - 0.1 * move / np.sqrt(square_moves)
    return field


class Labeller:
    def __init__(self, field: Field):
        self.field, self.known = field, {}
        self.scores, self.letters = np.zeros((1 << 16, len(field.names)), np.float32), np.zeros(1 << 16, bool)

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new and known and len(known) + len(new) > MEMO:
            known.clear()
            new = list(dict.fromkeys(words))
        if new:
            n = len(known)
            while len(self.scores) < n + len(new):
                self.scores, self.letters = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.scores[n : n + len(new)], self.letters[n : n + len(new)] = self.field.emissions(new)
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words of the texts, one after another: document, marginals, and whether the word has a letter."""
        lines = [(d, line.split()) for d, t in enumerate(texts) for line in t.split("\n")]
        sizes = np.fromiter((len(w) for _, w in lines), np.int64, len(lines))
        ids = self._ids([w for _, x in lines for w in x])
        n = -(-sizes // CHAIN)
        line = np.repeat(np.arange(len(lines)), n)
        k = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        start, length = (np.cumsum(sizes) - sizes)[line] + k * CHAIN, np.minimum(sizes[line] - k * CHAIN, CHAIN)
        out, moves = np.zeros((len(ids), len(self.field.names)), np.float32), self.field.moves.astype(np.float32)
        cut = np.flatnonzero(n[line] > 1)
        before, after = np.zeros((2, len(line), out.shape[1]), np.float32)
        after[:] = 1
        heads = np.flatnonzero(k[cut] == 0)
        for first, last in zip(heads[::512], [*heads[512::512], len(cut)], strict=False):  # whole lines at a time
            own = cut[first:last]
            at, live = self._places(start[own], length[own])
            before[own], after[own] = messages(self.scores[ids[at]], k[own], live, moves)
        order = np.argsort(length, kind="stable")
        for first in range(0, len(order), 2048):  # chains of like length side by side
            own = order[first : first + 2048]
            at, live = self._places(start[own], length[own])
            p, _, _ = forward_backward(np.where(live[:, :, None], self.scores[ids[at]], 0), live, moves, before[own], after[own])
            out[at[live]] = p[live]
        return np.repeat(np.array([d for d, _ in lines], np.int64), sizes), out, self.letters[ids]

    @staticmethod
    def _places(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.arange(int(length.max()))[:, None]
        live = steps < length
        return np.where(live, start + steps, 0), live

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        doc, p, letters = self.words(texts)
        total = np.zeros((len(texts), len(self.field.names)))
        for j in range(total.shape[1]):
            total[:, j] = np.bincount(doc[letters], p[letters, j], minlength=len(texts))
        sums, best = total.sum(1), total.argmax(1)
        names = [self.field.names[b] if s > 0 else "und" for b, s in zip(best, sums, strict=True)]
        return names, np.where(sums > 0, total.max(1) / np.maximum(sums, 1e-9), 0.0).clip(0, 1).tolist()


def trained(docs: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Field:
    """Fit on at most ``rows`` documents of each language, whole, one text each and ``most_bytes`` in all, of which each
    language has its share; only these come to the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") % 4 != 2)).groupBy("doc_id").agg(F.min("lang").alias("y"))
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.withColumn("place", place).where(F.col("place") <= rows).select("doc_id", "y")
    got = list(training_texts(docs, ids, most_bytes))
    return fit([t for _, t in got], [y for y, _ in got])


def labelled(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of ``docs`` (doc_id, text)."""
    shared, made = docs.sparkSession.sparkContext.broadcast(field), []

    def f(batch: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Labeller(shared.value))
        out = {"doc_id": batch["doc_id"], "lang_pred": [], "score": []}
        for k in range(0, len(batch["text"]), 500):
            names, scores = made[0].label([t or "" for t in batch["text"][k : k + 500]])
            out["lang_pred"] += names
            out["score"] += scores
        return out

    rows = map_batches(docs, f, "doc_id long, lang_pred string, score double", ["doc_id", "text"])
    return rows.select("doc_id", F.coalesce(fold("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return labelled(docs, trained(docs))
