"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A document is cut into windows of ``WINDOW`` words, one every ``STRIDE``; every window is scored and the document
has the score of its worst one. Each word enters as a hashed word embedding plus the mean of its hashed character
n-grams. The network is trained in numpy from whole documents labelled as a whole: the documents' loss goes to each
window by its share in the soft maximum of the windows' logits; of clean documents of more windows, each pass takes others.

Null and empty texts, and texts without a word, score 0. Repeated rows score alike. Texts of any length are scored in all
their windows. An empty table gives none; without labels, or with labels of one kind only, all texts score alike. Other
columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import fold, map_batches, table, training_texts

WINDOW, STRIDE = 48, 36
BUCKETS, WIDTH, HIDDEN = 1 << 13, 16, 10
#: Bounds of the training sample: labelled documents of each class; and windows of a clean one in one pass.
TRAIN_ROWS, LEARNED = (800, 1600), 8
#: Bytes of all texts of the sample; whole texts are taken until each class has its half.
TRAIN_BYTES = 12 << 20
#: Distinct words whose inputs a task holds at once.
MEMO = 250_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word (lower-cased, marks around it stripped): its bucket, and flat (word, bucket) of its 3- and 4-grams."""
    words = [w.lower().strip("!?.,;:\"'()[]{}<>|*#$%&-_~+=/\\") for w in words]
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):
        code = _mix(flat * PRIME)
        grams, owners, h = [], [], code
        for n in (2, 3, 4):
            h = _mix(h[: len(flat) - n + 1] * PRIME + code[n - 1 :]) if len(flat) >= n else h[:0]
            same = owner[: len(h)] == owner[n - 1 :]
            if n > 2:
                grams.append(h[same])
                owners.append(owner[: len(h)][same])
        within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.add.reduceat(_mix(code + within.astype(np.uint64) * np.uint64(0x94D049BB133111EB)), np.cumsum(sizes) - sizes) if words else flat
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    b = np.uint64(BUCKETS)
    return (_mix(whole) % b).astype(np.int64), owners[order], (grams[order] % b).astype(np.int64)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by position; a negative position counts from the end."""
    at = at % n
    order = np.argsort(at, kind="stable")
    heads = np.flatnonzero(np.diff(at[order], prepend=-1))
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(order):
        out[at[order][heads]] = np.add.reduceat(values[order], heads, axis=0)
    return out


def _features(words: list[str], some: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_features`` in few bytes: of some words at a time, as narrow integers."""
    parts = [word_features(words[k : k + some]) for k in range(0, len(words), some)]
    owners = [(o + k * some).astype(np.int32) for k, (_, o, _) in enumerate(parts)]
    return np.concatenate([w.astype(np.int32) for w, _, _ in parts]), np.concatenate(owners), np.concatenate([g.astype(np.int32) for _, _, g in parts])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """p: parameters by name; U*, W*: gates z, r and n side by side, for the forward (f) and backward (b) direction."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 7) -> Network:
        g, h, e = np.random.default_rng(seed), HIDDEN, WIDTH
        p = {"word": g.normal(0, 0.1, (BUCKETS, e)), "char": g.normal(0, 0.3, (BUCKETS, e)), "att": g.normal(0, 0.3, 2 * h), "out": g.normal(0, 0.3, 2 * h), "bias": np.array([-1.0])}
        for d in "fb":
            p |= {f"W{d}": g.normal(0, e**-0.5, (e, 3 * h)), f"U{d}": g.normal(0, h**-0.5, (h, 3 * h)), f"B{d}": np.zeros(3 * h)}
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def embed(self, feats: tuple) -> np.ndarray:
        word, owner, grams = feats
        n = np.bincount(owner, minlength=len(word))
        x = np.zeros((len(word), WIDTH), np.float32)
        if len(owner):
            has = np.flatnonzero(n)
            x[has] = np.add.reduceat(self.p["char"][grams], (np.cumsum(n) - n)[has], axis=0)
        return x / np.maximum(n, 1)[:, None].astype(np.float32) + self.p["word"][word]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, of the forward and then the backward direction; a zero row for padding comes last."""
        rows = np.concatenate([x @ self.p["Wf"] + self.p["Bf"], x @ self.p["Wb"] + self.p["Bb"]], 1)
        return np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])

    def run(self, rows: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logit of each window. rows: of inputs(); at: windows by words, -1 where a window has ended."""
        h3, n, steps = 3 * HIDDEN, *at.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        kept = {}
        live = (at >= 0).T[:, :, None].astype(np.float32)
        for d, part, times in (("f", slice(0, h3), range(steps)), ("b", slice(h3, 2 * h3), range(steps - 1, -1, -1))):
            u, own = self.p[f"U{d}"], rows[:, part]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in times:
                x, g = own[at[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = h + live[t] * ((1 - z) * (c - h))
                if keep:
                    kept[d, t] = (h, z, r, c, g[:, 2 * HIDDEN :])
                h = new
                states[t, :, (0 if d == "f" else HIDDEN) : (HIDDEN if d == "f" else 2 * HIDDEN)] = h
        e = states @ self.p["att"] + (live[:, :, 0] - 1) * 1e4
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, a, pooled, kept, live)) if keep else logit

    def grads(self, rows: np.ndarray, at: np.ndarray, kept: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters after inputs(), and of its rows."""
        states, a, pooled, inner, live = kept
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["att"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * self.p["att"]
        steps, h3 = len(states), 3 * HIDDEN
        added = np.zeros((steps, len(at), 2 * h3), np.float32)
        for d, first, times in (("f", 0, range(steps - 1, -1, -1)), ("b", 1, range(steps))):
            u = self.p[f"U{d}"]
            du, d_h = np.zeros_like(u), np.zeros((len(at), HIDDEN), np.float32)
            for t in times:
                h, z, r, c, gn = inner[d, t]
                d_new = d_h + d_states[t, :, first * HIDDEN : (first + 1) * HIDDEN]
                d_in = d_new * live[t]
                d_c = d_in * (1 - z) * (1 - c * c)
                d_z = d_in * (h - c) * z * (1 - z)
                d_r = d_c * gn * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_c], 1)
                d_g = np.concatenate([d_z, d_r, d_c * r], 1)
                du += h.T @ d_g
                d_h = d_new - d_in * (1 - z) + d_g @ u.T
                added[t, :, first * h3 : (first + 1) * h3] = d_x
            g[f"U{d}"] = du
        d_rows = _summed(at.T.reshape(-1), added.reshape(-1, 2 * h3), len(rows))
        d_rows[-1] = 0
        return g, d_rows


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of each window over documents of so many words, laid end to end; the last one of a document reaches its end."""
    n = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(sizes) - sizes)[doc] + k * STRIDE, doc


def _positions(start: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < ends[doc][:, None], at, -1)


def fit(examples: Iterable[tuple[int, str]], steps: int = 300, seed: int = 7) -> Network:
    """A network from texts and their labels, of which it holds the numbers of words; the same rows give the same network."""
    net, g = Network.new(seed), np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs, labels = [], []
    for label, text in examples:
        docs.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in text.split()), np.int32))
        labels.append(label)
    if not vocabulary or len(set(labels)) < 2:
        net.p["out"][:] = 0
        net.p["bias"][:] = 5.0 if labels and all(labels) else -5.0
        return net
    feats = _features(list(vocabulary))
    bounds = np.searchsorted(feats[1], np.arange(len(vocabulary) + 1))
    del vocabulary
    y = np.array(labels, np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype(np.float32)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, usable = 0, np.flatnonzero([len(d) > 0 for d in docs])
    epochs = max(3, -(-24 * steps // max(1, len(usable))))
    for epoch in range(epochs):
        order = g.permutation(usable)
        for first in range(0, len(order), 24):
            own = order[first : first + 24]
            flat = np.concatenate([docs[i] for i in own])
            used, local = np.unique(flat, return_inverse=True)
            sizes = np.array([len(docs[i]) for i in own])
            start, doc = windows(sizes)
            some = g.random(len(doc)) * np.bincount(doc)[doc] <= LEARNED
            some[np.searchsorted(doc, np.arange(len(own))) + (g.random(len(own)) * np.bincount(doc)).astype(np.int64)] = True  # one at least
            some |= y[own][doc] > 0
            start, doc = start[some], doc[some]
            at = _positions(start, doc, np.cumsum(sizes))
            at = np.where(at >= 0, local[at], -1)
            spans = [np.arange(bounds[w], bounds[w + 1]) for w in used]
            some = (feats[0][used], np.repeat(np.arange(len(used)), [len(s) for s in spans]), feats[2][np.concatenate(spans)])
            x = net.embed(some)
            rows = net.inputs(x)
            logit, kept = net.run(rows, at, keep=True)
            heads = np.searchsorted(doc, np.arange(len(own)))
            top = np.maximum.reduceat(logit, heads)
            e = np.exp(logit - top[doc])
            total = np.add.reduceat(e, heads)
            p = _sigmoid(top + np.log(total))
            d_doc = (p - y[own]) * weight[own] / len(own)
            grads, d_rows = net.grads(rows, at, kept, (d_doc[doc] * e / total[doc]).astype(np.float32))
            d_x = np.zeros_like(x)
            for k, d in enumerate("fb"):
                part = d_rows[:-1, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN]
                grads[f"W{d}"], grads[f"B{d}"] = x.T @ part, part.sum(0)
                d_x += part @ net.p[f"W{d}"].T
            for name, at_bucket, value in (("word", some[0], d_x), ("char", some[2], (d_x / np.maximum(np.bincount(some[1], minlength=len(used)), 1)[:, None])[some[1]])):
                grads[name] = _summed(at_bucket, value.astype(np.float32), BUCKETS)
            step += 1
            rate = 0.01 * (1 - 0.8 * (epoch * len(order) + first) / (epochs * len(order)))
            for k, d in grads.items():
                a, b = m[k]
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                net.p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.rows = np.zeros((1 << 15, 6 * HIDDEN), np.float32)  # the last row stays zero

    def score(self, texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        flat = self._ids(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start, doc = windows(sizes)
        out, ends = np.full(len(texts), -np.inf, np.float32), np.cumsum(sizes)
        for k in range(0, len(start), 2048):
            s, d = start[k : k + 2048], doc[k : k + 2048]
            at = _positions(s, d, ends)
            logit = self.net.run(self.rows, np.where(at >= 0, flat[at], -1))
            np.maximum.at(out, d, logit)
        return np.where(sizes > 0, _sigmoid(out.astype(np.float64)), 0.0)

    def _ids(self, words: list[list[str]]) -> np.ndarray:
        known, all_words = self.known, [w for x in words for w in x]
        new = [w for w in dict.fromkeys(all_words) if w not in known]
        if new and len(known) + len(new) > MEMO and known:
            known.clear()
            new = list(dict.fromkeys(all_words))
        if new:
            n = len(known)
            while len(self.rows) <= n + len(new):
                self.rows = np.concatenate([self.rows[:-1], np.zeros((len(self.rows) + 1, 6 * HIDDEN), np.float32)])
            self.rows[n : n + len(new)] = self.net.inputs(self.net.embed(word_features(new)))[:-1]
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, all_words), np.int64, len(all_words))


def trained(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network:
    """Fit on labelled documents outside the held-out fold: at most ``rows`` (toxic, clean) of them, by hash of their
    ids, one text each and ``most_bytes`` in all. Only this sample comes to the driver, a part at a time."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") % 5 != 0)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    ids = None
    for y, n in ((1, rows[0]), (0, rows[1])):
        some = own.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = some if ids is None else ids.unionByName(some)
    # at most sum(rows) ids: small whatever the input
    return fit(training_texts(docs, ids, most_bytes))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared, made = docs.sparkSession.sparkContext.broadcast(net), []

    def f(batch: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Scorer(shared.value))
        s = [x for k in range(0, len(batch["text"]), 250) for x in made[0].score([t or "" for t in batch["text"][k : k + 250]]).tolist()]
        return {"doc_id": batch["doc_id"], "score": s, "predicted": [int(x >= 0.5) for x in s]}

    out = map_batches(docs, f, "doc_id long, score double, predicted int", ["doc_id", "text"])
    return out.select("doc_id", F.coalesce(fold("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that score 0.5 or more. Rows that share a null doc_id are judged each by its own text."""
    net = trained(docs, table(spark, sf_dir, "labels"))
    return without_toxic(docs, net)


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    from framelake.llm.common import filter_batches

    shared, made = docs.sparkSession.sparkContext.broadcast(net), []

    def keep(texts: list) -> list[bool]:
        if not made:
            made.append(Scorer(shared.value))
        return [x < 0.5 for k in range(0, len(texts), 250) for x in made[0].score([t or "" for t in texts[k : k + 250]]).tolist()]

    return filter_batches(docs, keep, "text")
