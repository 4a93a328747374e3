"""Operators on small fixtures with nulls, empties, repeats, extra columns and empty tables, against brute force."""

import ast
import base64
import hashlib
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from framelake.llm import additive, bpe, html, huffman, jaccard, language, lines, mixture, toxicity, webp

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
BASE = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old stone wall near the river bank at dawn"
TEXTS = [None, "", " ", "a", "a b", BASE, BASE, BASE + " again", BASE.replace("fox", "cat"), BASE.upper(), "\n".join([BASE, BASE[:-1] + "m", "short"]), "x" * 5000, "é à b c\n\n 日本 <|endoftext|>", "one two\n" * 400, "!!! ??? 123"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, a long, size int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), i, "k", 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


SPACES = ["a b", "a  b", "a\nb", "a\n\nb", "a\n\n\nb", "a \n b", "\na", "\n\na", "a\n", "a\n\n", "a ", " a", "  a", " ", "\n", "\n\n", "a\tb", "a\r\nb", "it's 'so' \"'s", "x.'s y", "a\u00a0b \u2003c", "12ab3 a1'll", "e\u0301 \u0660\u0661x", "\0 \0a", "a\x1cb", " .\n\n.", "a\n\n b"]


def test_pieces_of_spaced_texts():
    """Every way of white space, against the libraries."""
    from tokenizers import Tokenizer

    g = np.random.default_rng(8)
    texts = [*SPACES, *("".join(g.choice(list("ab 's.\n1\u00e9\u00a0\u65e5"), 30)) for _ in range(400))]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    codec = bpe.Codec(bpe.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)
    mine = huffman.Tokenizer(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), P.PATTERN, 2)
    for text, one, other in zip(texts, codec.encode(texts), mine.encode(texts), strict=True):
        assert np.frombuffer(one, "<u4").tolist() == own.encode_ordinary(text) and codec.decode(one) == text.encode()
        assert np.frombuffer(other, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
    assert bpe.encoded(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_huffman(docs, none, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = f"{tmp_path}/coded"
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in huffman.coded(docs, P.path("byte_bpe_50k.json"), P.PATTERN, path).collect())
    at, want = 0, []
    for i in sorted([*range(len(TEXTS)), 5]):
        ids = [*own.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    # the files alone, in another process
    script = "import sys, zlib, numpy as np, pyarrow.parquet as pq; from framelake.llm.huffman import Codebook\nfor r in pq.read_table(sys.argv[1]).to_pylist(): print(r['doc_ids'], zlib.crc32(Codebook(np.frombuffer(zlib.decompress(r['code']), np.uint8)).decode(r['block']).astype('<u4').tobytes()))"
    lines_out = subprocess.run([sys.executable, "-c", script, path], capture_output=True, text=True, check=True).stdout.splitlines()
    ids = {i: [*own.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2] for i in range(len(TEXTS))}
    for line in lines_out:
        doc_ids, crc = line.rsplit(" ", 1)
        assert int(crc) == zlib.crc32(np.array([x for i in ast.literal_eval(doc_ids) for x in ids[i]], "<u4").tobytes())
    own.encode_special_tokens = True
    k = next(i for i, t in enumerate(TEXTS) if t and "<|endoftext|>" in t)
    got = huffman.coded(docs.where(f"doc_id = {k}"), P.path("byte_bpe_50k.json"), P.PATTERN, specials_as_text=True).first()
    assert got.n_tokens == len(own.encode(TEXTS[k], add_special_tokens=False).ids) + 1
    assert huffman.coded(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 3000])
def test_code_lengths(n):
    g = np.random.default_rng(n)
    counts = np.maximum(1, (1e6 / (1 + np.arange(n)) ** 2).astype(np.int64))
    sizes = huffman.lengths_of(counts, 12)
    assert sizes.max() <= 12 and (n == 1 or (2.0 ** -sizes).sum() == 1)
    book, ids = huffman.Codebook(sizes), g.integers(0, n, 1000)
    assert (book.decode(book.encode(ids)) == ids).all() and len(book.decode(book.encode(ids[:0]))) == 0
    damaged = bytearray(book.encode(ids))
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        book.decode(bytes(damaged))


def test_webp_images():
    g = np.random.default_rng(1)
    few = 0xFF000000 | g.integers(0, 4, (37, 53)) * 0x402010
    rich = g.integers(0, 256, (37, 53)) << 24 | np.cumsum(g.integers(0, 3, (37, 53)), 1) % 256 << 16 | np.cumsum(g.integers(0, 3, (37, 53)), 0) % 256 << 8 | g.integers(0, 9, (37, 53))
    for pixels, transforms in ((few, (3,)), (few, ()), (rich, (2,)), (rich, (0,)), (rich, (1,)), (rich, (0, 1, 2))):
        for cache in (0, 5):
            for meta in (0, 3):
                assert (webp.decode(webp.encode(pixels, transforms, cache, meta=meta)) == pixels).all()
    for mode in range(14):
        assert (webp.decode(webp.encode(rich, (0,), mode=mode)) == rich).all()
    for n in (1, 2, 3, 5, 17, 200):
        grey = 0xFF000000 | g.integers(0, n, (9, 21)) * 0x10101
        assert (webp.decode(webp.encode(grey, (3,))) == grey).all()
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxWEBPVP8 ")


def test_webp_of_another_encoder():
    """The one-pixel lossless file that web pages use to find out whether a browser reads the format."""
    pixel = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert pixel.shape == (1, 1) and pixel[0, 0] >> 24 == 0


def test_webp_forms():
    """Each step of the format is met by some text, short or long, and what is stored comes back."""
    texts = ["ab" * 40, "ab" * 4000, "ascii text of more than sixteen letters, at length " * 9, "été à Noël, là où ça brûle " * 9, "x", "", "abcdefghijklmnopqrstuvwxyz" * 2]
    texts += [f"text {k} of some length, with more than sixteen letters " * (1 + k % 40) for k in range(2000)]
    seen = {}
    for text in texts:
        payload, _ = webp.padded(text)
        form = webp.form_of(np.frombuffer(payload, np.uint8).astype(np.int64))
        step = "cache" if form.get("cache_bits") else form["transforms"][0]
        seen.setdefault(step, []).append(len(payload))
        if len(seen[step]) <= 8:
            assert webp.restored(webp.stored(payload), len(payload)) == payload
    assert set(seen) == {webp.PALETTE, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PREDICTOR, "cache"}
    assert max(seen[webp.PREDICTOR]) > 1000 and max(seen["cache"]) > 1000


def test_webp(docs, none):
    for r in webp.media(docs).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        want = raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert webp.media(none).count() == 0


def brute_jaccard(texts, width, percent):
    sets = []
    for t in texts:
        w = WORDS((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, none, width, percent):
    g = np.random.default_rng(percent)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = list(TEXTS)
    for size in (12, 60, 250, 700):
        base = [vocabulary[k] for k in g.integers(0, 300, size)]
        texts.append(" ".join(base))
        for _ in range(40):
            own = list(base)
            for k in g.integers(0, size, g.integers(0, 1 + size // 25)):
                own[k] = vocabulary[g.integers(0, 300)]
            texts.append(" ".join(own))
    df = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.grouped(df, width, percent).collect()}
    assert got == set(brute_jaccard(texts, width, percent))
    assert jaccard.grouped(none, width, percent).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_heads_of_different_lengths(spark, width, percent):
    """Sets of n shingles against n-1 of them, at exactly the threshold for n = 10 at 90 percent and n = 5 at 80."""
    texts = []
    for n in range(2, 26):
        for k in range(4):
            words = [f"v{n}x{k}x{i}" for i in range(n + width - 1)]
            texts += [" ".join(words), " ".join(words[:-1])]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.grouped(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), width, percent).collect()}
    assert got == set(brute_jaccard(texts, width, percent))


def test_lines(spark, docs, none):
    g, rows = np.random.default_rng(4), []
    for _ in range(12):
        line = "".join(g.choice(list("abcde é"), 60))
        for _ in range(5):
            own = list(line)
            for _ in range(g.integers(0, 4)):
                k = g.integers(0, len(own))
                own[k : k + g.integers(0, 2)] = list("xy"[: g.integers(0, 2)])
            rows.append("".join(own))
    texts = ["\n".join(g.choice(rows, 3)) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts), (40, None), (41, "")], "doc_id long, text string")

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1] <= 2

    places = [(d, k, line.strip(" ")) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if len(line.strip(" ")) >= 50]
    want = {(d, k) for i, (d, k, line) in enumerate(places) if any(near(line, other) for _, _, other in places[:i])}
    got = {(r.doc_id, r.no) for r in lines.dropped_lines(df).collect()}
    assert got == want and lines.deduplicated(df).count() == 42
    assert lines.deduplicated(none).count() == 0
    kept = lines.line_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() > 0


def test_jaccard_of_odd_ids(spark):
    """Null ids, and ids of several texts: links go by texts."""
    far = " ".join(f"q{k}" for k in range(40))
    rows = [(None, BASE), (7, BASE + " again"), (3, far), (3, BASE), (None, far + " q"), (None, "alone in its set"), (9, None), (9, ""), (3, BASE)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component int, n int")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.grouped(df).collect()), key=str)
    n = len(WORDS(BASE)) - 4
    assert got == sorted([(-1, n, 3), (7, n + 1, 3), (3, 36, 3), (3, n, 3), (-1, 37, 3), (-1, 1, None), (9, 0, 9), (9, 0, 9), (3, n, 3)], key=str)
    kept = jaccard.near_duplicate_stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("None", BASE), ("None", far + " q"), ("None", "alone in its set"), ("9", ""), ("9", "")])
    assert jaccard.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def edited(g, line, edits):
    own = list(line)
    for _ in range(edits):
        k = int(g.integers(0, len(own) + 1))
        kind = g.integers(0, 3)
        own[k : k + (kind > 0)] = ["#"] if kind < 2 else []
    return "".join(own)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_line_classes_and_hot_segments(spark):
    """Up to two edits anywhere, over all lengths of several classes; and segments that far more lines share than are compared at once."""
    g, texts, want = np.random.default_rng(6), [], set()
    for size in range(50, 128):
        base = "".join(g.choice(list("abcdefgh "), size - 1)) + "z"
        for edits in (0, 1, 2, 2, 2):
            texts.append(edited(g, base, edits).strip(" "))
    def links(group):
        return {(i, j) for n, i in enumerate(group) for j in group[:n] if texts[i] != texts[j] and min(len(texts[i]), len(texts[j])) >= 50 and distance(texts[i], texts[j]) <= 2}
    for k in range(0, len(texts), 5):
        want |= links(range(k, k + 5))
    start = len(texts)
    for _ in range(150):
        texts.append("the same beginning of a line of a form, then " + "".join(g.choice(list("abcd"), 7)) + " and its very same ending as well")
    want |= links(range(start, len(texts)))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, t int, dropped_lines int")
    _, firsts, found = lines.line_links(df.select("doc_id", "text"))
    first = {(r.a, r.b): r.first.doc_id for r in firsts.collect()}
    same = {i: texts.index(t) for i, t in enumerate(texts)}
    assert {frozenset((first[r.a, r.b], first[r.a2, r.b2])) for r in found.collect()} == {frozenset((same[i], same[j])) for i, j in want}
    kept = lines.line_dedup_stage(spark, df, "")
    gone = {max(p) for p in ({same[i], same[j]} for i, j in want)} | {i for i in same if same[i] != i}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(same) - gone


def test_lines_of_odd_ids(spark):
    """Null ids, and ids that stand for two texts, each lose their own repeated lines only."""
    rows = [(None, "first\nagain"), (1, "again\nown"), (1, "other\nagain"), (None, "last\nagain"), (1, "again\nown")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.text for r in lines.line_dedup_stage(spark, df, "").collect())
    assert len(kept) == 5 and sum("again" in t for t in kept) == 1 and sum("own" in t for t in kept) == 2


def test_short_lines(spark):
    """Exact repeats go at every length; short lines that only resemble each other, and blank ones, stay."""
    notice = "All rights reserved."
    texts = [f"{notice}\n\nx", f" {notice} \n\nAll rights reserved!", "x\ny\ny", notice, None, ""]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.no, r.keeper.doc_id, r.keeper.no) for r in lines.dropped_lines(df).collect()}
    assert got == {(1, 0, 0, 0), (2, 0, 0, 2), (2, 2, 2, 1), (3, 0, 0, 0)}
    assert {r.doc_id: r.text for r in lines.line_dedup_stage(spark, df.withColumn("n_chars", F.lit(0)), "").collect()} == {0: texts[0], 1: "\nAll rights reserved!", 2: "y", 4: None, 5: ""}


def test_edit_distance(spark):
    g = np.random.default_rng(2)
    pairs = [("".join(g.choice(list("abé"), g.integers(0, 40))), "".join(g.choice(list("abé"), g.integers(0, 40)))) for _ in range(100)]
    pairs += [(a, a[: len(a) // 2] + "z" + a[len(a) // 2 + 1 :]) for a, _ in pairs]
    df = spark.createDataFrame(pairs, "x string, y string")
    for k in (1, 2, 3):
        for r in lines.with_distance(df, "x", "y", k).withColumn("d", F.levenshtein("x", "y")).collect():
            assert r.distance == r.d if r.d <= k else r.distance > k


def test_mixture(spark, docs, none):
    assert mixture.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixture.targets([10, 1000, 0], [3, 1, 2]) == [30, 980, 0]
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixture.feistel(np.arange(n), n, 3).tolist()) == list(range(n))
    got = mixture.mixed(docs).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, mixture.mixed(docs).collect())) == sorted(map(tuple, got))
    assert all(r.size == len(WORDS(TEXTS[r.doc_id] or "")) for r in got)
    stage = mixture.mixture_stage(spark, docs, "")
    assert stage.columns == docs.columns and sum(len(WORDS(r.text)) for r in stage.collect()) == sum(r.taken for r in got)
    assert mixture.mixed(none).count() == 0


def plain_mix(rows, seed):
    """taken of each (doc_id, text, source) by loops over words; the hash of ids that orders a source comes from the operator."""
    names = sorted({r[2] for r in rows}, key=lambda n: (n is None, n or ""))
    size = [len(WORDS(r[1] or "")) for r in rows]
    total = [sum(n for n, r in zip(size, rows) if r[2] == name) for name in names]
    goal = mixture.goals(total, mixture.targets(total, [i % 3 + 1 for i in range(len(names))]))
    got = [0] * len(names)
    for shard in range(-(-sum(goal) // mixture.SHARD_SLOTS)):
        got = [a + int(b) for a, b in zip(got, mixture.drawn_counts(np.array(goal), shard, seed))]
    times = []
    for source, (n, words) in enumerate(zip(goal, total)):
        blocks = -(-words // mixture.BLOCK)
        count = [0] * blocks
        for slot in range(n):
            count[int(mixture.feistel(np.array([slot % blocks]), blocks, (source + seed) * 8 + slot // blocks)[0])] += 1
        times.append([c for c in count for _ in range(mixture.BLOCK)][:words])
    return names, total, times


def test_mixture_by_loops(spark):
    g = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(g.integers(0, 400))), ["a", "b", "c", "d", None][min(4, int(g.exponential(1)))]) for i in range(300)] + [(900, "one two three four five six seven eight nine ten", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names, total, times = plain_mix(rows, 20)
    spans, _ = mixture.spans(df)
    at = {r.doc_id: r.at for r in spans.collect()}
    got = {r.doc_id: r for r in mixture.mixed(df).collect()}
    for i, t, name in rows:
        n, k = len(WORDS(t)), names.index(name)
        assert got[i].taken == sum(times[k][at[i] : at[i] + n]) and got[i].source_size == total[k]
    for k, name in enumerate(names):
        taken, aim = sum(times[k]), mixture.targets(total, [i % 3 + 1 for i in range(len(names))])[k]
        assert abs(taken - aim) <= 2 * mixture.BLOCK and sum(got[i].taken for i, _, s in rows if s == name) == taken
    assert got[900].taken == 30


def test_toxicity(spark, docs, none):
    g = np.random.default_rng(0)
    plain = [f"word{k}" for k in range(60)]
    texts, labels = [], []
    for i in range(240):
        w = list(g.choice(plain, 60))
        if i % 3 == 0:
            w[g.integers(0, 60)] = f"vile{g.integers(0, 9)}"
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    net = toxicity.fit(zip(labels[:180], texts[:180], strict=True), steps=200)
    p = toxicity.Scorer(net).score(texts[180:])
    assert ((p >= 0.5) == np.array(labels[180:])).mean() >= 0.9
    got = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    assert got[0] == got[1] == got[2] == 0 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.scored(none, net).count() == 0
    long = toxicity.fit([(i % 2, " ".join(g.choice(plain, 2000)) + (" vile1" if i % 2 else "")) for i in range(20)] + list(zip(labels[:60], texts[:60], strict=True)), steps=60)
    assert long.p["word"].shape == net.p["word"].shape  # texts of many windows are learned from whole
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, toxicity.trained(docs, no_labels)).where("predicted = 1").count() == 0
    assert toxicity.without_toxic(docs, net).columns == docs.columns


def test_language(docs, none):
    g = np.random.default_rng(0)
    make = {"xx": lambda: "".join(g.choice(["ka", "ro", "mi"], 3)), "yy": lambda: "".join(g.choice(["st", "en", "ung"], 3))}
    texts, names = zip(*[(" ".join(make[n]() for _ in range(30)), n) for n in ["xx", "yy"] * 60], strict=True)
    field = language.fit(list(texts[:80]), list(names[:80]))
    got, scores = language.Labeller(field).label([*texts[80:], "", "12 !", texts[0] + " " + texts[1]])
    assert got[:-3] == list(names[80:]) and got[-3:-1] == ["und", "und"] and all(0 <= s <= 1 for s in scores)
    doc, p, _ = language.Labeller(field).words([texts[0] + " " + texts[1]])
    assert (p[:30, 0] > 0.5).mean() > 0.9 and (p[30:, 1] > 0.5).mean() > 0.9
    scores3, moves = g.normal(size=(4, 1, 2)), g.normal(size=(2, 2))
    import itertools

    weights = {y: np.exp(sum(scores3[k, 0, y[k]] for k in range(4)) + sum(moves[y[k - 1], y[k]] for k in range(1, 4))) for y in itertools.product((0, 1), repeat=4)}
    z = sum(weights.values())
    p, log_z, _ = language.forward_backward(scores3, np.ones((4, 1), bool), moves)
    assert np.isclose(log_z[0], np.log(z)) and all(np.isclose(p[k, 0, 1], sum(w for y, w in weights.items() if y[k]) / z) for k in range(4))
    assert {r.lang_pred for r in language.labelled(docs, field).where("doc_id < 3").collect()} == {"und"}
    assert language.labelled(none, language.trained(none)).count() == 0


def test_language_long_lines():
    """Marginals of a line in pieces are those of the line whole."""
    g = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    names = ["aa", "bb", "cc"]
    field = language.fit([" ".join(g.choice(words[10 * i : 10 * i + 20], 200)) for i in range(3) for _ in range(6)], [n for n in names for _ in range(6)])
    line = " ".join(g.choice(words, 3 * language.CHAIN + 17))
    texts = [line, "w1 w2 w3\n" + line, " ".join(g.choice(words, language.CHAIN)), "w5", " ".join(g.choice(words, 2 * language.CHAIN))]
    labeller = language.Labeller(field)
    _, p, _ = labeller.words(texts)
    at = 0
    for own in [x.split() for t in texts for x in t.split("\n")]:
        scores, _ = field.emissions(own)
        want, _, _ = language.forward_backward(scores[:, None, :].astype(np.float64), np.ones((len(own), 1), bool), field.moves)
        assert np.allclose(p[at : at + len(own)], want[:, 0], atol=1e-4)
        at += len(own)
    assert at == len(p) and field.moves[0, 0] > field.moves[0, 1]


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='ad'>Buy now</div><article><h1>Head &amp; tail</h1><p><b>First   line of\nthe text, long enough.<br><p>Second &eacute; line, long enough too.</p>"
        "<form><input>Name</form></article><div id='comments'><p>What a fine article, I liked it very much indeed.</p></div><footer>&copy; me</footer></body></html>"
    )
    want = "Head & tail\nFirst line of the text, long enough.\nSecond é line, long enough too."
    df = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "<p>", 0), (5, "u", "plain", 0)], "page_id long, url string, html string, text long")
    assert {r.page_id: r.text for r in html.extracted(df).collect()} == {1: want, 2: "", 3: "", 4: "", 5: "plain"}
    assert html.extracted(df.limit(0)).count() == 0


def test_html_labels():
    """Labels don't discard what holds the text, nor an article's header; whole names count, not pieces."""
    text = "".join(f"<p>Paragraph {k} of the text, long enough to be told from a menu.</p>" for k in range(3))
    want = "\n".join(f"Paragraph {k} of the text, long enough to be told from a menu." for k in range(3))
    side = "<div class='sidebar'><p>More of this kind</p></div>"
    for page in (
        f"<body class='has-sidebar'>{text}{side}</body>",
        f"<body class='sidebar'>{text}{side}</body>",
        f"<body><div class='content with-sidebar'>{text}</div>{side}</body>",
        f"<body><article class='post no-comments'>{text}</article>{side}</body>",
        f"<body><div class='content widget'>{text}</div>{side}</body>",
        f"<body><article>{text}</article><div class='cookie-notice'><p>We keep cookies here.</p></div></body>",
        f"<body><article>{text}</article><div id='comments'>{'<p>A comment that goes on for longer than the text itself does, and on.</p>' * 9}</div></body>",
    ):
        assert html.main_text(page) == want
    for name in ("entry-header", "article-header", "header"):
        assert html.main_text(f"<body><article><div class='{name}'><h1>Headline</h1></div>{text}</article></body>") == f"Headline\n{want}"


def test_html_of_odd_pages():
    """Names by their first or last word, comments inside the article that outweigh it, menus without a name, elements never closed."""
    text = "".join(f"<p>Paragraph {k} of the text, long enough to be told from a menu.</p>" for k in range(3))
    want = "\n".join(f"Paragraph {k} of the text, long enough to be told from a menu." for k in range(3))
    says = "<p>A comment that goes on for longer than a paragraph of the text does, and on and on.</p>"
    links = "".join(f"<li><a href='/{k}'>Item number {k}</a></li>" for k in range(5))
    for page in (
        f"<body><main>{text}<ol class='comment-list'>{''.join(f'<li>{says}</li>' for _ in range(6))}</ol></main></body>",
        f"<body><article>{text}<section class='post-comments'>{says * 2}</section></article></body>",
        f"<body><article>{text}<div id='comments-area'><div class='comment-body'>{says}</div></div></article></body>",
        f"<body><article><p>Paragraph 0 of the text, long enough to be told from a menu.</p><div class='ad-slot'>{says}</div>{text[len(text) // 3 :]}</article></body>",
        f"<body><div class='top-menu'>{links}</div>{text}<div class='site-footer'><p>All of it is ours, and none of it is yours, whoever you are.</p></div></body>",
        f"<body><nav><ul>{links}</ul>{text}</body>",
        f"<body><nav><ul>{links}</ul><article>{text}</article></body>",
        f"<body><nav><ul>{links}</ul><main>{text}</main></nav></body>",
        f"<body><header><p>Site of all kinds of things</p><article>{text}</article><footer>All of it is ours.</footer></body>",
        f"<body><div>{links}</div>{text}</body>",
        f"<body><article>{text}<ul>{links}</ul></article></body>",
        f"<form id='page'><main>{text}</main></form>",
    ):
        assert html.main_text(page) == want, page
    # one link on a line of its own is text in an article, and names that say otherwise label nothing
    assert html.main_text(f"<body><article>{text}<p><a href='/'>See also</a></p></article></body>") == want + "\nSee also"
    for name in ("no-comments", "comments-open", "with-sidebar", "has-footer"):
        assert html.main_text(f"<body><div class='{name}'>{text[: len(text) // 3]}</div><div>{text[len(text) // 3 :]}</div></body>") == want
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(html.main_text(f"<article>{long}</article>")) == 5 * 200_000 - 1 and html.main_text("<div>" * 5000 + text) == want


def test_html_of_known_text(spark):
    """Sixty pages of ten layouts around paragraphs that are known."""
    g = np.random.default_rng(9)

    def words(n):
        return " ".join("".join(g.choice(list("aeioulnrst"), g.integers(2, 9))) for _ in range(n)).capitalize() + "."

    def tags(name, texts):
        return "".join(f"<{name}>{t}</{name}>" for t in texts)

    menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(6)) + "</ul></nav>"
    pages, want = [], []
    for k in range(60):
        text = [words(int(g.integers(12, 60))) for _ in range(int(g.integers(2, 7)))]
        head, side, talk = words(5), words(6), "".join(f"<div class='comment'><p>{words(20)}</p></div>" for _ in range(3))
        title, body = f"<h1>{head}</h1>", tags("p", text)
        layouts = [
            f"<body class='home has-sidebar'>{menu}<article class='post comments-open'>{title}{body}</article><div class='sidebar'>{side}</div></body>",
            f"<body><header><a href='/'>Site</a></header><main>{title}{body}</main><footer>{side}</footer></body>",
            f"<body>{menu}<div id='share-page'><div class='entry'>{title}{body}</div></div><aside><p>{side}</p></aside></body>",
            f"<body>{menu}<div class='content'>{title}{tags('div', text)}</div><footer>{side}</footer></body>",
            f"<body>{menu}<article>{title}{body}<form><label>{side}</label><input></form></article><section id='comments'>{talk}</section></body>",
            f"<body><div class='cookie-notice'>{side}</div>{menu}<section>{title}{body}</section><script>var x = '<p>{side}</p>';</script></body>",
            f"<body>{menu}<article>{title}<section>{tags('p', text[:1])}</section><section>{tags('p', text[1:])}</section></article><div class='related'>{side}</div></body>",
            f"<body><div class='ad'>{side}</div><article><header>{title}</header>{body}<footer>{side}</footer></article></body>",
            f"<body>{menu}<main><div>{title}{tags('blockquote', text)}</div></main><aside>{side}</aside></body>",
            f"{menu}<article>{title}{tags('p', [t.replace(' ', ' <b>&amp;</b> ', 1) for t in text])}</article><footer>{side}</footer>",
        ]
        pages.append(layouts[k % 10])
        want.append("\n".join([head, *(t.replace(" ", " & ", 1) if k % 10 == 9 else t for t in text)]))
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(want))
    assert html.main_text("<div>First of two blocks, side by side, of one text.</div><div>Second of two blocks, side by side, of one text.</div>").count("\n") == 1


def test_additive(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(900, 16))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1100, [1.0] * 15 + [None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = additive.nearest(df).collect()
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10].tolist()
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(np.isclose(r.score, d[r.vec_id]) for r in own)
        hits += len({r.vec_id for r in own} & set(want))
        if q == 100:
            assert [r.vec_id for r in own] == want
    assert hits >= 81
    assert additive.nearest(df.limit(0)).count() == 0
    assert sorted(r.vec_id for r in additive.nearest(df.where("vec_id in (0, 1, 2)")).collect()) == [1, 2]


def test_additive_recall_at_size(spark):
    """50,000 vectors without clusters, where a fixed number of candidates would find 0.72 of the neighbours."""
    g = np.random.default_rng(4)
    x = g.normal(size=(50_000, 64))
    df = spark.range(len(x)).repartition(8).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tolist() for r in x[b.column(0).to_numpy()]], pa.list_(pa.float64()))], names=["vec_id", "embedding"]) for b in bs), "vec_id long, embedding array<double>")
    own = {}
    for r in additive.nearest(df, every=1000).collect():
        own.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 1000):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(own[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(own)
    # fewer than half of the rows are compared exactly; the share is measured on vectors the codebooks were not fitted on
    assert additive.fitted(additive.usable(df), 10)[3] < 0.5


def test_additive_passes(spark, monkeypatch):
    """Queries that need several passes, and an index in many batches, give the same."""
    x = np.random.default_rng(6).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    own = sorted(map(tuple, additive.nearest(df, every=10).collect()))
    monkeypatch.setattr(additive, "BROADCAST_BYTES", 1000)
    assert sorted(map(tuple, additive.nearest(df.repartition(9), every=10).collect())) == own and len(own) == 600


def test_training_sample_is_bounded(spark):
    """A doc_id that repeats gives one text; whole texts are taken up to the bytes of their class, the same whatever the order."""
    from framelake.llm.common import training_texts

    rows = [(1, f"text {k}") for k in range(10_000)] + [(k, f"own {k} " + "x" * 100) for k in range(2, 40)] + [(40, "y" * 5000), (41, None), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(k, k % 2) for k in range(1, 42)], "doc_id long, y int")
    whole = list(training_texts(docs, ids, 1 << 20))
    assert len(whole) == 40 and sum(t.startswith("text") for _, t in whole) == 1 and ("y" * 5000) in {t for _, t in whole}
    few = list(training_texts(docs.repartition(7), ids, 4000))
    assert sum(len(t) for y, t in few if y) <= 2000 and sum(len(t) for y, t in few if not y) <= 2000 and len(few) > 20
    assert few == list(training_texts(docs.repartition(3), ids, 4000))
    assert list(training_texts(docs, ids.where("false"), 4000)) == []


def test_toxicity_gradients():
    """Gradients against differences of the loss."""
    import zlib as z

    g = np.random.default_rng(z.crc32(b"g"))
    net = toxicity.Network({k: v.astype(np.float64) for k, v in toxicity.Network.new(1).p.items()})
    x = g.normal(0, 1, (30, toxicity.WIDTH))
    at = np.where(np.arange(8) < np.array([[8], [5], [3]]), g.integers(0, 30, (3, 8)), -1)
    weights = np.array([1.0, -2.0, 0.5])
    loss = lambda: float(net.run(net.inputs(x).astype(np.float64), at) @ weights)
    rows = net.inputs(x).astype(np.float64)
    _, kept = net.run(rows, at, keep=True)
    grads, d_rows = net.grads(rows, at, kept, weights)
    for name in ("out", "att", "Uf", "Ub", "bias"):
        flat = net.p[name].reshape(-1)
        for k in g.integers(0, flat.size, 6):
            old, eps = flat[k], 1e-2
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[k]) < 2e-2 * max(1, abs(grads[name].reshape(-1)[k])), (name, k)
    part = x.T @ d_rows[:-1, : 3 * toxicity.HIDDEN]
    k, j = 3, 4
    old, eps = net.p["Wf"][k, j], 1e-2
    net.p["Wf"][k, j] = old + eps
    up = loss()
    net.p["Wf"][k, j] = old - eps
    down = loss()
    assert abs((up - down) / (2 * eps) - part[k, j]) < 2e-2 * max(1, abs(part[k, j]))
