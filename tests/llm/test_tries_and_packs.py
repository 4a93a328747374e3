"""Conversation trie, filter audit and packing against brute force, on nulls, empties, ties, repeats, extra columns and no rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest

from framelake.llm import filters, packing, trie

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 64, 65, 700, 5000])
def test_findclose(n):
    g = np.random.default_rng(n)
    for deep in (0.3, 0.5, 0.9):
        bits, open_ = [], 0
        for k in range(2 * n):
            more = open_ == 0 or (open_ < 2 * n - k and g.random() < deep)
            bits.append(more)
            open_ += 1 if more else -1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert trie.Parens(np.array(bits)).findclose(at).tolist() == [want[i] for i in at.tolist()]


def plain_trie(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in talks.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members, children, leaves, saved, ends = defaultdict(list), Counter(), Counter(), Counter(), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def of_trie(df):
    assert set(NODE) <= set(df.columns)
    return Counter(tuple(r[c] for c in NODE) for r in df.collect())


def test_trie(spark):
    g = np.random.default_rng(3)
    rows = [(None, 0, "user", "nobody's"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, "", "tie"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (-3, 1, "user", "é" * 2000)]
    rows += [(c, t, "user", "long") for c in (300, 301) for t in range(250)]  # the same long talk twice
    for c in range(90):
        for t in range(int(g.integers(0, 12))):
            rows.append((c + 10, t, ["user", "assistant"][t % 2], str(g.integers(0, 2 if t < 4 else 30))))
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, n long, key string")
    want = plain_trie(rows)
    assert len(want) > 300
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "37"):  # shards from one to many, so that spines merge
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert of_trie(trie.tried(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert trie.tried(df.where("false")).count() == 0
    assert of_trie(trie.tried(df.where("conv_id = 7"))) == plain_trie([r for r in rows if r[0] == 7])


def test_trie_of_turnless(spark):
    rows = [(c, 0, "user", "gone") for c in range(1, 40) if c % 5]  # no family has its first conversation
    got = trie.tried(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert of_trie(got) == plain_trie(rows) and any(r.depth == 0 and r.ends_sha256 != trie.NONE for r in got.collect())


def test_trie_query(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert of_trie(trie.op11_prefix_trie(spark, SF)) == plain_trie(rows)


def plain_audit(docs, labels):
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for i, text, lang in docs:
        t = text or ""
        w = WORDS(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        for o in map("".join, permutations("ABCDE")):
            gone = False
            for k, f in enumerate(o, 1):
                c = out.setdefault((lang or "", o, k), Counter())
                here = fails[f] and not gone
                c["redundant"] += fails[f] and gone
                gone |= fails[f]
                c["kept"] += not gone
                c["removed"] += here
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
    for (part, o, k), c in out.items():
        c["shapley"] = sum(x["removed"] for (p, q, j), x in out.items() if p == part and q[j - 1] == o[k - 1])
    return {k: tuple(c[x] for x in (*filters.COUNTS, "shapley")) for k, c in out.items()}


def test_filter_audit(spark):
    plain = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", " \t\n", plain, plain, plain + " #", "A" * 50 + plain.upper(), "a b " * 60, "x | y", plain + " end", "é" * 3000, "\x85 one word", "A \x1c B \x0b c"]
    docs = [(i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts)] + [(4, plain, "de"), (None, plain, "en"), (None, "only here", "en"), (2, plain, "en")]
    labels = [(0, 1, None), (4, 0, 1), (4, 1, 0), (5, 1, 1), (None, 1, 1), (6, None, None), (99, 1, 1)]
    d = spark.createDataFrame([(*r, 5, 1, "p") for r in docs], "doc_id long, text string, lang string, n long, mask int, part string")
    own = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, mask int")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filters.COUNTS, "shapley")) for r in filters.audited(d, own).collect()}
    assert got == plain_audit(docs, labels) and len(got) == 3 * 600
    assert filters.audited(d.where("false"), own).count() == 0
    assert filters.audited(d, own.where("false")).count() == 1800


def test_filter_audit_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = filters.op12_filter_audit(spark, SF)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(c.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({filters.OP12_SQL})").fetchall())


def test_fullest_bins():
    g = np.random.default_rng(5)
    for _ in range(60):
        counts, room = [0, *g.integers(0, 3, 12).tolist()], int(g.integers(1, 40))
        sums = {0}
        for k, n in enumerate(counts):
            sums |= {s + k * j for s in sums for j in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room) and all(got.count(k) <= counts[k] for k in set(got))
        assert sum(got) - 3 <= sum(packing.fullest(counts, room, 3)) <= room
    counts = np.append(0, g.integers(0, 10**12, 64))
    plan = packing.bins(counts)
    assert len(plan) < 64 * 9 and sum(sum(own) * n for own, n in plan) == (np.arange(65) * counts).sum()


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    g = np.random.default_rng(2)
    texts = [None, "", "a", "one two three", "word " * 1023, "word " * 1024, "word " * 5000, "é\n\n日本 <|endoftext|>"] + ["ab cd " * int(n) for n in g.integers(0, 700, 60)] + ["the same text"] * 300
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one two three"), (None, "of nobody"), (None, None)]
    df = spark.createDataFrame([(*r, 1, 9, "k") for r in rows], "doc_id long, text string, length long, number long, part string").repartition(5)
    got = packing.packed(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) == -(-sum(r.length for r in got) // 1024)
    assert packing.packed(df.where("false"), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert [(r.sequence_id, r.offset) for r in packing.packed(df.where("doc_id = 0"), P.path("byte_bpe_50k.json"), P.PATTERN).collect()] == [(0, 0)]
