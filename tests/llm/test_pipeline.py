"""The pipeline's stages on small fixtures, against plain loops over the same texts."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from framelake.llm import lines, mixture, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dropped_lines string, t int, component int, size long"


def rows_of(texts):
    return [(i, t, "en", ["s1", "s2", None][(i or 0) % 3], len(t or ""), "x", 1, 2, 3) for i, t in texts]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    g = np.random.default_rng(3)
    plain = [f"word{k}" for k in range(80)]
    notice = "Notice that stands in many of these documents, over and over again."
    texts = []
    for i in range(120):
        own = " ".join(g.choice(plain, 40)) + " vile" * (i % 4 == 0)
        texts.append((i, own + (f"\n{notice}" if i % 5 == 1 else "")))
    texts += [(200, texts[1][1].split("\n")[0] + " more"), (201, texts[1][1].split("\n")[0]), (202, None), (203, ""), (204, "short"), (None, "of no id " + texts[2][1]), (205, " ".join(["long"] * 30_000))]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, texts


def test_stages_keep_columns(spark, corpus):
    folder, docs, _ = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_toxicity_stage(spark, corpus):
    folder, docs, texts = corpus
    net = toxicity.trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = toxicity.Scorer(net).score([t or "" for _, t in texts])
    want = sorted((t or "") for (_, t), s in zip(texts, scores, strict=True) if s < 0.5)
    kept = sorted((r.text or "") for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, folder).collect())
    assert kept == want and 20 < len(kept) < len(texts)


def test_line_dedup_stage(spark, corpus):
    """Exact repeats, by a loop; the texts' other lines differ far more than by two edits, but for those that are equal."""
    folder, docs, texts = corpus
    seen, want = set(), []
    for _, t in sorted(texts, key=lambda x: (x[0] is not None, x[0])):
        kept = []
        for line in (t or "").split("\n"):
            own = line.strip(" ")
            if not own or own not in seen:
                kept.append(line)
            seen.add(own)
        new = "\n".join(kept)
        if t is None or new == t:
            want.append(t or "")
        elif new.strip(" "):
            want.append(new)
    got = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, folder).collect()
    assert sorted(r.text or "" for r in got) == sorted(want)
    assert all(r.n_chars == len(r.text or "") for r in got if r.text is not None)
    assert lines.EDITS == 2


def test_near_duplicate_stage(spark, corpus):
    folder, docs, texts = corpus

    def shingles(t):
        w = [x.lower() for x in WORDS(t or "")]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if x in (a, b) else x for x in group]
    best = {}
    for k, (i, _) in enumerate(texts):
        if sets[k]:
            best.setdefault(group[k], []).append((i is not None, i))
    want = sorted((str(i), t or "") for k, (i, t) in enumerate(texts) if not sets[k] or (i is not None, i) == min(best[group[k]]))
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, folder).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == want and len(want) < len(texts)


def test_mixture_stage(spark, corpus):
    folder, docs, texts = corpus
    taken = {r.doc_id: r.taken for r in mixture.mixed(docs).collect()}
    words = {}
    for r in dict(corpus_pipeline.STAGES)["mixture"](spark, docs, folder).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORDS(r.text))
    assert {i: n for i, n in taken.items() if n} == words


def test_run(spark, corpus):
    folder, _, _ = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(got) > 0
    for r in got:
        text = own.decode(r.ids)
        assert own.encode_ordinary(text) == r.ids and hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
