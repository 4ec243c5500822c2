"""The learned text encoder: counts, products and vectors against numpy, and neighbours against hashed buckets."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuspulse.operators import clusters as C
from corpuspulse.operators import embedding as E

SF = "/root/testdata/sf0.01"
TEXTS = [(1, "Red car, blue car; red truck für Öl"), (2, "blue truck red car"), (3, None), (4, ""), (5, "— !!"), (6, "für öl 中文 für"),
         (7, "car"), (8, "red blue red blue red"), (None, "truck car red"), (7, "unseen words only once"), (9, "car " * 70_000)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def counted(rows, window):
    n = Counter(w for _i, t in rows for w in tokens(t))
    words = [w for w, c in sorted(n.items(), key=lambda x: (-x[1], x[0].encode())) if c >= 2]
    at = {w: k for k, w in enumerate(words)}
    pairs = Counter()
    for _i, t in rows:
        ts = tokens(t)
        for p, a in enumerate(ts):
            for b in ts[p + 1:p + 1 + window]:
                if a in at and b in at:
                    pairs[at[a], at[b]] += 1
                    pairs[at[b], at[a]] += 1
    return words, n, pairs


def dense_ppmi(words, pairs):
    m = np.zeros((len(words), len(words)))
    side = Counter()
    for (i, _j), c in pairs.items():
        side[i] += c
    total = sum(pairs.values())
    for (i, j), c in pairs.items():
        m[i, j] = max(0.0, math.log(c * total / (side[i] * side[j])))
    return m


def test_counts_information_and_products(spark):
    words, n, pairs = counted(TEXTS, 3)
    df = docs(spark)
    vocab = E.vocabulary(df).collect()
    assert [(r.idx, r.word, r.n) for r in sorted(vocab)] == [(k, w, n[w]) for k, w in enumerate(words)]
    got = E.cooccurrence(df, E.vocabulary(df), window=3)
    assert {(r.i, r.j): r.n for r in got.collect()} == dict(pairs)
    m = dense_ppmi(words, pairs)
    cells = {(r.i, r.j): r.v for r in E.ppmi(got).collect()}
    assert set(cells) == {(i, j) for i, j in zip(*np.nonzero(m))} and all(abs(m[k] - v) < 1e-12 for k, v in cells.items())
    thin = np.random.default_rng(1).standard_normal((len(words), 3))
    out = E._product(E.sparse_rows(E.ppmi(got)), thin)
    assert np.abs(out - m @ thin).max() < 1e-10


def test_word_vectors_are_the_leading_singular_directions(spark):
    rng = np.random.default_rng(5)
    low = rng.standard_normal((60, 6)) * np.array([9, 7, 5, 4, 3, 2])
    m = np.abs(low @ low.T)
    m = (m + m.T) / 2
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i int, j int, v double")
    got = E.word_vectors(E.sparse_rows(cells), 60, dim=5, rounds=12)
    w, v = np.linalg.eigh(m)
    order = np.argsort(-np.abs(w))[:5]
    want = v[:, order] * np.sqrt(np.abs(w[order]))
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-5 * np.abs(want).max()


def test_text_vectors_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(E, "TOKENS_AT_ONCE", 1_000)   # a text over many pieces
    df = docs(spark)
    words, n, _pairs = counted(TEXTS, 4)
    vectors = np.random.default_rng(2).standard_normal((len(words), 4))
    model = E.encoder(E.vocabulary(df), vectors)
    total = sum(n[w] for w in words)
    got = sorted(((r.doc_id, r.embedding) for r in E.encode(df, model, unit=False).collect()), key=str)
    want = []
    for i, t in TEXTS:
        known = [w for w in tokens(t) if w in words]
        mean = sum((E.RARE / (E.RARE + n[w] / total) * vectors[words.index(w)] for w in known), np.zeros(4)) / max(len(known), 1)
        want.append((i, None if t is None else mean.tolist()))
    for (i, a), (j, b) in zip(got, sorted(want, key=str)):
        assert i == j and ((a is None and b is None) or np.allclose(a, b, atol=1e-9))


def test_learning_from_awkward_tables(spark):
    out = {}
    for r in E.embed_learned(docs(spark), dim=4).collect():
        out.setdefault(r.doc_id, []).append(r.embedding)
    assert out[3] == [None] and out[4] == [[0.0] * 4] == out[5]
    assert all(v is None or len(v) == 4 and (not any(v) or abs(np.linalg.norm(v) - 1) < 1e-5) for vs in out.values() for v in vs)
    assert E.embed_learned(docs(spark, []), dim=4).collect() == []
    assert [r.embedding for r in E.embed_learned(docs(spark, [(1, None), (2, "a b")]), dim=4).collect()] == [None, [0.0] * 4]
    with pytest.raises(ValueError):
        E.vocabulary(docs(spark), size=E.MAX_WORDS + 1)


def same_language(vectors, langs, k=10):
    x = np.array(vectors)
    near = np.argsort(-(x @ x.T - 9 * np.eye(len(x))), axis=1)[:, :k]
    return (np.array(langs)[near] == np.array(langs)[:, None]).mean()


def test_neighbours_beat_hashed_buckets(spark):
    """Measure: of the ten nearest opening lines (six words), the share in the same language."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = E.fit_encoder(d, dim=64)
    lines = d.where("text is not null").select("doc_id", "lang", F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ").alias("text")).dropDuplicates(["text"])
    langs = {r.doc_id: r.lang for r in lines.collect()}

    def share(df):
        got = [(langs[r.doc_id], r.embedding) for r in df.collect() if r.embedding is not None and any(r.embedding)]
        return same_language([v for _l, v in got], [lang for lang, _v in got])
    learned, hashed = share(E.encode(lines, model)), share(C.embed_text(lines, "text", 64))
    print(f"same language: learned {learned:.3f}, hashed {hashed:.3f}")
    assert learned > hashed + 0.02


def test_counting_hands_on_sums_of_pairs_and_not_the_pairs(spark, monkeypatch):
    words, _n, pairs = counted(TEXTS, 4)
    df = docs(spark)
    got = E.cooccurrence(df, E.vocabulary(df))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # pairs are met and summed in numpy, none is a row before
    assert {(r.i, r.j): r.n for r in got.collect()} == dict(pairs)
    monkeypatch.setattr(E, "TOKENS_AT_ONCE", 5)
    monkeypatch.setattr(E, "PAIRS_HELD", 3)
    few = [r for r in TEXTS if r[0] != 9]
    df = docs(spark, few)
    assert {(r.i, r.j): r.n for r in E.cooccurrence(df, E.vocabulary(df)).collect()} == dict(counted(few, 4)[2])
    assert E.cooccurrence(df, E.vocabulary(df).limit(0)).collect() == []
