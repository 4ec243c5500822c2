"""Lemmas by rules against a plain version, with both ways of meeting the forms."""

import pytest

from corpuspulse.operators import lemmas as L

VOCAB = ["car", "bus", "glass", "box", "wolf", "man", "city", "church", "dish", "go", "make", "run", "us", "u", "as", "goose", "child", "car", "", None]
EXCEPTIONS = [("geese", "goose"), ("children", "child"), ("children", "missing"), ("mens", "nothing"), (None, "car"), ("buses", None)]
WORDS = ["cars", "car", "buses", "bus", "glasses", "boxes", "wolves", "men", "cities", "churches", "dishes", "geese", "children", "us", "gos", "makes",
         "mens", "unknowns", "s", "", None, "as"]


def lemma_of(word, rules=L.NOUN_RULES):
    vocab = {v for v in VOCAB if v}
    named = [b for a, b in EXCEPTIONS if a == word and b is not None]
    made = named if named else [word[:len(word) - len(s)] + r for s, r in rules if word.endswith(s)]
    found = [c for c in [word, *made] if c in vocab]
    return min(found, key=len) if found else word


@pytest.mark.parametrize("shipped", [1000, 3])
def test_lemmas_equal_the_plain_rules(spark, shipped):
    vocab = spark.createDataFrame([(v,) for v in VOCAB], "word string")
    exceptions = spark.createDataFrame(EXCEPTIONS, "form string, lemma string")
    rows = [(1, WORDS, "x"), (1, WORDS[::-1], "x"), (2, [], "y"), (None, None, "z"), (3, ["cars"] * 5000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, t array<string>, lemma string").repartition(3)
    got = L.lemmatize(df, "t", L.lemma_forms(vocab, exceptions=exceptions), shipped=shipped)
    assert got.columns == ["doc_id", "t", "lemma"]
    want = [(i, None if t is None else [w if w is None else lemma_of(w) for w in t], x) for i, t, x in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    kept = L.lemmatize(df, "t", L.lemma_forms(vocab, exceptions=exceptions), out="lemmas", shipped=shipped)
    assert kept.columns == ["doc_id", "t", "lemma", "lemmas"]


def test_empty_tables(spark):
    vocab = spark.createDataFrame([], "word string")
    df = spark.createDataFrame([(1, ["cars"])], "doc_id long, t array<string>")
    assert L.lemma_forms(vocab).collect() == []
    assert L.lemmatize(df, "t", L.lemma_forms(vocab)).first().t == ["cars"]
    assert L.lemmatize(df.limit(0), "t", L.lemma_forms(spark.createDataFrame([("car",)], "word string"))).collect() == []


def test_many_forms_meet_each_part_of_the_rows_by_its_own_words(spark, monkeypatch):
    from pyspark.sql import DataFrame
    rows = [(i if i % 5 else None, None if i % 7 == 0 else [] if i % 7 == 1 else [f"w{(i * j) % 40}s" if j % 3 else None for j in range(i % 9)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, t array<string>").repartition(5)
    forms = spark.createDataFrame([(f"w{j}s", f"w{j}") for j in range(0, 40, 2)], "form string, lemma string")
    exploded, by = [], DataFrame.groupBy
    monkeypatch.setattr(DataFrame, "groupBy", lambda self, *c: exploded.append(c) or by(self, *c))
    got = L.lemmatize(df, "t", forms, shipped=5).collect()
    assert not exploded   # no token is gathered by row
    of = {f"w{j}s": f"w{j}" for j in range(0, 40, 2)}
    want = [(i, None if t is None else [of.get(w, w) for w in t]) for i, t in rows]
    assert sorted(map(repr, ((r.doc_id, r.t) for r in got))) == sorted(map(repr, want))
