"""Phrases found through their rarest gram, against plain ``in``; and the segmented carry-forward against a plain loop."""

import random

import pytest

from corpuspulse.operators import gram_index as G


def expected(texts, phrases):
    out = []
    for i, t in texts:
        best = {}
        for topic, pos, k in phrases:
            if t is not None and k in t:
                best[topic] = min(best.get(topic, (pos, k)), (pos, k))
        out += [(str(i), topic, pos, k) for topic, (pos, k) in best.items()]
    return sorted(out)


def data(seed=1):
    rng = random.Random(seed)
    letters = "ab é中"
    texts = [(rng.choice([1, 2, 3, None]), "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    texts += [(7, None), (8, ""), (9, "ab"), (9, "ab"), (10, "the end"), (11, "x" * 50_000 + "needle" + "y" * 1000), (12, "\U0001f600 smile")]
    phrases = [(f"t{rng.randint(0, 9)}", rng.randint(0, 5), "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))) for _ in range(150)]
    phrases += [("n", 0, "needle"), ("n", 1, "xneedle"), ("e", 0, "\U0001f600"), ("end", 0, "end"), ("end", 0, "e end"), ("a", 2, "a"), ("a", 2, "ab")]
    return texts, sorted(set(phrases))


@pytest.mark.parametrize("keys, chunk", [(1 << 20, 1 << 22), (3, 1 << 22), (1 << 20, 50)])
def test_hits_equal_plain_search(spark, monkeypatch, keys, chunk):
    monkeypatch.setattr(G, "MAX_KEYS", keys)
    monkeypatch.setattr(G, "CHUNK", chunk)
    texts, phrases = data()
    t = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kw = spark.createDataFrame(phrases, "topic string, pos int, keyword string")
    got = sorted((str(r.doc_id), r.topic, r.pos, r.keyword) for r in G.phrase_hits(t, kw, "text", ["doc_id"]).collect())
    assert got == expected(texts, phrases)


def test_empty_inputs(spark):
    texts, phrases = data()
    t = spark.createDataFrame(texts, "doc_id long, text string")
    kw = spark.createDataFrame(phrases, "topic string, pos int, keyword string")
    assert G.phrase_hits(t, kw.limit(0), "text", ["doc_id"]).collect() == []
    assert G.phrase_hits(t.limit(0), kw, "text", ["doc_id"]).collect() == []


def test_texts_are_not_shuffled(spark):
    t = spark.range(100).selectExpr("id as doc_id", "concat('some text ', id) as text")
    kw = spark.createDataFrame([("n", 0, "text 7")], "topic string, pos int, keyword string")
    out = G.phrase_hits(t, kw, "text", ["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 11 and plan.count("MapInArrow") >= 1 and "Generate explode" not in plan


def test_common_short_grams_hand_on_no_places(spark):
    """Every four bytes of the phrase are common in the text, seven are not: no place leaves the row."""
    text = " ".join(f"{g}{i:04d}" for i in range(200) for g in ("abcd", "bcde", "cdef", "defg", "efgh"))
    t = spark.createDataFrame([(1, text), (2, "an abcdefgh")], "doc_id long, text string")
    kw = spark.createDataFrame([("n", 0, "abcdefgh")], "topic string, pos int, keyword string")
    keyed = G.keyed_phrases(kw, G._rarity(t, "text", [G.GRAM]))
    assert G.snippets(t, "text", ["doc_id"], G._filter_of(keyed), [G.GRAM]).count() == 1
    assert [tuple(r) for r in G.phrase_hits(t, kw, "text", ["doc_id"]).collect()] == [(2, "n", 0, "abcdefgh")]
    assert G.CHUNK <= 1 << 18  # hits are handed on after so many bytes, so a task holds no more of them


@pytest.mark.parametrize("carried, piece, chunk, pairs", [(1 << 30, 1, 1 << 18, 1 << 18), (1 << 30, 1, 50, 3), (0, 1 << 26, 50, 1 << 18)])
def test_pieces_and_join_equal_plain_search(spark, monkeypatch, carried, piece, chunk, pairs):
    """Phrases in many pieces, one topic over several of them, and phrases that do not travel give the same rows."""
    monkeypatch.setattr(G, "CARRIED_BYTES", carried)
    monkeypatch.setattr(G, "PIECE_BYTES", piece)
    monkeypatch.setattr(G, "CHUNK", chunk)
    monkeypatch.setattr(G, "PAIRS", pairs)
    texts, phrases = data(2)
    phrases = sorted({("t" if t < "t5" else t, pos, k) for t, pos, k in phrases})
    pieces = []
    monkeypatch.setattr(G, "_piece", lambda table, last, whole=G._piece: pieces.append(len(table)) or whole(table, last))
    t = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kw = spark.createDataFrame(phrases, "topic string, pos int, keyword string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = sorted((str(r.doc_id), r.topic, r.pos, r.keyword) for r in G.phrase_hits(t, kw, "text", ["doc_id"]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(texts, phrases)
    assert len(pieces) > 5 if carried else not pieces


def test_hits_are_not_shuffled(spark):
    """The rows of texts and phrases that meet leave the texts' tasks only as results; a sum over them moves one row a text."""
    t = spark.range(50).selectExpr("id as doc_id", "array_join(transform(sequence(0, 400), x -> concat('word', x * (id + 1))), ' ') as text")
    kw = spark.range(3000).selectExpr("concat('word', id) as topic", "1 as pos", "concat('word', id) as keyword")
    out = G.phrase_hits(t, kw, "text", ["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    expect = sum(f"word{k}" in " ".join(f"word{x * (i + 1)}" for x in range(401)) for i in range(50) for k in range(3000))
    assert out.count() == expect
