"""Quality rules, licences, tool calls, neighbours, the pipeline and the query registry."""

import json
import random
import re

from collections import Counter

import numpy as np
import pytest
from .cases import WORD, frame, texts
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corpuspulse.llm import ann, licences, quality_rules, tool_calls

SF = "/root/testdata/sf0.001"


def signals_of(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def test_quality_signals_and_verdicts(spark):
    rows = texts(11) + [(300, "a b c a b c a b c x"), (301, "l\nl\n \nl "), (302, "#$ | <x> *"), (303, "a a a a"),
                          (304, " ".join(f"x{i % 40} y{i % 40}" for i in range(200)))]
    rows += [(400 + i, f"good words number {i} " * 20) for i in range(5)]
    labels = spark.createDataFrame([(400, 1, 0), (401, 1, 0), (0, 0, 0), (None, 1, 0), (402, None, None)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(frame(spark, rows), labels, rec=True).collect()
    want = sorted(map(str, ((i, *signals_of(t)) for i, t in rows)))
    assert sorted(map(str, ((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out))) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(frame(spark, []), labels).count() == 0
    assert {r.llr for r in quality_rules.quality_rules(frame(spark, rows), labels.limit(0)).collect()} == {0.0}


def test_likelihood_ratio_by_brute_force(spark):
    rows = [(i, " ".join(random.Random(i).choice(["red", "blue!", "green", "|"]) for _ in range(30))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = {r.id: r.llr for r in quality_rules.quality_rules(docs, labels, buckets=64).collect()}
    grams = {r.doc_id: r.g for r in docs.select("doc_id", F.transform(
        quality_rules.gram_hashes(F.col("text")), lambda h: quality_rules.bucket(h, 64)).alias("g")).collect()}
    tokens = {i: re.findall(quality_rules.TOKEN, t) for i, t in rows}
    assert all(len(grams[i]) == 2 * len(tokens[i]) - 1 for i in grams)
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i % 2:
            good.update(g)
    n_raw, n_good = sum(raw.values()) + 64, sum(good.values()) + 64
    for i, g in grams.items():
        want = np.mean([np.log((good[b] + 1) / n_good) - np.log((raw[b] + 1) / n_raw) for b in g])
        assert abs(got[i] - want) < 1e-5


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_every_trusted_document_counts(spark, limit):
    """Above 20,000 trusted documents too, by a shuffled and by a broadcast join, NULL ids apart."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "'red' as text").unionByName(
        spark.range(10).selectExpr("cast(null as long) as doc_id", "'green' as text"))
    labels = spark.range(25_000).selectExpr("id as doc_id", "1 as quality")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        weights = quality_rules.fit_weights(docs, quality_rules.trusted_ids(labels), buckets=2, smooth=1.0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    of = {r.text: r.b for r in docs.select("text", quality_rules.bucket(quality_rules.gram_hashes(F.col("text"))[0], 2).alias("b")).distinct().collect()}
    raw, good = [0, 0], [0, 0]
    raw[of["red"]] += 30_000
    raw[of["green"]] += 10
    good[of["red"]] += 25_000
    want = [round(1e6 * (np.log((g + 1) / 25_002) - np.log((r + 1) / 30_012))) for r, g in zip(raw, good)]
    assert weights == want


def test_licences_by_brute_force(spark):
    rows = texts(12) + [(500, "Released under the\nMIT License! Under the MIT license"), (501, "x cc-by-nc CC BY NC cc by nc"), (502, "cc by ncx"),
                        (503, "Licence: redistribution, and use in source and binary forms; with modification are permitted"),
                        (504, "under the mit license"), (505, "this work is licensed under GNU general public license version 3\nother"),
                        (506, "Apache License, Version 2.0 apache license version 2")]
    out = {str((r.id, r.n_words)): r for r in licences.scan_licences(frame(spark, rows)).collect()}
    templates = [(label, set(licences.word_set(t))) for label, t in licences.TEMPLATES]
    for i, t in rows:
        fold = lambda s: s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(licences.WORD, fold(t or ""))
        places = [(k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        found = []
        for number, line in enumerate((t or "").split("\n")):
            have = {x.encode() for x in re.findall(licences.WORD, fold(line))}
            found += [(number, label, k, len(have & s) / len(s)) for k, (label, s) in enumerate(templates) if len(have & s) / len(s) >= licences.THRESHOLD - 1e-9]
        r = out[str((i, len(w)))]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert r.labels == ",".join(sorted({p[1] for p in places} | {f[1] for f in found}))
        assert sorted((b.line, b.label, b.template, b.containment) for b in r.blocks) == sorted(found)
        assert r.score == (1.0 if places else max((f[3] for f in found), default=0.0))
    assert licences.scan_licences(frame(spark, [])).count() == 0


def call(i, after=(), args=None, name="reply"):
    return {"id": i, "name": name, "arguments": args or {"words": 5, "turn": 1, "prompt": "a b c d e"}, "after": list(after)}


def test_tool_calls(spark):
    say = json.dumps
    rows = [(1, 0, say({"tool_calls": [call("a"), call("b", ["a"]), call("c", ["a", "b"]), call("d", ["d"]), call("e", ["d"]), call("f", ["zz"])]})),
            (1, 1, say({"tool_call_id": "a", "content": 'x"y'})), (1, 2, say({"tool_call_id": "a", "content": "later"})),
            (2, 0, say({"tool_calls": [call("a"), call("a", ["a"])]})), (2, 1, None), (2, 2, "{bad"), (2, 3, ""), (2, 4, "[1]"),
            (None, 0, say({"tool_calls": [call("q", name="other", args={"z": 1})]})), (None, None, say({"tool_call_id": "q", "content": None})),
            (3, 0, say({"tool_calls": [call(str(i), [str(i - 1)]) for i in range(40)]})),
            (4, 0, say({"tool_calls": [call("x", ["y"]), call("y", ["x"]), call("z", ["y"])]})),
            (5, 0, say({"tool_calls": [call("s", args={"prompt": 7, "turn": -1, "words": "n"})]})), (5, 1, say({"tool_call_id": "none", "content": "?"}))]
    out = {(r.conv, r.call_id): r for r in tool_calls.link_tool_calls(
        spark.createDataFrame(rows * 2, "conv_id long, turn long, text string"), tool_calls.REPLY_SCHEMA).collect()}
    assert len(out) == 6 + 1 + 1 + 40 + 3 + 1
    assert [out["1", c].level for c in "abcdef"] == [0, 1, 2, None, None, 0]
    assert [out["3", str(i)].level for i in range(40)] == list(range(40))
    assert [out["4", c].level for c in "xyz"] == [None] * 3
    assert out["1", "a"].linked and not out["1", "b"].linked and out["2", "a"].level == 0
    assert out["1", "a"].canonical == '{"arguments":{"prompt":"a b c d e","turn":1,"words":5},"id":"a","name":"reply","result":"x\\"y"}'
    assert out["", "q"].errors == "unknown tool" and out["", "q"].linked
    assert out["5", "s"].errors == "prompt not string,turn too small,words not integer"
    empty = spark.createDataFrame([], "conv_id long, turn long, text string")
    assert tool_calls.link_tool_calls(empty, tool_calls.REPLY_SCHEMA).count() == 0


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16))
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 1, "s") for i, v in enumerate(x)] + [
        (600, None, 1, "s"), (620, [0.0] * 16, 1, "s"), (640, [float("nan")] * 16, 1, "s"), (660, [None] * 16, 1, "s"), (680, [float("inf")] * 16, 1, "s"),
        (None, x[0].tolist(), 1, "s"), (700, [], 1, "s"), (720, [1.0, 2.0], 1, "s"), (740, [3.0, 1.0], 1, "s")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    out = ann.nearest(v, v.where("vec_id % 20 = 0")).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 500, 20)) | {720, 740}
    assert [i for i, _ in got[720]] == [740] and got[720][0][1] == 5.0
    hit = 0
    for q in range(0, 500, 20):
        s = (x * x[q]).sum(axis=1)
        want = sorted((i for i in range(500) if i != q), key=lambda i: (-s[i], i))[:20]
        hit += len(set(want) & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(score - s[i]) < 1e-12 for i, score in got[q])
    assert hit / (25 * 20) >= 0.99
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("large", [1e25, 1e100])
def test_neighbours_beyond_single_precision(large):
    """Finite vectors whose bound overflows stay candidates."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[::3] *= large
    q = x[:30]
    with np.errstate(all="ignore"):
        got = ann.search_block(np.arange(300), x, np.arange(30), q, 20, ann.EPSILON)
    for i in range(30):
        score = (x * q[i]).sum(axis=1)
        want = sorted((v for v in range(300) if v != i), key=lambda v: (-score[v], v))[:20]
        assert got[1][got[0] == i].tolist() == want


def test_neighbour_recall_on_the_embeddings(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = v.toPandas()
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    got = {}
    for r in entry.queries()["op7_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        hit += len(got[ids[k]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        total += 20
    assert hit / total >= 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id: r for r in docs.collect()})
    assert [set(b) >= set(a) for b, a in zip([before, *kept], kept)] == [True] * 4
    assert all(r.text == before[i].text for i, r in kept[2].items())
    for r in kept[1].values():
        n, *_, repeat = signals_of(r.text)
        assert n >= 50 and 100 * repeat <= 50 * n
    sets = {}
    for i, r in kept[2].items():
        w = WORD.findall(r.text.lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    ids = sorted(sets)
    assert not [(i, j) for a, i in enumerate(ids) for j in ids[:a] if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    seen = {}
    for i in ids:
        w = WORD.findall(kept[2][i].text)
        gone = set()
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k:k + 13]), i) < i:
                gone |= set(range(k, k + 13))
        want = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else kept[2][i].text
        assert kept[3][i].text == want and kept[3][i].n_chars == len(want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(kept[3])
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("column", ["doc_id", "text", "lang", "source", "n_chars"])
def test_pipeline_stages_take_nulls_and_nothing(spark, column):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20")
    docs = docs.withColumn(column, F.when(F.col("doc_id") % 2 == 0, F.col(column)))
    for part in (docs, docs.limit(0)):
        for _name, stage in corpus_pipeline.STAGES:
            assert stage(spark, part, SF).count() >= 0


def test_registry():
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_small_lists_of_trusted_ids_are_not_broadcast(spark):
    """The form of the join, and so what it moves, does not change with the number of trusted ids."""
    from corpuspulse.llm import quality_rules as Q
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "d"), (None, "e"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 1), (1, 0), (None, 1), (2, 1)], "doc_id long, quality int")
    out = Q.mark_trusted(docs, Q.trusted_ids(labels))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((str(r.text), str(r.tid)) for r in out.collect()) == [("None", "3"), ("a b", "None"), ("c", "2"), ("d", "2"), ("e", "None")]
