"""Joins on content keys: equal to plain joins, and without an exchange between kept tables."""

import pytest

from corpuspulse.operators import content_join as J

LEFT = [(1, "a text", "p"), (2, "a text", "p"), (3, None, "p"), (4, "", None), (5, "12", "3"), (6, "1", "23"), (7, "x" * 100_000, "p"), (8, "alone", "p")]
RIGHT = [("a text", "p", 10), (None, "p", 11), ("", None, 12), ("12", "3", 13), ("x" * 100_000, "p", 14), ("a text", "q", 15), ("a text", "p", 16)]
ON = ["headline", "paper"]


def frames(spark):
    return (spark.createDataFrame(LEFT, "id int, headline string, paper string"), spark.createDataFrame(RIGHT, "headline string, paper string, score int"))


def expected(how):
    out = []
    for i, h, p in LEFT:
        hits = [s for h2, p2, s in RIGHT if (h2, p2) == (h, p)]
        out += [(i, s) for s in hits or ([None] if how == "left" else [])]
    return sorted(map(str, out))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("kept", [(False, False), (True, True), (True, False)])
def test_same_rows_as_a_plain_join(spark, how, kept):
    sides = [J.keep_bucketed(d, ON, buckets=4) if k else d for d, k in zip(frames(spark), kept)]
    out = J.join_on_content(*sides, ON, how)
    assert out.columns == ["id", "headline", "paper", "score"]
    assert sorted(str((r.id, r.score)) for r in out.collect()) == expected(how)


def test_kept_tables_join_without_an_exchange(spark):
    left, right = (J.keep_bucketed(d, ON, buckets=4) for d in frames(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.join_on_content(left, right, ON)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_a_collision_joins_nothing_wrong(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(J, "content_key", lambda *cols: F.unhex(F.lit("00")))
    out = J.join_on_content(*frames(spark), ON)
    assert sorted(str((r.id, r.score)) for r in out.collect()) == expected("inner")


def test_other_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        J.join_on_content(*frames(spark), ON, "outer")


def test_analysis_shuffles_texts_once(spark, tmp_path, monkeypatch):
    """Copies, an empty and a NULL text: rows as in the SQL, and no shuffle or join of the analysis has a text among its keys."""
    import re

    import duckdb

    from corpuspulse.plans import catalog
    from corpuspulse.sources import tables
    texts = ["the cat and of it is", "no match", "this goes with that", "", None, "an apple,\nthe \"pear\"", "xyz", " the end "]
    docs = [(i, texts[i % len(texts)] if i < 30 else f"{texts[i % 4]} {i}", "en", f"s{i % 3}", 1) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 5) for i in range(0, 60, 2)], "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plans = []
    plan_of = lambda df: plans.append(df._jdf.queryExecution().toString())
    monkeypatch.setattr(tables, "write_table", lambda df, *a, whole=tables.write_table, **b: plan_of(df) or whole(df, *a, **b))
    out = catalog.QUERIES["analysis_pipeline"](spark, str(tmp_path))
    plan_of(out)
    assert not any(re.search(r"(hashpartitioning|Join)[^\n]*headline#", p) for p in plans)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = lambda found: sorted((str(p), str(t), None if v is None else round(v, 6)) for p, t, v in found)
    names = ["paper", "topic", "value"]
    expect = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE['analysis_pipeline']})").fetchall()
    assert rows(out.select(*names).collect()) == rows(expect)
    con.close()
