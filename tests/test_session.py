"""Session helpers: spread decision, bounded broadcast hint, JSON literals, checkpoint folder."""

from pyspark.sql import functions as F

from corpuspulse.functions.util import json_literal, let
from corpuspulse.session import broadcast_if_small, checkpoint_dir, spread, table_bytes


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_small_file_input(spark, tmp_root):
    path = f"{tmp_root}/one_file"
    spark.range(100).coalesce(1).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    out = spread(df)
    assert out.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in out.collect()) == list(range(100))


def test_spread_leaves_larger_inputs_alone(spark, tmp_root, monkeypatch):
    path = f"{tmp_root}/larger"
    spark.range(1000).write.mode("overwrite").parquet(path)
    monkeypatch.setattr("corpuspulse.session.SPREAD_BYTES_PER_CORE", 10)
    df = spark.read.parquet(path)
    assert "Repartition" not in _plan(spread(df))


def test_broadcast_goes_by_bytes_not_rows(spark):
    few_wide = spark.createDataFrame([(1, "x" * 10_000)], "id long, s string")
    many_narrow = spark.range(50)
    assert table_bytes(few_wide) > 10_000 > table_bytes(many_narrow)
    hinted = lambda df: "broadcast" in _plan(spark.range(3).join(broadcast_if_small(df, 5_000), "id")).lower()
    assert hinted(many_narrow) and not hinted(few_wide)


def test_json_literal_folds_and_let_binds(spark):
    m = json_literal({"a": 1.5, "b": -2.0}, "map<string,double>")
    df = spark.range(1).select(F.try_element_at(m, F.lit("b")).alias("v"))
    assert df.first().v == -2.0
    assert "from_json" not in _plan(df)          # constant-folded into one literal
    arr = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    got = arr.select(let(F.col("a"), lambda v: F.transform(v, lambda x: x + F.size(v))).alias("r")).first().r
    assert got == [4, 5, 6]


def test_checkpoint_dir_is_configured(spark):
    path = checkpoint_dir(spark)
    assert path and spark.sparkContext.getCheckpointDir() is not None
