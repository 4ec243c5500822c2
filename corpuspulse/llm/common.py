"""Shared helpers of the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspulse.session import checkpoint_dir, ship_package

# Row key of a NULL id: larger than every real id, so it never wins a "smallest id" rule.
NO_ID = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and set the shared checkpoint folder."""
    ship_package(spark)
    checkpoint_dir(spark)


PLAN_TEXT = "spark.sql.maxPlanStringLength"


@contextmanager
def short_plans(spark: SparkSession, limit: int = 20_000):
    """Inside, a job's plan is described by at most ``limit`` characters.

    The driver keeps the description of every recent job, and again of each of its adaptive re-plans; loops of wide
    plans fill its memory with them otherwise.
    """
    before = spark.conf.get(PLAN_TEXT, None)
    spark.conf.set(PLAN_TEXT, str(limit))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PLAN_TEXT)
        else:
            spark.conf.set(PLAN_TEXT, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder named by ``spark.checkpoint.dir`` (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    with short_plans(df.sparkSession):
        return df.checkpoint()


def keyed(docs: DataFrame, id_col: str, text_col: str, rec: bool = False) -> DataFrame:
    """``(id, key, th, text[, rec])``: the only columns an operator works on.

    ``key`` is the id with NULL as the largest value and ``th`` a hash of the text; together they tell rows
    that share an id apart (rows equal in both are equal in every result).  ``rec`` carries all further
    columns as one struct, so their names cannot clash with the operator's own.
    """
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"),
            F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("key"),
            F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
            F.col(f"`{text_col}`").cast("string").alias("text")]
    if rec:
        more = [c for c in docs.columns if c not in (id_col, text_col)]
        cols.append((F.struct(*[F.col(f"`{c}`") for c in more]) if more
                     else F.struct(F.lit(None).cast("int").alias("none"))).alias("rec"))
    return docs.select(*cols)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan with a partial sum, used to size buckets."""
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0)


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def with_rec(ddl: str, rows: DataFrame) -> T.StructType:
    """The schema ``ddl`` plus the ``rec`` column of ``rows``."""
    return T.StructType([*T._parse_datatype_string(ddl).fields, rows.schema["rec"]])


def restored(out: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **changed: Column) -> DataFrame:
    """Rows ``(id, text, rec)`` of an operator as the columns of ``docs`` again; ``changed`` replaces some."""
    kinds = dict(docs.dtypes)
    pick = {id_col: F.col("id"), text_col: F.col("text"), **changed}
    return out.select(*[(pick[c] if c in pick else F.col("rec")[c]).cast(kinds[c]).alias(c) for c in docs.columns])
