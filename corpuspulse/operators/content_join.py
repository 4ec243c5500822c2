"""J1 on content: rows that share long texts meet by a 128-bit key, in tables that are shuffled once.

The key is a digest of the join columns with their lengths, so neither texts nor their concatenation travel as join keys.
``keep_bucketed`` writes a side once, dealt and sorted by the key; joins of such tables read matching buckets and need no
exchange.  The columns themselves are compared where keys are equal, so a collision joins nothing wrong.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.session import scratch_table_path

KEY = "content_key"
BUCKET_BYTES = 128 << 20


def content_key(*cols: str) -> Column:
    """16 bytes that stand for the values of ``cols`` (any types with a string form); NULL differs from every value."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts += [F.coalesce(F.octet_length(text), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.md5(F.concat(*parts)))


def text_digest(col: str) -> Column:
    """32 bytes that stand for a text where it does not travel along (SHA-256; no bytes for NULL, so it is never NULL)."""
    return F.coalesce(F.unhex(F.sha2(F.col(col), 256)), F.lit(b""))


def bucket_count(df: DataFrame, of: int | None = None) -> int:
    """Buckets of about ``BUCKET_BYTES`` by the optimizer's size of ``df``, a power of two so that tables fit each other."""
    size = of if of is not None else int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = 8
    while n * BUCKET_BYTES < size and n < 1 << 16:
        n *= 2
    return n


def keep_bucketed(df: DataFrame, on, buckets: int | None = None, name: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, dealt into buckets and sorted by the content key of ``on``.

    One shuffle now; joins and aggregates by the key later have none.  A key with very many rows is one bucket: keep the
    side with unique keys, or few rows per key, this way and let the other meet it with ``join_on_content``.
    """
    spark = df.sparkSession
    name = name or f"kept_{uuid.uuid4().hex}"
    n = buckets or bucket_count(df)
    keyed = df.withColumn(KEY, content_key(*on)).repartition(n, KEY)
    (keyed.write.mode("overwrite").option("path", scratch_table_path(spark, f"bucketed-{name}")).format("parquet")
     .bucketBy(n, KEY).sortBy(KEY).saveAsTable(name))
    return spark.table(name)


def join_on_content(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on equal ``on`` columns through the content key; NULL equals NULL.

    Sides with a ``content_key`` column (from ``keep_bucketed``) are used as they are, others get one.  The output has the
    left columns and the right ones beside ``on``; ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join_on_content joins inner or left, not {how}")
    sides = [d if KEY in d.columns else d.withColumn(KEY, content_key(*on)) for d in (left, right)]
    more = [c for c in right.columns if c not in on and c != KEY]
    r = sides[1].select(F.col(KEY).alias("_rk"), *[F.col(c).alias(f"_r_{c}") for c in on], *more)
    # Differences are counted: the planner would take equalities for further join keys and shuffle by all of them.
    differ = F.lit(0)
    for c in on:
        differ = differ + F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), 0).otherwise(1)
    met = sides[0].join(r, (F.col(KEY) == F.col("_rk")) & (differ < 1), how)
    return met.select(*[c for c in left.columns if c != KEY], *more)
