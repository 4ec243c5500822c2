"""Segmented prefix scans (W4): what a window over a whole group computes, without a task that holds the group.

Rows are sorted once into ranges of (group, order) and kept in the shared folder, where their place is fixed.  Every
(group, range) is a block with a window of its own.  What a block hands on (its last value, its sum) is one small row; the
blocks of groups that cross ranges are scanned in order, and every row adds what its block was handed.  A group with a
third of all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.session import broadcast_if_small, checkpoint_dir

_POS, _PART, _IN, _FROM = "_scan_pos", "_scan_part", "_scan_in", "_scan_from"


def sorted_blocks(df: DataFrame, by, order) -> DataFrame:
    """``df`` with its place in the global order of (by, order) and the range it lies in.

    The place is assigned over a checkpoint, whose partitions never change, so every later reading agrees.
    """
    checkpoint_dir(df.sparkSession)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    key = [*[F.col(c).asc_nulls_first() for c in by], *[as_column(c) for c in order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not coalesced
    laid = df.repartitionByRange(parts, *key).sortWithinPartitions(*key).checkpoint()
    return laid.withColumn(_POS, F.monotonically_increasing_id()).withColumn(_PART, F.shiftright(_POS, 33))


def _handed_on(blocks: DataFrame, by, value: Column) -> DataFrame:
    """``(by.., part, handed)`` for blocks that continue a group: ``value`` over the group's earlier blocks, in order."""
    several = Window.partitionBy(*by)
    earlier = several.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn("_n", F.count(F.lit(1)).over(several)).where("_n > 1")
    return out.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(_PART).alias("_p"), value.over(earlier).alias(_FROM)).where(
        F.col(_FROM).isNotNull())


def _with_handed(rows: DataFrame, handed: DataFrame, by) -> DataFrame:
    same = rows[_PART] == handed["_p"]
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(handed[f"_b{i}"])
    return rows.join(broadcast_if_small(handed), same, "left")


def carry_forward(df: DataFrame, col: str, by, order, out: str | None = None) -> DataFrame:
    """Last non-NULL value of ``col`` so far within ``by``, in ``order`` (NULL when none yet).

    NULL is a group of its own, rows equal in ``by`` and ``order`` follow each other in any order, an empty ``by`` is one
    group, and an empty table gives an empty result.
    """
    rows = sorted_blocks(df, by, order)
    inside = Window.partitionBy(*by, _PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(*by, _PART).agg(F.max_by(F.struct(F.col(col).alias("v")), F.when(F.col(col).isNotNull(), F.col(_POS))).alias("last"))
    # A block without values hands on what it was handed, hence the last block with one.
    handed = _handed_on(blocks.withColumn("last", F.when(F.col("last.v").isNotNull(), F.col("last"))), by, F.last("last", ignorenulls=True))
    met = _with_handed(rows.withColumn(_IN, F.last(col, ignorenulls=True).over(inside)), handed, by)
    name = out or col
    picked = F.coalesce(F.col(_IN), F.col(_FROM)["v"]).alias(name)
    return met.select(*[picked if c == name else F.col(c) for c in df.columns], *([] if name in df.columns else [picked]))


def running_sum(df: DataFrame, col: str, by, order, out: str = "running") -> DataFrame:
    """Sum of ``col`` so far within ``by``, in ``order``; NULL values count as nothing (NULL before the first value)."""
    rows = sorted_blocks(df, by, order)
    inside = Window.partitionBy(*by, _PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    handed = _handed_on(rows.groupBy(*by, _PART).agg(F.sum(col).alias("s")), by, F.sum("s"))
    met = _with_handed(rows.withColumn(_IN, F.sum(col).over(inside)), handed, by)
    total = F.when(F.col(_IN).isNull(), F.col(_FROM)).otherwise(F.col(_IN) + F.coalesce(_FROM, F.lit(0))).alias(out)
    return met.select(*[F.col(c) for c in df.columns if c != out], total)
