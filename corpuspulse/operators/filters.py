"""Row filters (F1-F6).  All are plain predicates so Catalyst can push them
into the Parquet scan where the column is stored."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.functions.text import is_shouting
from corpuspulse.operators.voting import for_paper  # noqa: F401  (F3)


def in_date_range(df: DataFrame, start, end, col: str = "event_ts", end_of_day: bool = False) -> DataFrame:
    """``start <= ts <= end``, both inclusive.

    The literal rule compares against midnight of ``end``, so later times on
    the last day fall out; ``end_of_day=True`` keeps the whole last day
    (``ts < end + 1 day``).
    """
    start = _as_ts(start)
    end = _as_ts(end)
    c = F.col(col)
    # Literals take the column's own type, so wall-clock (timestamp_ntz) columns
    # compare without any session time-zone conversion.
    typ = df.schema[col].dataType.simpleString()

    def lit(v: _dt.datetime):
        return F.lit(v.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(typ)
    if end_of_day:
        end_excl = (_dt.datetime.combine(end.date(), _dt.time()) + _dt.timedelta(days=1))
        return df.where((c >= lit(start)) & (c < lit(end_excl)))
    return df.where((c >= lit(start)) & (c <= lit(end)))


def _as_ts(v):
    if isinstance(v, _dt.datetime):
        return v
    if isinstance(v, _dt.date):
        return _dt.datetime.combine(v, _dt.time())
    return _dt.datetime.fromisoformat(str(v))


def in_section(df: DataFrame, allowed, col: str = "section") -> DataFrame:
    """section equality / membership."""
    allowed = [allowed] if isinstance(allowed, str) else list(allowed)
    return df.where(F.col(col).isin(*allowed))


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    """drop rows with any NULL (in ``subset`` when given)."""
    return df.na.drop("any", subset=subset)


def no_topic_scored(texts: DataFrame, scores: DataFrame, key: str = "doc_id",
                    whole: str = "whole") -> DataFrame:
    """texts with no non-NULL topic score (``whole`` ignored): a left anti join."""
    scored = scores.where((F.col("topic") != F.lit(whole)) & F.col("score").isNotNull()).select(key)
    return texts.join(scored, key, "left_anti")


def drop_shouting(df: DataFrame, col: str = "headline") -> DataFrame:
    """P5: drop rows whose whole text is upper-case (a digits-only text is kept)."""
    return df.where(~is_shouting(col) | F.col(col).isNull())
