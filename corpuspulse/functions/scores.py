"""Column functions over signed scores (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN means "not scored" upstream; Spark would treat ``NaN > 0`` as true."""
    return F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))


def sign_agree(a, b) -> Column:
    """both strictly positive or both strictly negative; zero/NULL never agree."""
    a, b = _c(a), _c(b)
    return F.coalesce((F.signum(a) == F.signum(b)) & (a != 0), F.lit(False))


# Aggregate builders, each maps a score column to an aggregate Column.
def count_pos(c) -> Column:
    return F.count_if(_c(c) > 0)


def count_neg(c) -> Column:
    return F.count_if(_c(c) < 0)


def avg_pos(c) -> Column:
    """Mean of the positive scores; NULL (not 0) when there are none."""
    return F.avg(F.when(_c(c) > 0, _c(c)))


def avg_neg(c) -> Column:
    return F.avg(F.when(_c(c) < 0, _c(c)))


def avg_sentiment(c) -> Column:
    return F.avg(_c(c))


AGGREGATES = {
    "count_pos": count_pos,
    "count_neg": count_neg,
    "avg_pos": avg_pos,
    "avg_neg": avg_neg,
    "avg": avg_sentiment,
}


def label_score(label, p) -> Column:
    """Positive -> +p, neutral -> 0, anything else -> -p."""
    label, p = _c(label), _c(p)
    return (F.when(label == "positive", p)
            .when(label == "neutral", F.lit(0.0))
            .otherwise(-p))


def share_pct(x, by=(), places: int | None = 2) -> Column:
    """``x / sum(x) * 100`` within ``by``; zero total -> NULL.

    Meant for already-aggregated rows (one per party or per party x paper):
    the window runs over a handful of rows per partition key.
    """
    w = Window.partitionBy(*[_c(b) for b in by]) if by else Window.partitionBy()
    x = _c(x).cast("double")
    pct = F.try_divide(x * F.lit(100.0), F.sum(x).over(w))
    return F.round(pct, places) if places is not None else pct


def compose(a, b) -> Column:
    """``a: b`` when both exist, else ``b`` (NULL when ``b`` is missing)."""
    a, b = _c(a), _c(b)
    return F.when(b.isNull(), F.lit(None).cast("string")).when(
        a.isNotNull() & (F.length(a) > 0), F.concat(a, F.lit(": "), b)).otherwise(b)


def first_non_null(*cols) -> Column:
    """Primary value, else the fallbacks in order."""
    return F.coalesce(*[_c(c) for c in cols])
