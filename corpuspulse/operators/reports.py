"""Reports over the long score table ``(paper, topic, score, event_ts)``.

Every report aggregates twice at most: once over the (large) score rows with
a partial + final hash aggregate, then over the (paper x topic) result for
margins.  Margins are never computed with ``cube`` over base rows because
the unweighted mean of per-paper means is not a base-row aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.functions.scores import AGGREGATES, nan_to_null
from corpuspulse.functions.util import dense_cells, distinct_array
from corpuspulse.session import broadcast_if_small

TOTAL = "total"
TOTAL_ROW = "Total"
TOPIC_ONLY = "total (topic only)"
WHOLE = "whole"


def paper_counts(df: DataFrame, total_label: str = TOTAL_ROW) -> DataFrame:
    """A1: rows per paper plus a total row (``ROLLUP(paper)``)."""
    return df.rollup("paper").agg(F.count(F.lit(1)).alias("n"), F.grouping("paper").alias("_g")) \
             .select(F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col("paper")).alias("paper"), "n")


def nonnull_counts(df: DataFrame, cols=None) -> DataFrame:
    """A2: non-NULL count of every column, one row."""
    cols = cols or df.columns
    return df.agg(*[F.count(F.col(c)).alias(c) for c in cols])


def nonnull_counts_by_paper(df: DataFrame, cols=None, total_label: str = TOTAL_ROW) -> DataFrame:
    """A3: A2 per paper plus a total row."""
    cols = [c for c in (cols or df.columns) if c != "paper"]
    g = df.rollup("paper").agg(*[F.count(F.col(c)).alias(c) for c in cols], F.grouping("paper").alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col("paper")).alias("paper"), *cols)


def _agg_fn(agg) -> Callable[[Column], Column]:
    return AGGREGATES[agg] if isinstance(agg, str) else agg


def paper_topic_report(scores: DataFrame, agg="avg", margin: str | None = None,
                       total_label: str = TOTAL, topic_only_label: str = TOPIC_ONLY,
                       exclude=(WHOLE,), dense: bool = True) -> DataFrame:
    """``agg(score)`` per paper x topic with margins, long form.

    Output ``(paper, topic, value double)``:

    * one row per (paper, topic);
    * ``paper = total``: per topic, the sum (``margin='sum'``) or the
      unweighted mean of the paper values (``margin='mean'``);
    * ``topic = total (topic only)``: per paper *and for the total row*, the
      same margin over topics, leaving out ``exclude`` (``whole``) by name.

    ``agg`` is a name from ``AGGREGATES`` or any ``Column -> Column``.
    Default margin: ``sum`` for counts, ``mean`` otherwise.  A NULL paper or
    topic is a group of its own, with and without ``dense``.
    """
    fn = _agg_fn(agg)
    if margin is None:
        margin = "sum" if agg in ("count_pos", "count_neg") else "mean"
    m = F.sum if margin == "sum" else F.avg
    base = scores.groupBy("paper", "topic").agg(fn(nan_to_null("score")).cast("double").alias("value"))
    if dense:
        # Every paper x topic cell, as in a paper-by-topic table: counts of an
        # absent pair are 0, means NULL.  No job at build time, no limit on topics,
        # one scan (the topic subquery reuses the aggregate), and NULL is a topic
        # like any other.
        zero = F.lit(0.0) if agg in ("count_pos", "count_neg") else F.lit(None).cast("double")
        base = dense_cells(base, "paper", "topic", distinct_array(base, "topic", shared="value"), {"value": zero})
    # Second level on the aggregated (paper x topic) rows only.
    rows = base.unionByName(
        base.groupBy("topic").agg(m("value").alias("value")).withColumn("paper", F.lit(total_label)))
    # Exclusion inside the aggregate (not a filter): every branch then shares the
    # same base subplan, so its shuffle is computed once and reused.
    kept = (F.when(~F.coalesce(F.col("topic").isin(*exclude), F.lit(False)), F.col("value"))
            if exclude else F.col("value"))
    topic_only = (rows.groupBy("paper").agg(m(kept).alias("value"))
                  .withColumn("topic", F.lit(topic_only_label)))
    return rows.unionByName(topic_only).select("paper", "topic", "value")


def topic_by_day(scores: DataFrame, grain: str = "day") -> DataFrame:
    """A10: mean score per (day, topic); undated rows are left out.

    Output ``(day date, topic, value)``; ``grain`` other than ``day`` uses
    ``date_trunc`` and returns a timestamp column instead; ``grain='raw'``
    groups by the raw date text ``date_raw`` (time of day and ``-`` kept, the
    literal rule).
    """
    if grain == "raw":
        return scores.groupBy(F.col("date_raw").alias("day"), "topic").agg(
            F.avg(nan_to_null("score")).alias("value"))
    ts = F.col("event_ts")
    key = F.to_date(ts) if grain == "day" else F.date_trunc(grain, ts)
    return (scores.where(ts.isNotNull()).groupBy(key.alias("day"), "topic")
            .agg(F.avg(nan_to_null("score")).alias("value")))


def day_total(by_day: DataFrame) -> DataFrame:
    """Per day, the unweighted mean of the non-NULL topic means (``whole`` included)."""
    return by_day.groupBy("day").agg(F.avg("value").alias("value"))


def select_topics(scores: DataFrame, include_whole: bool = True, topics=None) -> DataFrame:
    """Choose topics by name (long model) - optionally without ``whole``."""
    out = scores if include_whole else scores.where(F.col("topic") != F.lit(WHOLE))
    return out if topics is None else out.where(F.col("topic").isin(*topics))


def melt(df: DataFrame, ids, prefix: str = "sentiment_", var: str = "topic",
         value: str = "score") -> DataFrame:
    """Wide ``<prefix><topic>`` columns to long rows (NULL cells kept)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(list(ids), cols, var, value)
    return long.withColumn(var, F.expr(f"substr({var}, {len(prefix) + 1})"))


def widen(df: DataFrame, ids, topics, var: str = "topic", value: str = "score",
          prefix: str = "sentiment_") -> DataFrame:
    """Long to wide; ``topics`` are the pivot values (no extra distinct job)."""
    w = df.groupBy(*ids).pivot(var, list(topics)).agg(F.first(value, ignorenulls=True))
    return w.select(*ids, *[F.col(f"`{t}`").alias(prefix + t) for t in topics])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()


def sort_by_key(df: DataFrame, *cols) -> DataFrame:
    """O1: total order on the given keys."""
    return df.orderBy(*cols)


def union_all(*dfs: DataFrame, id_col: str | None = None) -> DataFrame:
    """O2/S3: append frames by column name; missing columns become NULL.

    With ``id_col`` every row gets a new unique (not consecutive) 64-bit id,
    computed per partition without a shuffle.
    """
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.withColumn(id_col, F.monotonically_increasing_id()) if id_col else out


def canonical_topics(df: DataFrame, alias: DataFrame, col: str = "topic") -> DataFrame:
    """P10: rename raw topic names through ``alias(raw, topic)``; unmapped stay."""
    a = alias.select(F.col("raw").alias("_raw"), F.col("topic").alias("_canon"))
    return (df.join(broadcast_if_small(a), F.col(col) == F.col("_raw"), "left")
            .withColumn(col, F.coalesce("_canon", col)).drop("_raw", "_canon"))


def dedup_first(df: DataFrame, key="headline", order=("paper", "date_raw")) -> DataFrame:
    """Keep the first row per key under a total order.

    A window rank, not ``dropDuplicates``: the survivor must be deterministic,
    so all further columns break ties of ``order`` (rows equal in every column
    are the same row).  The planner adds a partial ``WindowGroupLimit`` before
    the shuffle by ``key`` (visible in ``explain``), so a key shared by a third
    of all rows sends one row per map partition, not all of its rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orderable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    ties = [c for c in orderable if c not in keys and c not in order]
    w = Window.partitionBy("_kh", *keys).orderBy(*[F.col(c).asc_nulls_last() for c in (*order, *ties)])
    hashed = df.withColumn("_kh", F.xxhash64(*[F.col(c) for c in keys]))
    return hashed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_kh")


def dedup_first_salted(df: DataFrame, key="headline", order=("paper", "date_raw"),
                       salt_buckets: int = 64) -> DataFrame:
    """W1 in two ranked levels: first per (key, salt of the order columns), then per key.

    Same rows as ``dedup_first``; the explicit form for engines or settings
    without the partial group limit.
    """
    keys = [key] if isinstance(key, str) else list(key)
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salt_buckets)))
    return dedup_first(dedup_first(salted, [*keys, "_s"], order).drop("_s"), keys, order)


def top_k_per_group(df: DataFrame, by, order, k: int = 5) -> DataFrame:
    """The first ``k`` rows per group under ``order`` (ties broken by the order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_words(counts: DataFrame, k: int = 5, by=("cluster_label",), count: str = "n",
                word: str = "word") -> DataFrame:
    """The ``k`` most frequent words per group from ``(by.., word, count)`` rows,
    ties by the word; a partial top-k runs before the shuffle."""
    return top_k_per_group(counts, list(by), [F.desc(count), F.asc(word)], k)


def share_of_total(df: DataFrame, x: str, by=(), out: str = "pct", places: int | None = 2) -> DataFrame:
    """``x`` as a percentage of its total within ``by`` (on aggregated rows)."""
    from corpuspulse.functions.scores import share_pct
    return df.withColumn(out, share_pct(x, by=tuple(by), places=places))
