"""Registered queries: counts and paper x topic x day reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.operators import filters as FL
from corpuspulse.operators import reports as R
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import OBS, register, with_


def _r6(df, *keys):
    return df.select(*keys, F.round("value", 6).alias("value"))


@register("paper_counts", with_(OBS) + """
SELECT paper, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY paper
UNION ALL SELECT 'Total' AS paper, CAST(count(*) AS BIGINT) AS n FROM obs""")
def q_paper_counts(spark, sf):
    """A1: rows per paper plus the total row."""
    return R.paper_counts(S.obs(spark, sf))


@register("nonnull_counts", with_(OBS) + """
SELECT CAST(count(obs_id) AS BIGINT) AS obs_id, CAST(count(paper) AS BIGINT) AS paper,
       CAST(count(topic) AS BIGINT) AS topic, CAST(count(score) AS BIGINT) AS score,
       CAST(count(event_ts) AS BIGINT) AS event_ts FROM obs""")
def q_nonnull_counts(spark, sf):
    """A2: non-NULL count per column."""
    return R.nonnull_counts(S.obs(spark, sf))


@register("nonnull_counts_by_paper", with_(OBS) + """
SELECT paper, CAST(count(obs_id) AS BIGINT) AS obs_id, CAST(count(topic) AS BIGINT) AS topic,
       CAST(count(score) AS BIGINT) AS score, CAST(count(event_ts) AS BIGINT) AS event_ts
FROM obs GROUP BY paper
UNION ALL
SELECT 'Total', CAST(count(obs_id) AS BIGINT), CAST(count(topic) AS BIGINT),
       CAST(count(score) AS BIGINT), CAST(count(event_ts) AS BIGINT) FROM obs""")
def q_nonnull_counts_by_paper(spark, sf):
    """A3: non-NULL counts per paper plus the total row."""
    return R.nonnull_counts_by_paper(S.obs(spark, sf))


def _report_sql(agg_sql: str, margin: str) -> str:
    return with_(OBS, f"""base AS (SELECT paper, topic, CAST({agg_sql} AS DOUBLE) AS value FROM obs GROUP BY paper, topic)""",
                 f"""rws AS (SELECT paper, topic, value FROM base
            UNION ALL SELECT 'total' AS paper, topic, {margin}(value) AS value FROM base GROUP BY topic)""") + f"""
SELECT paper, topic, round(value, 6) AS value FROM rws
UNION ALL
SELECT paper, 'total (topic only)' AS topic, round({margin}(value), 6) AS value
FROM rws WHERE topic <> 'whole' GROUP BY paper"""


_REPORTS = {
    "count_pos": ("count(*) FILTER (WHERE score > 0)", "sum", "A4"),
    "count_neg": ("count(*) FILTER (WHERE score < 0)", "sum", "A5"),
    "avg_pos": ("avg(score) FILTER (WHERE score > 0)", "avg", "A6"),
    "avg_neg": ("avg(score) FILTER (WHERE score < 0)", "avg", "A7"),
    "avg": ("avg(score)", "avg", "A8"),
}


def _make_report(agg: str, margin: str, op: str):
    def q(spark, sf):
        return _r6(R.paper_topic_report(S.obs(spark, sf), agg, "sum" if margin == "sum" else "mean"),
                   "paper", "topic")
    q.__doc__ = f"A9 with {op} ({agg}): paper x topic report with margins."
    return q


for _agg, (_sql, _m, _op) in _REPORTS.items():
    register(f"report_{_agg}", _report_sql(_sql, _m))(_make_report(_agg, _m, _op))


@register("report_avg_sum_margin", _report_sql("avg(score)", "sum"))
def q_report_avg_sum_margin(spark, sf):
    """A9 with an explicit ``sum`` margin over means (the count-report rule)."""
    return _r6(R.paper_topic_report(S.obs(spark, sf), "avg", "sum"), "paper", "topic")


@register("topic_by_day", with_(OBS) + """
SELECT CAST(event_ts AS DATE) AS day, topic, round(avg(score), 6) AS value
FROM obs WHERE event_ts IS NOT NULL GROUP BY 1, 2""")
def q_topic_by_day(spark, sf):
    """A10: mean score per day and topic."""
    return _r6(R.topic_by_day(S.obs(spark, sf)), "day", "topic")


@register("day_total", with_(OBS) + """,
bd AS (SELECT CAST(event_ts AS DATE) AS day, topic, avg(score) AS value
       FROM obs WHERE event_ts IS NOT NULL GROUP BY 1, 2)
SELECT day, round(avg(value), 6) AS value FROM bd GROUP BY day""")
def q_day_total(spark, sf):
    """Per day, unweighted mean of the topic means."""
    return _r6(R.day_total(R.topic_by_day(S.obs(spark, sf))), "day")


@register("select_topics", with_(OBS) + """
SELECT obs_id, paper, topic, score FROM obs WHERE topic <> 'whole' AND topic IN ('view', 'click')""")
def q_select_topics(spark, sf):
    """Topic selection by name, ``whole`` left out."""
    o = S.obs(spark, sf).select("obs_id", "paper", "topic", "score")
    return R.select_topics(o, include_whole=False, topics=["view", "click"])


_TOPICS = ["click", "error", "purchase", "signup", "view"]
_WIDE_SQL = with_(OBS) + """,
bd AS (SELECT CAST(event_ts AS DATE) AS day, topic, round(avg(score), 6) AS value
       FROM obs WHERE event_ts IS NOT NULL GROUP BY 1, 2),
wide AS (SELECT day, """ + ", ".join(
    f"max(value) FILTER (WHERE topic = '{t}') AS sentiment_{t}" for t in _TOPICS) + """ FROM bd GROUP BY day)"""


def _wide(spark, sf):
    return R.widen(_r6(R.topic_by_day(S.obs(spark, sf)), "day", "topic"), ["day"], _TOPICS, value="value")


@register("widen_by_day", _WIDE_SQL + "SELECT * FROM wide")
def q_widen_by_day(spark, sf):
    """P13 long -> wide: one ``sentiment_<topic>`` column per topic per day."""
    return _wide(spark, sf)


@register("melt_by_day", _WIDE_SQL + """
SELECT day, topic, score FROM wide UNPIVOT INCLUDE NULLS (score FOR topic IN (""" + ", ".join(
    f"sentiment_{t} AS '{t}'" for t in _TOPICS) + "))")
def q_melt_by_day(spark, sf):
    """P13 wide -> long (NULL cells kept)."""
    return R.melt(_wide(spark, sf), ["day"])


@register("distinct_papers", with_(OBS) + "SELECT DISTINCT paper FROM obs")
def q_distinct_papers(spark, sf):
    """Distinct values."""
    return R.distinct_values(S.obs(spark, sf), "paper")


@register("paper_counts_sorted", with_(OBS) + """
SELECT paper, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY paper ORDER BY n DESC, paper""")
def q_paper_counts_sorted(spark, sf):
    """O1: a total order on a report."""
    o = S.obs(spark, sf)
    return R.sort_by_key(o.groupBy("paper").agg(F.count(F.lit(1)).alias("n")), F.desc("n"), "paper")


@register("in_date_range", with_(OBS) + """
SELECT paper,
       CAST(count(*) FILTER (WHERE event_ts <= TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS n_inclusive,
       CAST(count(*) AS BIGINT) AS n_whole_day
FROM obs WHERE event_ts >= TIMESTAMP '2024-01-03 00:00:00' AND event_ts < TIMESTAMP '2024-01-11 00:00:00'
GROUP BY paper""")
def q_in_date_range(spark, sf):
    """inclusive window; one scan serves both end rules (midnight end and whole last day)."""
    o = FL.in_date_range(S.obs(spark, sf), "2024-01-03", "2024-01-10", end_of_day=True)
    return o.groupBy("paper").agg(
        F.count_if(F.col("event_ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("n_inclusive"),
        F.count(F.lit(1)).alias("n_whole_day"))


@register("in_date_range_midnight", with_(OBS) + """
SELECT obs_id, event_ts FROM obs
WHERE event_ts >= TIMESTAMP '2024-01-03 00:00:00' AND event_ts <= TIMESTAMP '2024-01-10 00:00:00'""")
def q_in_date_range_midnight(spark, sf):
    """F1 with its default end rule: up to midnight at the start of the last day."""
    return FL.in_date_range(S.obs(spark, sf), "2024-01-03", "2024-01-10").select("obs_id", "event_ts")


@register("drop_incomplete", with_(OBS) + """
SELECT paper, CAST(count(*) AS BIGINT) AS n FROM obs
WHERE obs_id IS NOT NULL AND paper IS NOT NULL AND topic IS NOT NULL AND score IS NOT NULL AND event_ts IS NOT NULL
GROUP BY paper""")
def q_drop_incomplete(spark, sf):
    """rows without any NULL, counted per paper."""
    return FL.drop_incomplete(S.obs(spark, sf)).groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
