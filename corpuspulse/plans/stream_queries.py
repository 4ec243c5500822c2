"""Registered queries: the streaming jobs run to completion (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.plans.registry import HEADS, OBS, register, with_
from corpuspulse.plans.standins import one_line
from corpuspulse.streaming import jobs as J


def _obs_stream(spark, sf):
    e = J.file_stream(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("obs_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("paper"),
        F.col("event_type").alias("topic"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value") - 34).alias("score"),
        F.col("ts").alias("event_ts"))


@register("stream_topic_by_day", with_(OBS) + """
SELECT CAST(event_ts AS DATE) AS day, topic, round(avg(score), 6) AS value
FROM obs WHERE event_ts IS NOT NULL GROUP BY 1, 2""")
def q_stream_topic_by_day(spark, sf):
    """Streaming A10: per-batch partial sums per day and topic, combined over all batches."""
    r = J.topic_by_day_total(J.run_available_now(_obs_stream(spark, sf), "topic-by-day", J.topic_by_day_parts))
    return r.select("day", "topic", F.round("value", 6).alias("value"))


@register("stream_dedup_headlines", with_(HEADS) + "SELECT DISTINCT headline FROM heads")
def q_stream_dedup_headlines(spark, sf):
    """Streaming W1: first row per headline of each batch, then over all batches."""
    d = J.file_stream(spark, sf, "documents")
    heads = d.select("doc_id", F.col("source").alias("paper"), one_line("text").alias("headline"))
    first = J.dedup_parts()
    return first(J.run_available_now(heads, "dedup", first)).select("headline")
