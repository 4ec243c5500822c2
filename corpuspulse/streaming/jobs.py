"""Structured Streaming forms of the per-row and per-window operators, exact for any arrival order.

A micro-batch is reduced by the batch operator to partial rows (``n, total`` per day and topic; the first row per
headline), which are written under the batch's id.  Reading the result combines the partial rows of all batches.
Sums and minima do not depend on arrival order, so no event is ever too late, no state grows, and a replayed batch
replaces its first attempt.

Checkpoints and sinks live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspulse.functions.scores import nan_to_null
from corpuspulse.functions.text import clean_en
from corpuspulse.operators.reports import dedup_first
from corpuspulse.session import scratch_table_path


def topic_by_day_parts(scores: DataFrame) -> DataFrame:
    """Partial A10 of one batch: ``(day, topic, n, total)``."""
    score = nan_to_null("score")
    return (scores.where(F.col("event_ts").isNotNull()).groupBy(F.to_date("event_ts").alias("day"), "topic")
            .agg(F.count(score).alias("n"), F.sum(score).alias("total")))


def topic_by_day_total(parts: DataFrame) -> DataFrame:
    """A10 from the partial rows of all batches: ``(day, topic, value)``."""
    g = parts.groupBy("day", "topic").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return g.select("day", "topic", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("value"))


def dedup_parts(order=("paper", "doc_id"), key: str = "headline") -> Callable[[DataFrame], DataFrame]:
    """Partial W1: the first row per key of one batch (and, over all partial rows, of all batches)."""
    return lambda rows: dedup_first(rows, key, order)


def clean_stream(heads: DataFrame, stop_words=(), lemmas=None) -> DataFrame:
    """The batch cleaner applies unchanged to a stream (per-row expression)."""
    return heads.withColumn("headline_en", clean_en("headline", stop_words, lemmas))


def run_available_now(stream: DataFrame, name: str, parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reduce everything available batch by batch with ``parts``; returns the partial rows of all batches.

    Every micro-batch is written to its own ``<sink>/batch_id=<n>`` folder with overwrite, so a batch replayed
    after a failure replaces its earlier attempt (exactly-once effect).  An empty source gives no rows; a failed
    query raises.
    """
    spark = stream.sparkSession
    run = uuid.uuid4().hex
    sink = scratch_table_path(spark, f"stream-{name}-{run}/out")
    ckpt = scratch_table_path(spark, f"stream-{name}-{run}/checkpoint")
    # The sink exists, with its schema, also when no batch arrives.
    shape = parts(spark.createDataFrame([], stream.schema))
    shape.write.mode("overwrite").parquet(f"{sink}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        parts(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(write)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(shape.schema).parquet(sink).select(*shape.columns)


def file_stream(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A table as a streaming file source: one Parquet file, or a folder of them."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def headline_file_stream(spark: SparkSession, path: str, mode: str = "fixed") -> DataFrame:
    """S1 + S2 on a stream: new ``*.txt`` headline files under ``path`` as they arrive.

    Same line rule as the batch reader (split at the first separator, blank
    lines skipped, paper from the file name, date parsed); the event time is
    the parsed date.
    """
    from corpuspulse.functions.text import parse_event_time
    from corpuspulse.sources.headlines import paper_from_file_name, split_line
    raw = (spark.readStream.option("pathGlobFilter", "*.txt").format("text").load(path)
           .select("value", F.col("_metadata.file_name").alias("_file")))
    raw = raw.where(F.length(F.trim("value")) > 0)
    date_raw, headline = split_line("value")
    return raw.select(paper_from_file_name("_file", mode).alias("paper"), date_raw.alias("date_raw"),
                      parse_event_time(date_raw).alias("event_ts"), headline.alias("headline"))
