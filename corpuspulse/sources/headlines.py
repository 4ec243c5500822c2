"""Headline files: ``<date> - <headline>`` lines, one file per newspaper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspulse.functions.text import parse_event_time

SEPARATOR = " - "


def paper_from_file_name(name, mode: str = "fixed") -> Column:
    """``headlines_focus_politik .txt`` -> ``focus politik`` (``compat`` keeps the blank).

    Strip the extension at the first ``.``, drop the first ``_`` token, join
    the rest with blanks.  ``name`` may be URL-encoded (``%20``), as in
    ``_metadata.file_name``.
    """
    n = F.url_decode(F.col(name) if isinstance(name, str) else name)
    stem = F.substring_index(n, ".", 1)
    parts = F.split(stem, "_")
    tag = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return tag if mode == "compat" else F.trim(tag)


def split_line(line) -> tuple[Column, Column]:
    """Split at the *first* separator; the rest (more separators included) is the headline."""
    parts = F.split(F.trim(F.col(line) if isinstance(line, str) else line), SEPARATOR, 2)
    return F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))


def read_headlines(spark: SparkSession, path: str, mode: str = "fixed") -> DataFrame:
    """S1 + S2: every ``*.txt`` under ``path`` -> ``(paper, date_raw, event_ts, headline)``.

    A plain text scan (splittable, codegen) rather than CSV: quotes are data.
    Blank lines are skipped; a line without separator keeps ``headline`` NULL
    so that ``drop_incomplete`` removes it, as the literal reader does.
    """
    raw = (spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true")
           .text(path).select("value", F.col("_metadata.file_name").alias("_file")))
    raw = raw.where(F.length(F.trim("value")) > 0)
    date_raw, headline = split_line("value")
    return raw.select(paper_from_file_name("_file", mode).alias("paper"),
                      date_raw.alias("date_raw"),
                      parse_event_time(date_raw).alias("event_ts"),
                      headline.alias("headline"))


def write_headlines(df: DataFrame, path: str, date_col: str = "date_raw",
                    headline_col: str = "headline", paper_col: str | None = None,
                    mode: str = "overwrite") -> None:
    """``f"{date} - {headline}"`` lines as text files.

    With ``paper_col`` the output is partitioned by paper (``paper=<name>/``),
    which a later ``read_headlines`` can prune.
    """
    line = F.concat(F.col(date_col).cast("string"), F.lit(SEPARATOR), F.col(headline_col)).alias("value")
    cols = [line] + ([F.col(paper_col)] if paper_col else [])
    w = df.select(*cols).write.mode(mode)
    if paper_col:
        w = w.partitionBy(paper_col)
    w.text(path)


def read_written_headlines(spark: SparkSession, path: str) -> DataFrame:
    """Read back a ``write_headlines(..., paper_col=...)`` folder (paper from the partition)."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path)
    raw = raw.where(F.length(F.trim("value")) > 0)
    date_raw, headline = split_line("value")
    return raw.select("paper", date_raw.alias("date_raw"), parse_event_time(date_raw).alias("event_ts"),
                      headline.alias("headline"))


def with_source(df: DataFrame, file_col: str = "_file", mode: str = "fixed", out: str = "paper") -> DataFrame:
    """S2 on a frame that carries the file name (e.g. ``_metadata.file_name``)."""
    return df.withColumn(out, paper_from_file_name(file_col, mode))


def union_sources(*dfs: DataFrame, id_col: str | None = "headline_id") -> DataFrame:
    """S3: per-source frames appended by column name, with new row ids."""
    from corpuspulse.operators.reports import union_all
    return union_all(*dfs, id_col=id_col)
