"""Keyword taxonomy files -> ordered ``(topic, pos, keyword)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keywords_from_text(df: DataFrame, topic: str = "topic", text: str = "text",
                       mode: str = "fixed") -> DataFrame:
    """Split whole-file texts into ordered phrases.

    Each line is stripped and split on ``', '``.  ``compat`` keeps what that
    leaves (a trailing comma stays on the last phrase); ``fixed`` also strips
    commas and blanks around each phrase.  Empty phrases are dropped in both
    modes.  ``pos`` numbers the phrases of one topic in file order from 0.
    """
    lines = F.split(F.regexp_replace(F.col(text), "\r", ""), "\n")
    phrases = F.flatten(F.transform(lines, lambda ln: F.split(F.trim(ln), ", ")))
    if mode == "fixed":
        phrases = F.transform(phrases, lambda p: F.trim(F.regexp_replace(p, r"^[\s,]+|[\s,]+$", "")))
    phrases = F.filter(phrases, lambda p: F.length(p) > 0)
    return df.select(F.col(topic).alias("topic"), F.posexplode(phrases).alias("pos", "keyword"))


def read_keywords(spark: SparkSession, path: str, mode: str = "fixed") -> DataFrame:
    """Read every ``<topic>.txt`` under ``path``; one row per phrase.

    ``wholetext`` keeps each (small) file in one row so the phrase order is
    the file order; the topic is the file stem.
    """
    raw = (spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
           .select(F.col("value").alias("text"),
                   F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.[^.]*$", "").alias("topic")))
    return keywords_from_text(raw, mode=mode)
