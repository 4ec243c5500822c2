"""Logical inputs expressed over the benchmark tables.

The coverage model needs scored texts, party positions, headlines, keyword
taxonomies and lexicons.  These functions derive them from the shared tables
so every registered query does work proportional to the data; the small
parameter tables (aliases, outcomes, keyword and lexicon lists) are literal
inputs, as a caller would pass them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspulse.session import in_parts, spread
from corpuspulse.sources.tables import driver_table


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text-heavy table, dealt over the cores, or into parts of bounded size when it is large
    (CPU-bound per-row work)."""
    return in_parts(driver_table(spark, sf_dir, name))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table ``(obs_id, paper, topic, score, event_ts)`` from ``events``.

    Every 7th event is left unscored (NULL); ``value - 34`` gives both signs.
    """
    e = driver_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("obs_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("paper"),
        F.col("event_type").alias("topic"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value") - 34).alias("score"),
        F.col("ts").alias("event_ts"))


def prog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party positions ``(party, topic, score)``: mean event value per party x type, centred."""
    e = driver_table(spark, sf_dir, "events")
    return (e.groupBy(F.concat(F.lit("q"), (F.col("user_id") % 7).cast("string")).alias("party"),
                      F.col("event_type").alias("topic"))
            .agg(F.round(F.avg("value") - 49.63, 4).alias("score")))


# Fixed parameter tables (inputs a caller supplies).  ACTUAL reuses the published
# election outcome percentages in their original order, assigned to the stand-in
# parties q0..q6 (the last one under another name, reached through ACTUAL_ALIAS).
PARTY_ALIAS = [("q0", "view"), ("q1", "click"), ("q2", "error")]
ACTUAL = [("q0", 37.0), ("q1", 14.4), ("q2", 15.8), ("q3", 14.6), ("q4", 8.4), ("q5", 3.0), ("Q6", 1.5)]
ACTUAL_ALIAS = [("q6", "Q6")]
PAPERS = [f"p{i}" for i in range(8)]


def party_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARTY_ALIAS, "party string, topic string")


def actual(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTUAL, "party string, pct double")


def actual_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTUAL_ALIAS, "party string, actual_party string")


def heads(spark: SparkSession, sf_dir: str, parts: bool = True) -> DataFrame:
    """Headlines ``(doc_id, paper, lang, headline)``: the whole text of each document on one line.

    Without ``parts`` a large table keeps its splits, for jobs that shuffle the headlines anyway or do little with them.
    """
    d = text_table(spark, sf_dir, "documents") if parts else spread(driver_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("source").alias("paper"), "lang", one_line("text").alias("headline"))


def one_line(col) -> Column:
    """A text with its line breaks as blanks."""
    return F.translate(F.col(col), "\n", " ")


def docs(spark: SparkSession, sf_dir: str, parts: bool = True) -> DataFrame:
    """Programme documents ``(doc_id, party, text)``; ``parts`` as in ``heads``."""
    d = (text_table(spark, sf_dir, "documents") if parts else spread(driver_table(spark, sf_dir, "documents"))).select("doc_id", "source", "text")
    return d.select("doc_id", F.col("source").alias("party"), "text")


# Keyword taxonomy over frequent English fragments of the invented prose.
KEYWORDS = [
    ("conj", 0, "and of"), ("conj", 1, "that"), ("conj", 2, "the"),
    ("article", 0, "the"), ("article", 1, "an"),
    ("pron", 0, "this"), ("pron", 1, "it is"), ("pron", 2, "with"),
]

# Valence lexicon over frequent tokens of the invented prose (token, valence).
LEXICON = [
    ("the", 0.5), ("and", 1.2), ("of", -0.8), ("is", 0.3), ("to", -0.4),
    ("that", 1.5), ("with", -1.1), ("for", 0.9), ("on", -0.6), ("as", 0.7),
    ("by", -1.3), ("this", 1.1), ("it", -0.2), ("are", 0.4), ("an", -0.9),
    ("le", 1.0), ("la", -1.0), ("de", 0.6), ("der", -0.7), ("die", 0.8),
    ("el", -0.5), ("en", 0.2), ("et", -0.3), ("un", 1.4), ("und", -1.2),
]

# Boosters and negators (fixed values of the lexicon scorer).
BOOSTERS = [("very", 0.293), ("really", 0.293), ("most", 0.293), ("less", -0.293), ("the", 0.293)]
NEGATORS = ["not", "no", "never", "without", "of"]


def kw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "topic string, pos int, keyword string")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token string, valence double")


def boosters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOOSTERS, "token string, boost double")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "labels")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "embeddings")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "pages")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "conversations")


# Fixed parameter lists for the cleaners (a caller supplies real stop/lemma tables).
STOP_EN = ["a", "is", "of", "to", "in", "it"]
STOP_DE = ["der", "die", "und", "das"]
LEMMAS = {"ere": "er", "ings": "ing", "ed": "e"}
TOPIC_ALIAS = [("view", "views"), ("click", "clicks")]


def topic_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPIC_ALIAS, "raw string, topic string")
