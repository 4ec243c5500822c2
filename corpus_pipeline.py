"""The corpus pipeline over ``documents``: five stages, each one operator over all its predecessor kept.

All stages but the last take and return the columns of ``documents``.  Rejected documents leave in the first
three stages, the fourth shortens texts, and the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspulse.llm import toxicity
from corpuspulse.llm.common import cut, read, restored
from corpuspulse.llm.near_dedup import near_components
from corpuspulse.llm.packing import pack_documents
from corpuspulse.llm.quality_rules import quality_rules
from corpuspulse.llm.queries import byte_bpe
from corpuspulse.llm.substring_dedup import dedup_windows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model is fitted on labelled rows outside the held-out fold."""
    model = toxicity.fit(toxicity.training_sample(docs, read(spark, sf_dir, "labels")))
    return restored(toxicity.score_toxicity(docs, model).where("predicted = 0"), docs)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the likelihood ratio."""
    return restored(quality_rules(docs, read(spark, sf_dir, "labels"), rec=True).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: five-word shingles, similarity 0.8."""
    kept = near_components(docs, size=5, percent=80, rec=True).where("kept")
    # Rows that repeat an id and its text are copies too; a NULL id is not an id.
    one = kept.where("id is not null").dropDuplicates(["id", "text"]).unionByName(kept.where("id is null"))
    return restored(one, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word passages that a document with a smaller id holds."""
    out = dedup_windows(docs)
    changed = {"n_chars": F.length("text")} if "n_chars" in docs.columns else {}
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return restored(out.withColumn("text", text), docs, **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens, packed into as few sequences as possible."""
    return pack_documents(docs, byte_bpe()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("near-dedup", drop_near_copies),
          ("substring dedup", cut_repeats), ("packing", pack)]
# Kernels, signatures and the packing search have no SQL form: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is kept in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for _name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
