"""Quality rules, native: counting rules plus a hashed n-gram log-likelihood ratio (importance weight).

Two multinomials over ``buckets`` hashed token uni- and bigrams are counted: one over every document (raw) and
one over trusted documents (target).  A document's score is the mean of ``log p_target - log p_raw`` over its
n-grams.  A document is kept unless a counting rule fails or its score is below ``threshold``.

Everything is DataFrame functions; no Python runs on the executors.  Counting is one scan with map-side partial
sums (at most ``buckets`` rows leave each task), scoring is one projection per row without any shuffle.  All
trusted ids count: they meet the documents in a sort-merge join at any size, so each text moves once, never more,
and no list of ids has to fit into a broadcast.
Weights are integers (1e-6 steps), hence a score does not depend on summation order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.functions.util import json_literal, let

WHITE = r"[\x20\x09-\x0D]+"
TOKEN = r"\w+|[^\w\s]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 10_000
THRESHOLD = -0.3
SCALE = 1_000_000
FEW = 12


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def _covered(starts: Column, size: int) -> Column:
    """Words covered by windows of ``size`` words at the ascending ``starts``."""
    first = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, p: F.struct(
        p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")), lambda a: a["n"])


def _repeat_words(ws: Column, size: int = 3) -> Column:
    """Words in windows of ``size`` words that occur at least twice in the text (first one included)."""
    def few(h: Column, repeated: Column) -> Column:
        """Starts of windows whose hash is one of a few repeated ones."""
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull())

    def many(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(tagged, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, k: F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False))
                     | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False))), lambda e: e["i"])))

    def starts(h: Column) -> Column:
        # Most texts repeat a handful of windows at most: a look at each window is then cheaper than sorting them.
        repeated = let(F.sort_array(h), lambda o: F.array_distinct(F.filter(
            o, lambda x, i: F.coalesce(x == F.get(o, i + 1), F.lit(False)))))
        return let(repeated, lambda r: F.when(F.size(r) <= FEW, few(h, r)).otherwise(many(h)))

    grams = F.when(F.size(ws) > size, F.transform(
        F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(size)]))
    ).otherwise(F.array().cast("array<bigint>"))
    return let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
               .otherwise(_covered(starts(h), size)))


def signals(text: Column) -> list[Column]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` of a text (NULL: all 0)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    counted = let(words(t), lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("r")))
    return [counted["n"].cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            counted["r"].cast("long").alias("n_repeat_words")]


def gram_hashes(text: Column) -> Column:
    """Hashes of the token uni- and bigrams of a text."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    unigrams = F.transform(tokens, lambda t: F.xxhash64(t))
    return let(unigrams, lambda u: F.concat(u, F.when(F.size(u) > 1, F.zip_with(
        F.slice(u, 1, F.size(u) - 1), F.slice(u, 2, F.size(u) - 1), lambda a, b: F.xxhash64(a, b)))
        .otherwise(F.array().cast("array<bigint>"))))


def bucket(h: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """All distinct ids labelled as good."""
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).cast("long").alias("tid")).where("tid is not null")
    return good.distinct()


def mark_trusted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text, and in ``tid`` its id where that is trusted."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # A NULL id is never trusted; its rows are dealt by their text, so a join by shuffle does not gather them.
    none = F.col("id").isNull()
    d = d.select(none.alias("none"), F.when(none, F.xxhash64("text")).otherwise(F.col("id")).alias("id"), "text")
    return d.join(trusted.withColumn("real", F.lit(False)).hint("merge"), (F.col("id") == F.col("tid")) & (F.col("none") == F.col("real")), "left")


def fit_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                buckets: int = BUCKETS, smooth: float = 1.0) -> list[int]:
    """``SCALE * (log p_target - log p_raw)`` per bucket; counts cover every document."""
    marked = mark_trusted(docs, trusted, id_col, text_col)
    counts = (marked.select(F.col("tid").isNotNull().cast("long").alias("t"), F.explode(gram_hashes(F.col("text"))).alias("h"))
              .groupBy(bucket(F.col("h"), buckets).alias("b")).agg(F.count("*").alias("raw"), F.sum("t").alias("target")))
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():  # at most ``buckets`` rows
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + smooth * buckets, sum(target) + smooth * buckets
    if not sum(target):
        return [0] * buckets
    return [round(SCALE * (math.log((t + smooth) / n_target) - math.log((r + smooth) / n_raw)))
            for r, t in zip(raw, target)]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  buckets: int = BUCKETS, threshold: float = THRESHOLD, rec: bool = False) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept[, text, rec])``.

    One row per row of ``docs`` (repeated ids included; a NULL id is never trusted).  A NULL or empty text has
    no words, fails the counting rules and gets ``llr`` 0.  Without any trusted document every ``llr`` is 0,
    so only the counting rules decide.  An empty table gives an empty result.
    """
    weights = fit_weights(docs, trusted_ids(labels), id_col, text_col, buckets)
    table = json_literal(weights, "array<int>")
    text = F.col(f"`{text_col}`").cast("string")
    more = [c for c in docs.columns if c not in (id_col, text_col)]
    carried = [text.alias("text"), (F.struct(*[F.col(f"`{c}`") for c in more]) if more
                                    else F.struct(F.lit(None).cast("int").alias("none"))).alias("rec")] if rec else []
    total = let(gram_hashes(text), lambda g: F.when(F.size(g) > 0, F.aggregate(
        g, F.lit(0).cast("long"), lambda a, h: a + F.get(table, bucket(h, buckets)).cast("long")) / F.size(g)).otherwise(F.lit(0.0)))
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *signals(text),
                      (total / SCALE).alias("llr"), *carried)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
