"""Mixing sources to target weights, native: weighted fair queueing over shuffled documents.

Every source is a queue that serves its documents in a shuffled order, up to ``passes`` times over.  The copy that
pass ``p`` serves has the virtual finish time ``(p * words of the source + words served up to it) / target words``,
so at any virtual time all sources have had the same part of their targets.  The mix is the queue of all copies in
order of finish time, truncated where its words reach the budget.

How it scales.  Documents are narrow rows from the first projection on.  A source's running sum is taken in buckets
of the shuffle key: sums per (source, bucket) first, whose prefix shifts the running sums inside each bucket, so a
source with a third of all rows is as many tasks as it has buckets.  Equal ranges of virtual time hold equal numbers
of words whatever the sources are, so the sorted queue needs no sampled ranges: words are summed per range of
virtual time, the range in which the budget is reached is found from these sums, and only the copies of that range
are ordered to find the last copy taken.  Every document then knows its copies by comparing with that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.llm.common import cut
from corpuspulse.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
PASSES = 3          # a document is taken at most so often, a target is at most so many times its source
ROWS = 2_000        # documents a bucket of the shuffle key is meant to hold ...
BUCKETS = 65_536    # ... as long as there are no more buckets than this, for each source
SLOTS = 1_024       # ranges that a range of virtual time is divided into, twice


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_: Column, text: Column) -> Column:
    """The place of a document in its source's shuffled order: 60 bits of a digest of its id and text."""
    of = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(of), 1, 15), 16, 10).cast("long")


def cyclic_weights(docs: DataFrame, source: str = "source", cycle=CYCLE) -> DataFrame:
    """``(source, weight)``: the sources by code point, NULL last, weigh as ``cycle`` says, repeating.  One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(cycle) + 1
    return docs.select(F.col(f"`{source}`").alias("source")).distinct().select(
        "source", F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), turn).cast("long").alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame, budget: int | None = None, passes: int = PASSES) -> DataFrame:
    """``(source, weight, source_size, target)``: ``budget`` words shared by weight, no target above ``passes`` times its source.

    ``sizes(source, source_size)`` and ``weights(source, weight long)`` have a row per source.  What lies above a limit is
    shared again by weight: in the order of limit over weight, sources are limited until the share of the next one
    fits.  Sources without a weight, or with none above 0, get 0; where all are limited, the targets are the limits.
    """
    s = sizes.join(broadcast_if_small(weights.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
    s = s.select("source", "source_size", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long").alias("weight"),
                 (F.col("source_size") * passes).alias("limit"))
    if budget is None:
        budget = s.agg(F.sum("source_size")).first()[0] or 0
    wide = lambda c: c.cast("decimal(38,0)")
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "limit", "source")
    live = s.where("weight > 0").withColumn("_before", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    live = live.withColumn("_open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rest = F.lit(int(budget)) - F.col("_before")
    first = live.where(wide(rest) * wide(F.col("weight")) <= wide(F.col("limit")) * wide(F.col("_open"))).orderBy("_before", "limit").select(
        rest.alias("rest"), F.col("_open").alias("open")).first()
    share = F.col("weight") * F.lit(first["rest"] / first["open"]) if first else F.col("limit").cast("double")
    return s.select("source", "weight", "source_size", F.when(F.col("weight") > 0, F.least(F.col("limit").cast("double"), share))
                    .otherwise(F.lit(0.0)).alias("target"))


def _running(rows: DataFrame, n_rows: int) -> DataFrame:
    """``upto``: the words that the source ``sid`` has served up to each row, in its shuffled order."""
    buckets = max(1, min(BUCKETS, -(-n_rows // ROWS)))
    rows = rows.withColumn("_b", F.shiftright(F.shiftright("h", 28) * buckets, 32))
    sums = rows.groupBy("sid", "_b").agg(F.sum("size").alias("_sum"))
    shift = sums.select("sid", "_b", F.coalesce(F.sum("_sum").over(
        Window.partitionBy("sid").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("sid", "_b").orderBy("h", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_in", F.sum("size").over(inside)).join(shift, ["sid", "_b"])
            .withColumn("upto", F.col("_in") + F.col("_shift")).drop("_b", "_in", "_shift"))


def _slot(finish: Column) -> Column:
    """The range of virtual time: ``SLOTS`` equal ones before 1, from there ever longer ones."""
    return F.floor(F.when(finish < 1, finish * SLOTS).otherwise((F.log2(finish) + 1) * SLOTS)).cast("long")


def _finer(finish: Column) -> Column:
    """The place of a finish time inside its range, ``SLOTS`` again (a monotone division is all that is needed)."""
    at = F.when(finish < 1, finish * SLOTS).otherwise((F.log2(finish) + 1) * SLOTS)
    return F.floor((at - F.floor(at)) * SLOTS).cast("long")


def _crossing(copies: DataFrame, part: Column, before: int, budget: int):
    """The first range whose words pass the budget, and the words before it; None where the budget holds everything."""
    sums = copies.groupBy(part.alias("part")).agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part")) + before
    row = sums.select("part", "n", upto.alias("upto")).where(F.col("upto") > budget).orderBy("part").first()
    return row and (row["part"], row["upto"] - row["n"])


def _last_taken(copies: DataFrame, budget: int):
    """``(finish, sid, h, upto)`` of the first copy left out, or None."""
    found = _crossing(copies, _slot(F.col("finish")), 0, budget)
    if found is None:
        return None
    some = copies.where(_slot(F.col("finish")) == found[0])
    finer, before = _crossing(some, _finer(F.col("finish")), found[1], budget)
    some = some.where(_finer(F.col("finish")) == finer)
    order = ["finish", "sid", "h", "upto"]
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    return some.select(*order, upto.alias("_all")).where(F.col("_all") > budget).orderBy("_all").select(*order).first()


def _finish(p: int) -> Column:
    return (F.lit(p) * F.col("source_size") + F.col("upto")) / F.col("target")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None, passes: int = PASSES,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken, finish)``, one row per document.

    ``copies`` says how often the mix holds the document, ``taken`` its words there, and ``finish`` has the virtual
    finish time of each copy: ``mixed_order`` lays the copies out.  ``weights(source, weight)`` defaults to
    ``cyclic_weights`` and ``budget`` to the words of all documents.  The taken words of a source differ from its
    target by about one of its documents, as documents are taken whole.

    Defined cases: a NULL text has 0 words; a NULL source is a source; NULL and repeated ids are ordinary rows, and
    rows equal in id, text and source are interchangeable; documents without words have ``taken`` 0; a source
    without weight has target 0; an empty table gives an empty result.  Reruns give the same rows.  Further columns
    are ignored, whatever their names.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = cut(docs.select(c(id_col).alias("id"), c(source_col).alias("source"), word_count(c(text_col)).alias("size"),
                           shuffle_key(c(id_col), c(text_col)).alias("h")))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    n_rows, total = sizes.agg(F.sum("_rows"), F.sum("source_size")).first()
    if budget is None:
        budget = total or 0
    targets = source_targets(sizes.select("source", "source_size"), cyclic_weights(sizes) if weights is None else weights, budget, passes)
    numbered = cut(targets.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    of = broadcast_if_small(numbered.select(F.col("source").alias("_s"), "source_size", "target", "sid"))
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = cut(_running(rows, n_rows or 0))
    queued = rows.where("size > 0 and target > 0").withColumn("_p", F.explode(F.array(*[F.lit(p) for p in range(passes)])))
    queued = queued.select(((F.col("_p") * F.col("source_size") + F.col("upto")) / F.col("target")).alias("finish"), "sid", "h", "upto", "size")
    stop = _last_taken(queued, budget)
    served = F.array(*[_finish(p) for p in range(passes)])
    if stop is not None:
        end = F.struct(*[F.lit(stop[k]).cast(t).alias(k) for k, t in (("finish", "double"), ("sid", "int"), ("h", "long"), ("upto", "long"))])
        served = F.filter(served, lambda f: F.struct(f.alias("finish"), F.col("sid").cast("int").alias("sid"), F.col("h").alias("h"),
                                                     F.col("upto").alias("upto")) < end)
    served = F.when((F.col("size") > 0) & (F.col("target") > 0), served).otherwise(F.array().cast("array<double>"))
    return rows.withColumn("finish", served).select(
        "id", "source", "size", "source_size", "target", F.size("finish").alias("copies"),
        (F.size("finish") * F.col("size")).alias("taken"), "finish")


def mixed_order(mix: DataFrame) -> DataFrame:
    """The mix laid out: ``(id, source, size, finish)``, a row per copy, globally sorted by virtual finish time."""
    return mix.select("id", "source", "size", F.explode("finish").alias("finish")).orderBy("finish", F.col("source").asc_nulls_last(), "id", "size")
