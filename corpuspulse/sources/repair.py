"""Repair CSV rows whose headline held commas and collapsed into ``date``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.functions.util import let, let2


def repair_csv(df: DataFrame, papers: DataFrame | list[str], extra=()) -> tuple[DataFrame, DataFrame]:
    """Split collapsed rows (``headline`` NULL) back into columns.

    The ``date`` text is split on ``,``; pieces 2.. are merged until a piece
    equals a known paper; ``""`` becomes ``"`` and one outer quote is removed
    on each side; the paper piece and the pieces after it fill ``paper`` and
    ``extra`` columns.  Returns ``(repaired, quarantine)``: rows where no
    paper piece exists (or with fewer than two pieces) go to quarantine.

    Row-local: the known papers are one array (a scalar subquery over the
    paper table), so no row is exploded, joined or keyed; rows with NULL or
    repeated keys are repaired one by one.
    """
    if isinstance(papers, list):
        known = F.array(*[F.lit(p) for p in papers]) if papers else F.array().cast("array<string>")
    else:
        known = papers.where("paper is not null").agg(F.collect_set("paper")).scalar()
    # The first piece from the third on that is a known paper (hashed intersection, order kept): one column, because a
    # subquery may not stand inside a higher-order function.
    broken = F.col("headline").isNull()
    parts = F.split(F.col("date"), ",")
    tail = lambda p: F.slice(p, 3, F.greatest(F.size(p), F.lit(1)))
    hit = F.get(F.array_intersect(tail(parts), known), F.lit(0))

    def fields(p, paper):
        """The row's new fields, all from one split; NULL where no piece is a paper."""
        def at(i):
            merged = F.regexp_replace(F.replace(F.array_join(F.slice(p, 2, i - 1), ","), F.lit('""'), F.lit('"')), '^"|"$', "")
            return F.when(paper.isNotNull(), F.struct(F.element_at(p, 1).alias("date"), merged.alias("headline"), paper.alias("paper"),
                                                      *[F.try_element_at(p, i + 2 + k).alias(f"extra{k}") for k in range(len(extra))]))
        return let(F.coalesce(F.array_position(tail(p), paper).cast("int"), F.lit(1)) + 1, at)

    # One row-local pass: good rows keep their fields, broken ones get new ones (NULL: quarantine).  Rows are chosen by
    # exploding nothing or one struct: a filter on it would be evaluated once more, down at the scan.
    j = df.withColumn("_hit", F.when(broken, hit))
    kinds = dict(df.dtypes)
    new = {"date": "date", "headline": "headline", "paper": "paper", **{c: f"extra{k}" for k, c in enumerate(extra)}}
    made = let2(parts, F.col("_hit"), fields)
    row = F.when(broken, let(made, lambda m: F.when(m.isNotNull(), F.struct(*[m[f].cast(kinds[c]).alias(c) for c, f in new.items()])))).otherwise(
        F.struct(*[F.col(c).alias(c) for c in new]))
    repaired = j.select(*[c for c in df.columns if c not in new], F.explode(F.array_compact(F.array(row))).alias("_row"))
    lost = F.explode(F.when(broken & hit.isNull(), F.array(F.lit(0)))).alias("_lost")
    return (repaired.select(*[F.col("_row")[c].alias(c) if c in new else F.col(c) for c in df.columns]),
            df.select("*", lost).drop("_lost"))
