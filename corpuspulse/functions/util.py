"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Higher-order function bodies are evaluated per array element; a column
    they read that Catalyst inlines from a lower projection (the optimizer
    collapses projections) would be recomputed for every element.  Binding
    it through a one-element ``transform`` keeps one evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``let`` for two values."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: body(s["a"], s["b"]))


def json_literal(value, ddl_type: str) -> Column:
    """A (small, bounded) Python value as one typed literal: ``from_json`` of a JSON string.

    Catalyst constant-folds it into a single literal, so a lexicon or a
    centroid table costs one driver call instead of one per element.
    """
    import json
    return F.from_json(F.lit(json.dumps(value, allow_nan=True)), ddl_type)


def distinct_array(df: DataFrame, col: str, shared: str | None = None) -> Column:
    """The distinct values of a column, NULL included, as one sorted array (a scalar subquery).

    Runs with the query that uses it (no job while the plan is built).  Meant for dimensions of aggregated rows.
    ``shared`` names a further column to read, so that the subquery's input equals (and reuses) an aggregate that
    the main query shuffles anyway.
    """
    values = F.sort_array(F.collect_set(F.struct(F.col(col).alias("v"))))
    also = F.max(shared) if shared else F.lit(0)
    return df.agg(F.struct(values.alias("a"), also.alias("b")).alias("s")).scalar()["a"]["v"]


def dense_cells(base: DataFrame, row: str, col: str, names: Column, values: dict[str, Column]) -> DataFrame:
    """Every (row, col) cell of an aggregated table: existing cells, and ``values`` where one is absent.

    ``names`` is the array of all column values (``distinct_array``); each row adds the names it lacks.
    """
    cells = base.groupBy(row).agg(F.collect_list(F.struct(col, *values)).alias("_cells"))
    lacking = cells.withColumn("_lack", F.array_except(names, F.col("_cells")[col]))
    filled = F.transform("_lack", lambda t: F.struct(t.alias(col), *[v.alias(n) for n, v in values.items()]))
    return lacking.select(row, F.explode(F.concat("_cells", filled)).alias("_c")).select(row, "_c.*")
