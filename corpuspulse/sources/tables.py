"""Table sources and sinks (Parquet by default, CSV with header for exchange)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Read a stage table.  CSV is read with a header, ``"`` quoting and doubled-quote escapes.

    Pass ``schema`` for CSV in production: inference costs a full extra scan.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        opts = {"header": "true", "quote": '"', "escape": '"', "multiLine": "false"}
        opts.update(options)
        return reader.options(**opts).csv(path)
    return reader.options(**options).format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, **options) -> None:
    """Write a stage table; ``partition_by`` (e.g. ``paper``) enables partition pruning later."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        opts = {"header": "true", "quote": '"', "escape": '"'}
        opts.update(options)
        w.options(**opts).csv(path)
    else:
        w.options(**options).format(fmt).save(path)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the benchmark tables (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
