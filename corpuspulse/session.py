"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins and coalesces partitions at
# runtime, skew-join splits hot partitions, UTC keeps timestamps comparable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "corpuspulse", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` is left to ``spark-submit`` on a cluster; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_LOCAL_SCRATCH: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage configured by the operator
    (it is a core setting, fixed when the application starts); without it we
    refuse to run there.  Only in local mode (tests) a scratch folder is made.
    """
    global _LOCAL_SCRATCH
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this application")
        if _LOCAL_SCRATCH is None:
            _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="corpuspulse-ckpt-")
        path = _LOCAL_SCRATCH
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a materialised stage."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


# At most this many bytes per core are ever moved by ``spread``.
SPREAD_BYTES_PER_CORE = 16 << 20


def scan_bytes(df) -> int:
    """The optimizer's size of ``df`` (file sizes for a scan); plans only, reads nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df):
    """Deal a *small* scan over the cores; larger inputs keep their splits and get no shuffle.

    A small Parquet table is often one row group, so one task would do all CPU-heavy text work.  Only inputs of
    at most ``SPREAD_BYTES_PER_CORE`` per core are dealt out, so the moved volume has a fixed bound.  Used at
    the scan only, never inside operators.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scan_bytes(df) > cores * SPREAD_BYTES_PER_CORE:
        return df
    # Two partitions per core (``corpuspulse.spread.factor``) even out rows of very
    # different cost (texts of 1 to 20,000 words).
    return df.repartition(int(df.sparkSession.conf.get("corpuspulse.spread.factor", "2")) * cores)


PART_BYTES = 32 << 20


def in_parts(df):
    """``spread``, and a larger scan dealt into parts of ``PART_BYTES``, so that no task of CPU-heavy text work grows with it.

    The splits of a large table are whole row groups of up to 128 MB; here each row moves once, whatever the table's size.
    """
    size = scan_bytes(df)
    if size <= df.sparkSession.sparkContext.defaultParallelism * SPREAD_BYTES_PER_CORE:
        return spread(df)
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


BROADCAST_BYTES = 32 << 20


def table_bytes(df) -> int:
    """Measured bytes of the rows of ``df``: one small aggregate over text and array lengths."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def width(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
        if isinstance(f.dataType, T.ArrayType):
            inner = (F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
                     if isinstance(f.dataType.elementType, T.StringType) else F.size(c).cast("long") * 16)
            return F.coalesce(inner, F.lit(0)) + 16
        return F.lit(16).cast("long")

    total = sum((width(f) for f in df.schema.fields), F.lit(16).cast("long"))
    return int(df.agg(F.sum(total)).first()[0] or 0)


def broadcast_if_small(df, max_bytes: int = BROADCAST_BYTES):
    """Hint a broadcast only where the measured bytes of ``df`` are at most ``max_bytes``.

    Larger inputs get no hint: the planner and AQE pick a shuffle join from
    the measured sizes.  Meant for parameter and dimension tables.
    """
    from pyspark.sql import functions as F
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpuspulse`` importable in the Python workers (once per application).

    Operators that run Python tasks (page rules, caller models, automata,
    numpy centroids) unpickle objects defined in this package.  This is the
    ``--py-files`` mechanism: the package is zipped on the driver and
    ``addPyFile`` distributes it; workers put it on their path per task.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="corpuspulse-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
