"""Shared helpers for vector columns: complete rows, Arrow buffers as matrices, sums of partial rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.session import ship_package


def complete(vec: Column, dim: int | None = None) -> Column:
    """True where a vector is present, not empty (of ``dim`` entries if given), and all its entries are finite numbers."""
    fit = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return fit if dim is None else fit & (F.size(vec) == dim)


PACK_BYTES = 4 << 20     # numbers of a packed block
DEAL_BYTES = 1 << 20     # a core gets at least this much of a small table
PART_BYTES = 32 << 20    # a part of a large table


def usual_shape(vecs: DataFrame, vec: str) -> tuple[int, int]:
    """The most frequent length of the complete vectors (ties: the longer), and how many have it; zeros without any."""
    v = F.col(vec).cast("array<double>")
    row = vecs.select(F.when(complete(v), F.size(v)).alias("d")).where("d is not null").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    return (row["d"], row["count"]) if row else (0, 0)


def usual_width(vecs: DataFrame, vec: str) -> int:
    """The most frequent length of the complete vectors (ties: the longer); 0 without any."""
    return usual_shape(vecs, vec)[0]


def complete_vectors(vecs: DataFrame, vec: str, dim: int, *keep: str) -> DataFrame:
    """The rows that hold a complete vector of ``dim`` entries, as ``(*keep, v array<double>)``."""
    v = F.col(vec).cast("array<double>")
    return vecs.where(complete(v, dim)).select(*keep, v.alias("v"))


def matrix(column):
    """An Arrow list column of equal lengths without NULLs as a numpy matrix; reads the buffer, makes no Python objects."""
    import numpy as np
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def dealt(rows: DataFrame, dim: int, n: int) -> DataFrame:
    """``n`` vectors of ``dim`` entries dealt evenly over the cores, or into parts of ``PART_BYTES`` where that makes more parts.

    A table of vectors is often one row group, or a few, so that a scan would keep one core busy.
    """
    size = 8 * dim * n
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(cores, -(-size // DEAL_BYTES)), -(-size // PART_BYTES)))


def packed(rows: DataFrame) -> DataFrame:
    """``(n, b)``: the vectors ``v`` in blocks of ``n`` rows, the numbers of a block as one binary value.

    Tasks that scan the vectors many times get a block as it is; an array column is written anew, number by number, for every scan.
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = matrix(batch.column("v"))
            step = max(1, PACK_BYTES // max(1, 8 * x.shape[1]))
            for a in range(0, len(x), step):
                block = x[a:a + step]
                yield pa.RecordBatch.from_arrays([pa.array([len(block)], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["n", "b"])
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, "n int, b binary")


def matrices(batches):
    """The matrices of Arrow batches of ``(v)`` or of packed blocks ``(n, b)``; none is empty."""
    import numpy as np
    for batch in batches:
        if "b" in batch.schema.names:
            for n, b in zip(batch.column("n").to_pylist(), batch.column("b")):
                yield np.frombuffer(b.as_buffer(), np.float64).reshape(n, -1)
        elif batch.num_rows:
            yield matrix(batch.column("v"))


def partial_sums(rows: DataFrame, work, width: int):
    """Run ``work(batches) -> {key: float vector of width}`` once per task and add the vectors of each key.

    Rows of one key meet in a task that keeps their running sum, so no task holds more than its keys' sums.  Returns
    ``{key: numpy vector}``; keys are ints below a bound the caller knows (clusters, dimensions), never row ids.
    """
    import numpy as np
    import pyarrow as pa
    ship_package(rows.sparkSession)
    kind = pa.schema([("k", pa.int64()), ("v", pa.list_(pa.float64()))])

    def as_batch(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.ListArray.from_arrays(
            pa.array(np.arange(len(sums) + 1) * width, pa.int32()), pa.array(np.concatenate(list(sums.values()))))], schema=kind)

    def each(batches):
        sums = work(batches)
        if sums:
            yield as_batch(sums)

    def added(batches):
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in zip(batch.column("k").to_numpy(), matrix(batch.column("v"))):
                    k = int(k)
                    total[k] = total[k] + v if k in total else v.copy()
        if total:
            yield as_batch(total)

    out = rows.mapInArrow(each, "k long, v array<double>").repartition("k").mapInArrow(added, "k long, v array<double>")
    table = out.toArrow()
    return dict(zip(table.column("k").to_pylist(), matrix(table.column("v")).copy())) if table.num_rows else {}
