"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds.

Every vector is stored as the sign bits of its randomly rotated direction (packed, 1 bit per dimension) plus two
scalars: its norm and the inner product of the direction with its own code.  For a query the inner product with
the code gives an unbiased estimate of the true one and a confidence bound of its error.  In each block only
vectors whose upper bound reaches the block's k-th best lower bound are reranked with the original vectors, in
double precision.

Work is dealt as (vector block, query block) pairs of bounded size: a stated query set against all rows, in
blocks.  Each pair returns at most k rows per query, and a window over those ranks them.  Nothing is broadcast
or collected; hot vectors spread by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.llm.common import prepare

BLOCK_VECTORS = 8_192
BLOCK_QUERIES = 4_096
EPSILON = 2.2  # width of the error bound; larger values rerank more vectors
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, and inner products of each direction with its code."""
    norm = np.linalg.norm(x, axis=1)
    y = (x / norm[:, None]) @ turn.T
    bits = y > 0
    own = np.where(bits, y, -y).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), norm, own


def bound_tables(bits, norm, own, dim: int, epsilon: float):
    """Per vector: code scaled so that its inner product with a rotated query estimates the true one, and the
    width of the estimate's confidence interval per unit of query norm."""
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    spread = epsilon * norm * np.sqrt(np.maximum(0.0, 1 - own**2)) / (own * np.sqrt(max(1, dim - 1)))
    return signs * (norm / own).astype(np.float32)[:, None], spread.astype(np.float32)


def search_block(vid, x, qid, queries, k: int, epsilon: float):
    """Best k vectors of one block for each query: estimate, bound, rerank; ``(qid, vid, score)`` rows."""
    dim = x.shape[1]
    turn = rotation(dim)
    table, spread = bound_tables(*codes(x, turn), dim, epsilon)
    upper_table = np.hstack([table, spread[:, None]])
    by_id = np.argsort(vid, kind="stable")
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(qid), 256):
        q, ids = queries[a:a + 256], qid[a:a + 256]
        r = (q @ turn.T).astype(np.float32)
        size = np.linalg.norm(q, axis=1).astype(np.float32)
        upper = np.hstack([r, size[:, None]]) @ upper_table.T  # estimate plus its error bound
        upper[~np.isfinite(upper)] = np.inf  # no bound in single precision: reranked
        lo, hi = np.searchsorted(vid[by_id], ids), np.searchsorted(vid[by_id], ids, side="right")
        for i in np.flatnonzero(hi > lo).tolist():
            upper[i, by_id[lo[i]:hi[i]]] = -np.inf  # never its own neighbour
        # The k-th best lower bound of any part of the block is a valid bar for all of it.
        part = min(len(vid), max(4 * k, 1024))
        low = upper[:, :part] - 2 * size[:, None] * spread[None, :part]
        low[~np.isfinite(low)] = -np.inf
        need = min(k, part)
        bar = np.partition(low, part - need, axis=1)[:, part - need]
        row, col = np.nonzero(upper >= bar[:, None])
        edge = np.searchsorted(row, np.arange(len(q) + 1))
        for i in range(len(q)):
            cand = col[edge[i]:edge[i + 1]]
            up = upper[i, cand]
            cand, up = cand[up > -np.inf], up[up > -np.inf]
            if len(cand) > k:
                lower = up - 2 * size[i] * spread[cand]
                lower[~np.isfinite(lower)] = -np.inf
                cand = cand[up >= np.partition(lower, len(cand) - k)[len(cand) - k]]
            score = (x[cand] * q[i]).sum(axis=1)
            best = np.lexsort((vid[cand], -score))[:k]
            out_q.append(np.full(len(best), ids[i]))
            out_v.append(vid[cand[best]])
            out_s.append(score[best])
    join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
    return join(out_q, np.int64), join(out_v, np.int64), join(out_s, np.float64)


def _search(k: int, epsilon: float):
    def run(key, base, queries):
        import pyarrow as pa

        def matrix(t):
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            return t.column("vid").to_numpy(), flat.reshape(t.num_rows, -1)

        if base.num_rows and queries.num_rows:
            got = search_block(*matrix(base), *matrix(queries), k, epsilon)
        else:
            got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})
    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vid, v, dim)`` of vectors that are not NULL, empty, zero, and hold only finite components."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vid"), v.alias("v"))
            .where(F.col("vid").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(ok, F.lit(False)))
            .withColumn("dim", F.size("v")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, epsilon: float = EPSILON,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` vectors of largest inner product per query.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and NULL ids, take no part; only
    vectors of the query's dimension are candidates; rows with the query's own id are not.  Ties go to the
    smaller id, then rank 1 upwards; repeated rows are separate candidates (a repeated query id is one query per
    distinct vector).  Fewer candidates than ``k`` give fewer rows; empty tables an empty result.
    """
    prepare(vectors.sparkSession)
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col).dropDuplicates(["vid", "v"])
    blocks = max(1, -(-vectors.count() // BLOCK_VECTORS))
    groups = max(1, -(-queries.count() // BLOCK_QUERIES))
    number = lambda n: F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("block", number(blocks)).withColumn("ask", every(groups))
    right = asked.withColumn("ask", number(groups)).withColumn("block", every(blocks))
    found = (left.groupBy("block", "ask", "dim").cogroup(right.groupBy("block", "ask", "dim"))
             .applyInArrow(_search(k, epsilon), "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
