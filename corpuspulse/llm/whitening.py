"""Embedding whitening: spectral divide and conquer with QDWH polar decompositions, then a broadcast projection.

The rows are cut into integers (``floor(scale * entry)``), so sums over any number of rows are exact.  Three passes
over the distinct integer vectors, each a sum per task and a sum of these by Spark: counts and sums per dimension,
the covariance of the centred vectors, and the covariance of the whitened ones as a check.  Between them the driver
holds one dimension x dimension matrix, whose size has nothing to do with the number of rows.

Its eigenvectors come from the polar factor of the shifted covariance: for symmetric ``A`` and a shift ``s`` between
two eigenvalues, the orthogonal polar factor ``U`` of ``A - s I`` is +1 on the invariant subspace above the shift and
-1 below, so ``(U + I) / 2`` is its spectral projector.  Bases of both subspaces divide the matrix in two smaller
ones, and so on down to single components.  The polar factor is found by the QR form of the dynamically weighted
Halley iteration, which needs at most six steps at any condition number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm.common import cut, prepare

SCALE = 256
COMPONENTS = 4
LARGEST = float(2 ** 53)     # scaled entries are exact in double precision up to here
DIMENSION = 4096             # the driver's matrix has at most so many rows (134 MB)
EPS = np.finfo(np.float64).eps


# ---- the spectral part: one symmetric matrix ----------------------------------------------------------------------

def polar(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by QDWH steps (QR form)."""
    d = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(d)
    x = a / norm
    # A lower bound of the least singular value; too small a value costs a step, never accuracy.
    r = np.linalg.qr(x, mode="r")
    low = EPS
    if np.abs(np.diag(r)).min() > EPS:
        low = max(low, 0.9 / (np.sqrt(d) * np.linalg.norm(np.linalg.inv(r), 1)))
    for _ in range(steps):
        low2 = low * low
        g = np.cbrt(4 * (1 - low2) / (low2 * low2))
        wa = np.sqrt(1 + g) + 0.5 * np.sqrt(8 - 4 * g + 8 * (2 - low2) / (low2 * np.sqrt(1 + g)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _r = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))
        new = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:d] @ q[d:].T)
        low = min(1.0, low * (wa + wb * low2) / (1 + wc * low2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 10 * EPS ** (1 / 3) and abs(1 - low) < 10 * EPS:
            break
    return x


def _split(a: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of ``a`` (larger eigenvalues first), or None where no shift divides it."""
    d = len(a)
    own = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.trace(a) / d * np.eye(d))
    mean = np.trace(a) / d
    for shift in (np.median(own) if d > 2 else mean, mean, mean + spread / d, mean - spread / d, *(mean + spread / np.sqrt(d) * rng.uniform(-1, 1, 8))):
        u = polar(a - shift * np.eye(d))
        upper = (u + u.T) / 4 + np.eye(d) / 2
        k = int(round(np.trace(upper)))
        if not 0 < k < d:
            continue
        # Two rounds of orthogonal iteration give the projector's range; a random start avoids its null space.
        q = np.linalg.qr(upper @ rng.standard_normal((d, d)))[0]
        q = np.linalg.qr(np.hstack([upper @ q[:, :k], (np.eye(d) - upper) @ q[:, k:]]))[0]
        off = np.linalg.norm(q[:, :k].T @ a @ q[:, k:])
        if off <= 1e3 * EPS * d * np.linalg.norm(a):
            return q[:, :k], q[:, k:]
    return None


def spectral_components(a: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix by spectral divide and conquer.

    The sign of a vector is fixed: its entry of largest size is positive.  Vectors of equal eigenvalues are some basis.
    """
    a = (a + a.T) / 2
    rng = np.random.default_rng(seed)
    scale = np.linalg.norm(a)
    values, vectors = [], []
    work = [np.eye(len(a))] if len(a) else []
    while work:
        basis = work.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        d = len(part)
        flat = np.linalg.norm(part - np.trace(part) / d * np.eye(d)) <= 4 * EPS * scale
        halves = None if d == 1 or flat else _split(part, rng)
        if halves is None and d > 1 and not flat:  # no shift divides it cleanly: Jacobi turns finish so close a cluster
            values_, turn = _jacobi(part)
            values.extend(values_)
            vectors.extend((basis @ turn).T)
        elif halves is None:
            values.extend(np.diag(part))
            vectors.extend(basis.T)
        else:
            work.extend(basis @ h for h in halves)
    v = np.array(vectors).T.reshape(len(a), len(a))
    w = np.array(values)
    for _ in range(2):
        v, w = _polished(a, v, w, scale)
    order = np.argsort(-w, kind="stable")
    v, w = v[:, order], w[order]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(w))]) if len(w) else np.ones(0)
    return w, v * np.where(sign == 0, 1, sign)


def _jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a small nearly flat matrix by cyclic Jacobi rotations."""
    a, v = a.copy(), np.eye(len(a))
    for _ in range(60):
        off = np.abs(a - np.diag(np.diag(a)))
        if off.max() <= EPS * max(np.abs(a).max(), 1e-300):
            break
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j]:
                    t = 0.5 * np.arctan2(2 * a[i, j], a[i, i] - a[j, j])
                    turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
                    a[:, [i, j]] = a[:, [i, j]] @ turn
                    a[[i, j], :] = turn.T @ a[[i, j], :]
                    v[:, [i, j]] = v[:, [i, j]] @ turn
    return np.diag(a).copy(), v


def _polished(a, v, w, scale):
    """One Newton step on the whole basis: wins back the last digits, which the recursion's products lose."""
    if len(w) < 2:
        return v, w
    r = np.eye(len(w)) - v.T @ v
    s = v.T @ a @ v
    w = np.diag(s) / (1 - np.diag(r))
    gap = w[None, :] - w[:, None]
    near = np.abs(gap) <= 1e-8 * scale
    e = np.where(near, r / 2, (s + w[None, :] * r) / np.where(near, 1.0, gap))
    np.fill_diagonal(e, np.diag(r) / 2)
    v = v + v @ e
    return v @ (3 * np.eye(len(w)) - v.T @ v) / 2, w   # narrow gaps leave the basis a little off square


# ---- the passes over the rows -------------------------------------------------------------------------------------

def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, x array<long>)`` of the rows that take part: all entries finite numbers (and exact when scaled)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.when(fit, F.transform(v, lambda c: F.floor(c * scale).cast("long"))).alias("x")).where("x is not null")


def _flat(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix, without Python objects."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype=values.dtype)


def _added(tasks: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Rows ``(i, v array)`` of all tasks summed by ``i``: rows of one ``i`` meet in a task, which keeps their sum only.

    At most a row per dimension returns to the driver.
    """
    def run(batches):
        import pyarrow as pa
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_numpy(), batch.column("v")):
                v = v.values.to_numpy()
                total[int(i)] = total[int(i)] + v if int(i) in total else v.copy()
        if total:
            yield pa.RecordBatch.from_pydict({"i": list(total), "v": [v.tolist() for v in total.values()]}, pa.schema(
                [("i", pa.int32()), ("v", pa.list_(pa.int64() if kind == "long" else pa.float64()))]))
    rows = tasks.repartition("i").mapInArrow(run, f"i int, v array<{kind}>").collect()
    return {r["i"]: np.array(r["v"]) for r in rows}


def exact_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sum per dimension (long)."""
    def run(batches):
        import pyarrow as pa
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _flat(batch.column("x"))
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": [0, 1], "v": [[n], total.tolist()]}, pa.schema([("i", pa.int32()), ("v", pa.list_(pa.int64()))]))
    got = _added(fit.mapInArrow(run, "i int, v array<long>"), "long")
    return (int(got[0][0]), got[1]) if got else (0, np.zeros(0, dtype=np.int64))


def covariance(fit: DataFrame, mean: np.ndarray, n: int, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor ``n``) of the vectors, centred before multiplying; of ``(x - mean) @ turn`` where given."""
    def run(batches):
        import pyarrow as pa
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _flat(batch.column("x")) - mean
                if turn is not None:
                    y = y @ turn
                add = y.T @ y
                total = add if total is None else total + add
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(total))), "v": total.tolist()},
                                             pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))]))
    got = _added(fit.mapInArrow(run, "i int, v array<double>"), "double")
    return np.array([got[i] for i in sorted(got)]) / max(n, 1)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per vector and leading component.

    With ``x = floor(scale * entry)``, ``n`` distinct integer vectors with sums ``S`` and their covariance ``V``:
    ``deviation`` is the exact sum of ``(n x - S)^2``, ``whitened`` the centred vector on the unit eigenvector over the
    root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest entry of
    the whitened vectors' covariance minus the identity, measured on the rows.

    Defined cases: vectors that are NULL, empty, or hold NULL or non-finite entries or such as cannot be scaled
    exactly (2^53) take no part; where lengths differ, those of the most frequent one (ties: the longer) do;
    repeated rows are fitted once and returned each; NULL and repeated ids are ordinary; directions without
    variance (eigenvalue at rounding level) are no components, so one distinct vector, or none, gives no rows; a
    ``deviation`` beyond long is NULL; further columns are ignored.  Vectors wider than 4,096 are refused.
    """
    prepare(vectors.sparkSession)
    schema = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(
        dict(vectors.dtypes)[id_col])
    none = vectors.sparkSession.createDataFrame([], schema)
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    width = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if width is None:
        return none
    d = width["d"]
    if d > DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {DIMENSION} are supported")
    rows = cut(rows.where(F.size("x") == d))
    fit = cut(rows.select("x").distinct())
    n, sums = exact_sums(fit)
    mean = sums / n
    cov = covariance(fit, mean, n)
    values, basis = spectral_components(cov)
    trace = float(np.trace(cov))
    live = values[:components] > d * EPS * max(values[0], 0.0)
    k = int(live.sum())
    if not k:
        return none
    turn = basis[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(covariance(fit, mean, n, turn) - np.eye(k)).max())
    share = values[:k] / trace

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            m = batch.num_rows
            x = _flat(batch.column("x"))
            if not m:
                continue
            white = (x - mean) @ turn
            far = np.abs(x.astype(np.float64) * n - sums).max()
            if far < 2.0 ** 53 and far * far * d < 2.0 ** 62:
                deviation = ((x * n - sums) ** 2).sum(axis=1)
            else:
                exact = [sum((int(c) * n - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
                deviation = np.array([e if e < 2 ** 63 else None for e in exact], dtype=object)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(deviation[at], pa.int64()), pa.array(white.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)
