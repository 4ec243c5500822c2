"""M4, the silhouette with plain Euclidean distances, bounded on both sides without any pair of rows.

A point's mean distance to a cluster is the mean root of its squared distances, whose mean ``m`` and variance ``s2`` follow
from the cluster's centre, covariance, and third and fourth moments.  Since ``1 + u/2 - u^2/2 <= sqrt(1 + u) <= 1 + u/2``
for ``u >= -1``, the mean distance lies in ``[sqrt(m) (1 - s2 / (2 m^2)), sqrt(m)]``; ``sqrt(m) (1 - s2 / (8 m^2))`` is the
estimate in between.  Two scans collect the moments, one scan bounds every point, and a last one measures the points with
the widest bounds exactly.  Moments are (dimension squared) numbers per cluster, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.operators.kmeans import blocks, squared
from corpuspulse.operators.vectors import complete_vectors, matrices, matrix, partial_sums, usual_width
from corpuspulse.session import ship_package


def _moments(rows: DataFrame, clusters: int, dim: int, label_of):
    """Per cluster: size, centre, covariance, mean cubed vector, mean fourth power of the length (all about the centre)."""
    import numpy as np

    def sums(batches):
        total = np.zeros((clusters, dim + 1))
        for batch in batches:
            x, at = matrix(batch.column("v")), label_of(batch)
            for c in np.unique(at[at >= 0]):
                part = x[at == c]
                total[c] += np.append(len(part), part.sum(axis=0))
        return {int(c): total[c] for c in np.flatnonzero(total[:, 0])}
    got = partial_sums(rows, sums, dim + 1)
    n = np.zeros(clusters)
    mean = np.zeros((clusters, dim))
    for c, v in got.items():
        n[c], mean[c] = v[0], v[1:] / v[0]

    def powers(batches):
        total = np.zeros((clusters, dim * dim + dim + 1))
        for batch in batches:
            x, at = matrix(batch.column("v")), label_of(batch)
            for c in np.unique(at[at >= 0]):
                y = x[at == c] - mean[c]
                q = (y * y).sum(axis=1)
                total[c] += np.concatenate([(y.T @ y).ravel(), y.T @ q, [float(q @ q)]])
        return {int(c): total[c] for c in range(clusters) if total[c].any()}
    cov, cube, fourth = np.zeros((clusters, dim, dim)), np.zeros((clusters, dim)), np.zeros(clusters)
    for c, v in partial_sums(rows, powers, dim * dim + dim + 1).items():
        v = v / n[c]
        cov[c], cube[c], fourth[c] = v[:dim * dim].reshape(dim, dim), v[dim * dim:-1], v[-1]
    return n, mean, cov, cube, fourth


def _bounds(x, own, n, mean, cov, cube, fourth):
    """Low, estimate and high of the silhouette of each row of ``x`` in cluster ``own``."""
    import numpy as np
    rows = np.arange(len(x))
    low, mid, high = (np.full((len(x), len(n)), np.inf) for _ in range(3))
    spread = np.trace(cov, axis1=1, axis2=2)
    for c in np.flatnonzero(n):
        u = x - mean[c]
        uu = (u * u).sum(axis=1)
        m = uu + spread[c]
        second = uu * uu + 4 * ((u @ cov[c]) * u).sum(axis=1) + fourth[c] + 2 * uu * spread[c] - 4 * (u @ cube[c])
        others = np.where(own == c, n[c] - 1, n[c])
        some = others > 0
        scale = np.where(some, n[c] / np.maximum(others, 1), 0)
        m, second = m * scale, second * scale
        s2 = np.maximum(second - m * m, 0)
        root, part = np.sqrt(np.maximum(m, 0)), s2 / np.where(m > 0, m * m, 1)
        low[:, c], mid[:, c], high[:, c] = root * np.maximum(1 - part / 2, 0), root * (1 - np.minimum(part, 4) / 8), root
    a = [d[rows, own].copy() for d in (low, mid, high)]
    for d in (low, mid, high):
        d[rows, own] = np.inf
    b = [d.min(axis=1) for d in (low, mid, high)]
    alone = (n[own] <= 1) | ~np.isfinite(b[0])

    def s(near, far):
        top = np.maximum(near, far)
        return np.where(alone | ~(top > 0), 0.0, (far - near) / np.where(top > 0, top, 1))
    with np.errstate(invalid="ignore"):
        return s(a[2], b[0]), s(a[1], b[1]), s(a[0], b[2])


def _labelled(vecs: DataFrame, label: str, vec: str, id_col: str):
    """``(id, c, v)`` with clusters numbered in the order of their labels, and the number of clusters."""
    dim = usual_width(vecs, vec)
    rows = complete_vectors(vecs.where(F.col(label).isNotNull()), vec, dim, F.col(id_col).alias("id"), F.col(label).alias("l"))
    names = [r["l"] for r in rows.select("l").distinct().orderBy("l").collect()]
    if not names:
        return rows.select("id", F.lit(0).alias("c"), "v"), 0, dim
    of = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(names)), f"c int, l {dict(rows.dtypes)['l']}"))
    return rows.join(of, "l").select("id", "c", "v"), len(names), dim


def silhouette_points(vecs: DataFrame, label: str = "cluster_label", vec: str = "embedding", id_col: str = "vec_id", refine: int = 0) -> DataFrame:
    """``(id, low, silhouette, high)`` per row: guaranteed bounds and the estimate; the ``refine`` widest rows are exact.

    Rows with a NULL label, or a NULL or incomplete vector, are left out.  A cluster of one row, and a labelling with one
    cluster, score 0.  Refined rows travel to the others as one block, so ``refine`` bounds what a task holds.
    """
    import numpy as np
    ship_package(vecs.sparkSession)
    rows, clusters, dim = _labelled(vecs, label, vec, id_col)
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, low double, silhouette double, high double"
    if not clusters:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = rows.persist()
    label_of = lambda batch: batch.column("c").to_numpy()
    moments = _moments(rows, clusters, dim, label_of)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x, own = matrix(batch.column("v")), label_of(batch)
            got = [_bounds(x[s], own[s], *moments) for s in blocks(x, clusters * 4 + dim)]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(np.concatenate(c)) for c in zip(*got)]],
                                                 names=["id", "low", "silhouette", "high"])
    points = rows.mapInArrow(run, schema)
    if refine:
        points = _refined(points, rows, clusters, moments[0], refine, schema)
    return points.withColumnRenamed("id", id_col)


def _refined(points: DataFrame, rows: DataFrame, clusters: int, n, refine: int, schema: str) -> DataFrame:
    """``points`` with the widest ones measured exactly: their distances to all rows, summed per cluster in one scan."""
    import numpy as np
    wide = points.orderBy(F.desc(F.col("high") - F.col("low")), "id").limit(refine).select("id")
    # A repeated id is measured as all of its rows.
    picked = [(r["id"], r["c"], r["v"]) for r in rows.join(wide.distinct(), "id").select("id", "c", "v").distinct().collect()]
    if not picked:
        return points
    x = np.array([v for _i, _c, v in picked])
    size = (x * x).sum(axis=1)

    def work(batches):
        total = np.zeros((len(x), clusters))
        for batch in batches:
            y, at = matrix(batch.column("v")), batch.column("c").to_numpy()
            for s in blocks(y, len(x)):
                d = np.sqrt(squared(y[s], x, size))
                # The product form loses small distances: those are measured again by differences.
                for i, j in zip(*np.nonzero(d < 1e-3 * np.sqrt(size)[None, :])):
                    d[i, j] = np.sqrt(((y[s][i] - x[j]) ** 2).sum())
                for c in np.unique(at[s]):
                    total[:, c] += d[at[s] == c].sum(axis=0)
        return {p: total[p] for p in range(len(x))}
    sums = partial_sums(rows, work, clusters)
    exact = []
    for p, (i, own, v) in enumerate(picked):
        mean = np.where(n > 0, sums[p] / np.maximum(n, 1), np.inf)
        far = np.delete(mean, own).min() if clusters > 1 else np.inf
        near = sums[p][own] / max(n[own] - 1, 1)
        value = 0.0 if n[own] <= 1 or not np.isfinite(far) or max(near, far) <= 0 else (far - near) / max(near, far)
        exact.append((i, own, v, float(value)))
    of = rows.sparkSession.createDataFrame(exact, f"id {schema.split(',')[0][3:]}, c int, v array<double>, s double")
    known = rows.join(of, ["id", "c", "v"]).select("id", F.col("s").alias("low"), F.col("s").alias("silhouette"), F.col("s").alias("high"))
    return points.join(of.select("id").distinct(), "id", "left_anti").unionByName(known)


def silhouette_euclidean(vecs: DataFrame, label: str = "cluster_label", vec: str = "embedding", id_col: str = "vec_id", refine: int = 0) -> DataFrame:
    """One row ``(silhouette, low, high, n)``: the mean Euclidean silhouette lies in ``[low, high]``; no rows give n = 0."""
    return silhouette_points(vecs, label, vec, id_col, refine).agg(
        F.avg("silhouette").alias("silhouette"), F.avg("low").alias("low"), F.avg("high").alias("high"), F.count(F.lit(1)).alias("n"))


def sweep_silhouettes(rows: DataFrame, centers: dict) -> dict:
    """``{k: (low, estimate, high)}`` of the nearest-centre labellings of ``rows(v)``, packed or not, for all k in the same three scans."""
    import numpy as np
    ks = sorted(k for k in centers if len(centers[k]))
    if not ks:
        return {}
    sizes = {k: (centers[k] ** 2).sum(axis=1) for k in ks}
    dim = centers[ks[0]].shape[1]

    def labels(x, k):
        return np.concatenate([squared(x[s], centers[k], sizes[k]).argmin(axis=1) for s in blocks(x, len(sizes[k]))]) if len(x) else np.zeros(0, int)

    start = dict(zip(ks, np.append(0, np.cumsum([len(centers[k]) for k in ks]))))
    total = sum(len(centers[k]) for k in ks)
    def sums(work_of, width):
        def work(batches):
            out = np.zeros((total, width))
            for x in matrices(batches):
                for k in ks:
                    at = labels(x, k)
                    for c in np.unique(at):
                        out[start[k] + c] += work_of(x[at == c], start[k] + c)
            return {int(c): out[c] for c in np.flatnonzero(out.any(axis=1))}
        return partial_sums(rows, work, width)

    n, mean = np.zeros(total), np.zeros((total, dim))
    for c, v in sums(lambda y, c: np.append(len(y), y.sum(axis=0)), dim + 1).items():
        n[c], mean[c] = v[0], v[1:] / v[0]

    def powers(y, c):
        y = y - mean[c]
        q = (y * y).sum(axis=1)
        return np.concatenate([(y.T @ y).ravel(), y.T @ q, [float(q @ q)]])
    cov, cube, fourth = np.zeros((total, dim, dim)), np.zeros((total, dim)), np.zeros(total)
    for c, v in sums(powers, dim * dim + dim + 1).items():
        v = v / n[c]
        cov[c], cube[c], fourth[c] = v[:dim * dim].reshape(dim, dim), v[dim * dim:-1], v[-1]

    def means(batches):
        out = {k: np.zeros(4) for k in ks}
        for x in matrices(batches):
            for k in ks:
                own, a = labels(x, k), start[k]
                part = slice(a, a + len(sizes[k]))
                for s in blocks(x, 4 * len(sizes[k]) + dim):
                    got = _bounds(x[s], own[s], n[part], mean[part], cov[part], cube[part], fourth[part])
                    out[k] += [len(got[0]), *[g.sum() for g in got]]
        return {k: v for k, v in out.items() if v[0]}
    return {k: tuple(v[1:] / v[0]) for k, v in partial_sums(rows, means, 4).items()}
