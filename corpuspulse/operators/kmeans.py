"""M2 and M5: k-means for one or many k in the same scans.

A scan carries the centres of every k that still moves (k times dimension numbers, set by the caller's parameters) to the
rows and returns counts, sums and costs per centre; a sweep over fifty k therefore reads the vectors once per iteration,
not once per fit.  Distances come from one matrix product per block of rows.  No state per row is kept between scans, so a
lost executor costs its part of one scan.  Starts are found by parallel seeding once for the largest k; its weighted
candidates are reduced for every k on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.operators.vectors import complete_vectors, dealt, matrices, matrix, packed, partial_sums, usual_shape
from corpuspulse.session import ship_package

BLOCK = 2_000_000      # distances held at a time
MAX_CENTERS = 50_000_000   # numbers that travel with a scan (centres of all k together)


@dataclass
class Sweep:
    """Centres and cost per k, and the scans it took."""

    centers: dict = field(default_factory=dict)
    cost: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)
    scans: int = 0


def blocks(x, width: int):
    """Row slices of a matrix such that ``width`` numbers per row stay below ``BLOCK``."""
    step = max(1, BLOCK // max(1, width))
    return (slice(a, a + step) for a in range(0, len(x), step))


def squared(x, centers, size):
    """Squared distances of rows to centres (``size`` has the centres' squared lengths)."""
    import numpy as np
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centers.T) + size[None, :]
    return np.maximum(d, 0, out=d)


def assign_and_sum(rows: DataFrame, centers: dict) -> dict:
    """One scan for all k: ``{k: (counts, sums, cost)}`` of the nearest centres (ties: the first)."""
    import numpy as np
    ks = sorted(centers)
    all_ = np.concatenate([centers[k] for k in ks])
    if all_.size > MAX_CENTERS:
        raise ValueError(f"{all_.size} numbers of centres; at most {MAX_CENTERS} travel with a scan")
    start = np.append(0, np.cumsum([len(centers[k]) for k in ks]))
    size, dim = (all_ * all_).sum(axis=1), all_.shape[1]
    twice = np.ascontiguousarray(-2 * all_.T)
    small = np.int16 if max(len(c) for c in centers.values()) < 2 ** 15 else np.int64   # short numbers sort in one pass

    def work(batches):
        total = np.zeros((len(all_), dim + 2))
        for x_all in matrices(batches):
            for s in blocks(x_all, len(all_)):
                x = x_all[s]
                # Squared distances but for the rows' own lengths, which only the nearest ones need.
                d = x @ twice
                d += size
                own = (x * x).sum(axis=1)
                for a, b in zip(start, start[1:]):
                    near = d[:, a:b].argmin(axis=1)
                    cost = np.maximum(np.take_along_axis(d[:, a:b], near[:, None], 1)[:, 0] + own, 0)
                    order = np.argsort(near.astype(small), kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(near[order]) > 0))
                    at = a + near[order][first]
                    total[at, 0] += np.diff(np.append(first, len(x)))
                    total[at, 1] += np.add.reduceat(cost[order], first)
                    total[at, 2:] += np.add.reduceat(x[order], first, axis=0)
        return {int(c): total[c] for c in np.flatnonzero(total[:, 0])}

    got = partial_sums(rows, work, dim + 2)
    full = np.zeros((len(all_), dim + 2))
    for c, v in got.items():
        full[c] = v
    return {k: (full[a:b, 0], full[a:b, 2:], float(full[a:b, 1].sum())) for k, a, b in zip(ks, start, start[1:])}


def lloyd(rows: DataFrame, centers: dict, max_iter: int, tol: float = 1e-4) -> Sweep:
    """Lloyd iterations for all k together; a k whose centres move at most ``tol`` leaves the scans.

    Empty centres stay where they are, and a negative ``tol`` runs all ``max_iter`` iterations.  The last scan gives every k's final cost and sizes.
    """
    import numpy as np
    out = Sweep({k: np.array(c, dtype=float) for k, c in centers.items()})
    live = {k for k, c in out.centers.items() if len(c)}
    for _ in range(max_iter):
        if not live:
            break
        sums = assign_and_sum(rows, {k: out.centers[k] for k in live})
        out.scans += 1
        for k, (n, s, _cost) in sums.items():
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], out.centers[k])
            if np.sqrt(((new - out.centers[k]) ** 2).sum(axis=1).max()) <= tol:
                live.discard(k)
            out.centers[k] = new
    some = {k: c for k, c in out.centers.items() if len(c)}
    if some:
        for k, (n, _s, cost) in assign_and_sum(rows, some).items():
            out.cost[k], out.sizes[k] = cost, n
        out.scans += 1
    return out


def _drawn(rows: DataFrame, centers, share: float | None, seed: int):
    """The cost of all rows, and the rows drawn with probability ``share * squared distance`` (by a hash of the vector)."""
    import numpy as np
    size = (centers * centers).sum(axis=1)
    if share is None:
        def work(batches):
            total = 0.0
            for x in matrices(batches):
                total += sum(float(squared(x[s], centers, size).min(axis=1).sum()) for s in blocks(x, len(centers)))
            return {0: np.array([total])}
        return partial_sums(rows, work, 1)[0][0]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                x, u = matrix(batch.column("v")), batch.column("u").to_numpy()
                near = np.concatenate([squared(x[s], centers, size).min(axis=1) for s in blocks(x, len(centers))])
                yield batch.filter(pa.array(u < share * near)).select(["v"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "v"), 11) / F.lit(float(2 ** 53))).alias("u")
    return np.array([r["v"] for r in rows.select("v", u).mapInArrow(run, "v array<double>").distinct().collect()])


def seeds(rows: DataFrame, ks, seed: int = 42, rounds: int = 3) -> dict:
    """Starting centres for every k: parallel seeding for the largest k, then weighted seeding among the candidates.

    Each round draws about twice the largest k of the rows, likelier where they are far from all candidates so far;
    fewer distinct vectors than k give fewer centres.
    """
    import numpy as np
    ks = sorted(set(int(k) for k in ks))
    top = max(ks, default=0)
    first = rows.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(1).collect()
    if not first:
        return {k: np.zeros((0, 0)) for k in ks}
    found = np.array([first[0]["v"]])
    for r in range(rounds):
        cost = _drawn(rows, found, None, seed)
        if cost <= 0:
            break
        new = _drawn(rows, found, 2 * top / cost, seed + r + 1)
        if len(new):
            found = np.unique(np.concatenate([found, new]), axis=0)
    weight = assign_and_sum(rows, {0: found})[0][0]
    found, weight = found[weight > 0], weight[weight > 0]
    return {k: _chosen(found, weight, k, np.random.default_rng(seed)) for k in ks}


def _chosen(points, weight, k: int, rng, rounds: int = 10):
    """``k`` of the weighted points: each next one with probability weight times squared distance, then a few Lloyd rounds."""
    import numpy as np
    at = [int(rng.choice(len(points), p=weight / weight.sum()))]
    near = ((points - points[at[0]]) ** 2).sum(axis=1)
    while len(at) < k and (near * weight).sum() > 0:
        at.append(int(rng.choice(len(points), p=near * weight / (near * weight).sum())))
        near = np.minimum(near, ((points - points[at[-1]]) ** 2).sum(axis=1))
    centers = points[at].copy()
    for _ in range(rounds):
        label = squared(points, centers, (centers * centers).sum(axis=1)).argmin(axis=1)
        mass = np.bincount(label, weight, minlength=len(centers))
        sums = np.stack([np.bincount(label, weight * points[:, j], minlength=len(centers)) for j in range(points.shape[1])], axis=1)
        centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centers)
    return centers


def training_rows(vecs: DataFrame, vec: str = "embedding") -> DataFrame:
    """The complete vectors ``(v)`` that a fit reads, dealt over the cores; NULL and incomplete ones take no part."""
    dim, n = usual_shape(vecs, vec)
    return dealt(complete_vectors(vecs, vec, dim), dim, n)


def kmeans_sweep(vecs: DataFrame, ks, seed: int = 42, vec: str = "embedding", max_iter: int = 300, tol: float = 1e-4) -> Sweep:
    """K-means for every k of ``ks`` in shared scans; the vectors are cached while it runs.

    An empty table gives no centres and no costs.
    """
    ship_package(vecs.sparkSession)
    rows = training_rows(vecs, vec).persist()
    scanned = packed(rows).persist()
    try:
        return lloyd(scanned, seeds(rows, ks, seed), max_iter, tol)
    finally:
        scanned.unpersist()
        rows.unpersist()
