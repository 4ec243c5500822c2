"""Shared-scan k-means and the bounded Euclidean silhouette, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuspulse.operators import clusters as C
from corpuspulse.operators import kmeans as KM
from corpuspulse.operators import silhouettes as S
from corpuspulse.operators import vectors as V

SCHEMA = "vec_id long, embedding array<double>, cluster_label string"


def frame(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(c) for c in v], None if labels is None else str(labels[i])) for i, v in enumerate(x)], SCHEMA)


def blobs(n=400, k=6, dim=5, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, k, n)
    return rng.standard_normal((n, dim)) + 12 * rng.standard_normal((k, dim))[at], at


def exact(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        means = {c: d[i, labels == c].sum() / max((labels == c).sum() - (c == labels[i]), 1) for c in set(labels)}
        own = means.pop(labels[i])
        far = min(means.values(), default=None)
        out.append(0.0 if far is None or (labels == labels[i]).sum() == 1 or max(own, far) == 0 else (far - own) / max(own, far))
    return np.array(out)


def test_all_k_step_as_each_alone(spark):
    x, _at = blobs()
    rows = KM.training_rows(frame(spark, x)).persist()
    starts = {k: x[:k] for k in (1, 2, 7, 30)}
    got = KM.lloyd(rows, starts, 4, tol=-1.0)
    assert got.scans == 5
    for k, c in starts.items():
        c = c.copy()
        for _ in range(4):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert np.allclose(got.centers[k], c) and abs(got.cost[k] - d.min(axis=1).sum()) < 1e-6
        assert np.array_equal(got.sizes[k], np.bincount(d.argmin(axis=1), minlength=k))


def test_a_sweep_reads_once_per_iteration_and_finds_the_blobs(spark):
    x, at = blobs()
    fit = KM.kmeans_sweep(frame(spark, x), range(2, 12), max_iter=50)
    assert fit.scans <= 51
    inside = sum(((x[at == c] - x[at == c].mean(axis=0)) ** 2).sum() for c in set(at))
    assert fit.cost[6] < 1.01 * inside
    costs = [fit.cost[k] for k in sorted(fit.cost)]
    assert costs[0] > costs[3] > costs[-1]
    again = KM.kmeans_sweep(frame(spark, x[::-1]).repartition(3), [6])
    assert abs(again.cost[6] - fit.cost[6]) < 1e-6 * fit.cost[6]


def test_awkward_vectors(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, None, "a"), (3, [1.0, None], "b"), (4, [float("nan"), 1.0], "b"), (5, [5.0], "a"), (6, [9.0, 9.0], None),
            (7, [9.0, 9.0], "b"), (None, [0.1, 0.0], "a"), (1, [0.0, 0.1], "a"), (8, [], "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assigned, _cents, _cost = C.kmeans_cluster(df, k=2)
    label = {}
    for r in assigned.collect():
        label.setdefault(r.vec_id, []).append(r.cluster_label)
    assert len(assigned.collect()) == len(rows) and label[2] == label[3] == label[4] == label[5] == label[8] == [None]
    assert label[6] == label[7] != label[None] and label[1] == label[None] * 2
    empty = spark.createDataFrame([], SCHEMA)
    assert C.kmeans_cluster(empty, k=3)[0].count() == 0 and C.elbow_curve(empty, [2]).count() == 0 and C.silhouette_sweep(empty, [2]).count() == 0
    few = C.kmeans_cluster(df.where("vec_id in (1, 7)"), k=50)
    assert few[1].count() == 3 and few[2] < 1e-12
    points = S.silhouette_points(df).collect()
    assert sorted(str(r.vec_id) for r in points) == ["1", "1", "7", "None"]
    assert S.silhouette_points(empty).collect() == [] and S.silhouette_euclidean(empty).first().n == 0
    one = S.silhouette_points(df.where("cluster_label = 'a'")).collect()
    assert {r.silhouette for r in one} == {0.0}


@pytest.mark.parametrize("kind", ["blobs", "noise", "copies"])
def test_bounds_hold_and_refinement_is_exact(spark, kind):
    rng = np.random.default_rng(4)
    x, labels = blobs(250) if kind == "blobs" else (rng.standard_normal((250, 5)), rng.integers(0, 4, 250))
    if kind == "copies":
        x, labels = np.repeat(x[:25], 10, axis=0), np.repeat(labels[:25], 10)
        labels[3] = 77
    df = frame(spark, x, labels)
    want = exact(x, labels)
    got = {r.vec_id: r for r in S.silhouette_points(df).collect()}
    assert len(got) == len(x)
    for i, s in enumerate(want):
        assert got[i].low - 1e-9 <= s <= got[i].high + 1e-9 and got[i].low <= got[i].silhouette <= got[i].high
    mean = S.silhouette_euclidean(df).first()
    assert mean.low <= want.mean() <= mean.high and mean.n == len(x)
    some = {r.vec_id: r for r in S.silhouette_points(df, refine=100).collect()}
    sharp = [i for i, r in some.items() if r.low == r.high]
    assert len(some) == len(x) and len(sharp) >= 100 and all(abs(some[i].silhouette - want[i]) < 1e-9 for i in sharp)
    every = S.silhouette_euclidean(df, refine=10_000).first()
    assert abs(every.silhouette - want.mean()) < 1e-9


def test_estimate_is_close_on_the_embeddings(spark):
    """Without refinement, on 500 vectors of 64 entries: the estimate is within 0.002 of brute force, the bounds within 0.03."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("string").alias("cluster_label"))
    rows = sorted(v.collect())
    want = exact(np.array([r.embedding for r in rows], dtype=float), np.array([r.cluster_label for r in rows])).mean()
    got = S.silhouette_euclidean(v).first()
    assert abs(got.silhouette - want) < 0.002 and got.high - got.low < 0.06


def test_sweep_of_silhouettes_matches_each_labelling(spark):
    x, _at = blobs(300)
    rows = KM.training_rows(frame(spark, x)).persist()
    fit = KM.lloyd(rows, KM.seeds(rows, [2, 5, 6, 9]), 30)
    got = S.sweep_silhouettes(rows, fit.centers)
    for k, (low, _mid, high) in got.items():
        labels = ((x[:, None] - fit.centers[k][None]) ** 2).sum(axis=2).argmin(axis=1)
        alone = S.silhouette_euclidean(frame(spark, x, labels)).first()
        assert np.allclose(got[k], (alone.low, alone.silhouette, alone.high)) and low <= exact(x, labels).mean() <= high


def test_a_one_file_table_keeps_all_cores_busy_and_packed_blocks_sum_alike(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((12_000, 64))
    path = str(tmp_path / "vecs")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(path)
    vecs = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert vecs.rdd.getNumPartitions() <= 2
    rows = KM.training_rows(vecs)
    assert rows.rdd.getNumPartitions() == min(cores, 6)   # 6 MB
    assert V.dealt(vecs.select("embedding"), 64, 10 ** 7).rdd.getNumPartitions() >= 153     # 5 GB
    blocks = V.packed(rows)
    assert blocks.agg(F.sum("n")).first()[0] == len(x) and blocks.agg(F.max(F.length("b"))).first()[0] <= V.PACK_BYTES
    starts = {3: x[:3], 40: x[:40]}
    plain, fast = KM.assign_and_sum(rows, starts), KM.assign_and_sum(blocks, starts)
    for k, c in starts.items():
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        for n, sums, cost in (plain[k], fast[k]):
            assert np.array_equal(n, np.bincount(d.argmin(axis=1), minlength=k)) and abs(cost - d.min(axis=1).sum()) < 1e-6 * cost
            assert np.allclose(sums, [x[d.argmin(axis=1) == j].sum(axis=0) for j in range(k)])
