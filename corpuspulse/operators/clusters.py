"""Vectors and clusters: embedding (M1), k-means (M2), nearest centroid (M3),
silhouette (M4), inertia / elbow (M5), 2-D projection (M6), cluster
profiles (A20-A22) and the cluster joins (J1, J2, J5).

Vectors travel as ``array<float>`` columns; Spark ML stages get them through
``array_to_vector``.  Centroid tables of any size are cut into blocks of at
most ``CENTER_BLOCK`` values; each block is one vectorised pass over the Arrow
batches in the scan's own tasks that keeps the best so far (no shuffle, no pair
is materialised, one code path for every size).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.operators.kmeans import blocks, kmeans_sweep, lloyd, seeds, squared, training_rows
from corpuspulse.operators.silhouettes import sweep_silhouettes
from corpuspulse.operators.vectors import complete, packed, usual_width
from corpuspulse.session import broadcast_if_small, ship_package

CENTER_BLOCK = 2_000_000  # k * dim values that travel with one pass
MAX_ITER = 300  # k-means iterations at most (the reference library's default)


def embed_text(df: DataFrame, col: str = "text", dim: int = 64, id_col: str = "doc_id",
               out: str = "embedding") -> DataFrame:
    """M1 baseline encoder: tokens -> hashed term frequencies (``dim`` buckets) -> IDF -> L2 norm; NULL gives NULL.

    ``embedding.embed_learned`` learns from the corpus; a caller's sentence encoder plugs in through ``scoring.batch_infer``.
    """
    missing = df.where(F.col(col).isNull()).select(id_col, F.lit(None).cast("array<float>").alias(out))
    df = df.where(F.col(col).isNotNull()).select(id_col, col)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=col, outputCol="_tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ])
    return pipe.fit(df).transform(df).select(id_col, vector_to_array("_vec", "float32").alias(out)).unionByName(missing)


def centroids_by_label(vecs: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Per-label mean vector ``(cluster_label, center array<double>)`` (one partial aggregate)."""
    g = vecs.groupBy(F.col(label).alias("cluster_label")).agg(
        Summarizer.mean(array_to_vector(F.col(vec))).alias("_m"))
    return g.select("cluster_label", vector_to_array("_m").alias("center"))


def _center_blocks(rows: DataFrame, label: str, vec: str, more=()):
    """The rows of a centre table, sorted by label, in blocks of bounded size (each read by its own bounded collect)."""
    import numpy as np
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    blocks = max(1, -(-(n["n"] * max(1, n["d"] or 1)) // CENTER_BLOCK))
    cols = rows.select(F.col(label).alias("l"), F.col(vec).cast("array<double>").alias("c"), *more).where("l is not null and c is not null")
    for b in range(blocks):
        part = cols.where(F.pmod(F.xxhash64("l"), F.lit(blocks)) == b) if blocks > 1 else cols
        got = sorted(part.collect(), key=lambda r: r["l"])
        if got:
            yield [r["l"] for r in got], [np.asarray(r["c"], dtype=np.float64) for r in got], [tuple(r[2:]) for r in got]


def _matrix(column, dim: int):
    """Rows of an Arrow list column that are vectors of length ``dim``: their index and values, read from its buffer."""
    import numpy as np
    at = column.offsets.to_numpy()
    ok = np.flatnonzero((np.diff(at) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    return ok, column.values.to_numpy()[at[:-1][ok][:, None] + np.arange(dim)]


def _nearest(x, centers):
    """First nearest centre of every row and its squared distance, measured by differences.

    A matrix product finds the candidates; rows with several within its error are decided by differences.
    """
    import numpy as np
    size = (centers * centers).sum(axis=1)
    label, value = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    for s in blocks(x, len(centers)):
        part = x[s]
        d = squared(part, centers, size)
        low = d.min(axis=1)
        close = d <= (low + 1e-12 * (size.max() + (part * part).sum(axis=1)))[:, None]
        best = close.argmax(axis=1)
        for r in np.flatnonzero(close.sum(axis=1) > 1):
            some = np.flatnonzero(close[r])
            best[r] = some[((part[r] - centers[some]) ** 2).sum(axis=1).argmin()]
        label[s], value[s] = best, ((part - centers[best]) ** 2).sum(axis=1)
    return label, value


def assign_nearest(vecs: DataFrame, centroids: DataFrame, id_col: str = "vec_id",
                   vec: str = "embedding", keep=()) -> DataFrame:
    """M3: label of the nearest centroid (ties -> smaller label) and the squared distance.

    Output ``(id, *keep, cluster_label, sqdist)``; narrow (runs in the scan stage).  A
    vector that is NULL, holds NULL or non-finite entries or has another length than every
    centroid gets a NULL label and distance.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    fields = [vecs.schema[id_col], *[vecs.schema[c] for c in keep]]
    label = centroids.schema["cluster_label"].dataType
    state = T.StructType([*fields, T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField("cluster_label", label),
                          T.StructField("sqdist", T.DoubleType())])
    v = F.col(vec).cast("array<double>")
    out = vecs.select(id_col, *keep, F.when(complete(v), v).alias("_v"), F.lit(None).cast(label).alias("cluster_label"),
                      F.lit(None).cast("double").alias("sqdist"))

    def one_pass(labels, centers):
        groups = {}
        for k, c in enumerate(centers):
            groups.setdefault(len(c), []).append(k)

        def run(batches):
            import numpy as np
            import pyarrow.compute as pc
            for batch in batches:
                best, near = batch.column("cluster_label"), batch.column("sqdist")
                names = pa.array(labels, best.type)
                for dim, index in sorted(groups.items()):
                    at, x = _matrix(batch.column("_v"), dim)
                    if not len(at):
                        continue
                    pick, value = _nearest(x, np.array([centers[k] for k in index]))
                    new = np.full(batch.num_rows, np.inf)
                    new[at] = value
                    to = np.zeros(batch.num_rows, dtype=np.int64)
                    to[at] = np.array(index)[pick]
                    old = near.fill_null(np.inf).to_numpy(zero_copy_only=False)
                    won = new < old
                    for r in np.flatnonzero((new == old) & np.isfinite(new)):  # the same distance in an earlier block
                        won[r] = labels[to[r]] < best[int(r)].as_py()
                    best = pc.if_else(pa.array(won), names.take(pa.array(to)), best)
                    near = pc.if_else(pa.array(won), pa.array(new), near)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], best, near], names=batch.schema.names)
        return run

    ship_package(vecs.sparkSession)
    for labels, centers, _ in _center_blocks(centroids, "cluster_label", "center"):
        out = out.mapInArrow(one_pass(labels, centers), state)
    return out.select(id_col, *keep, "cluster_label", "sqdist")


def inertia(assigned: DataFrame) -> DataFrame:
    """M5 (own form): sum of squared distances to the assigned centroid, and row count."""
    return assigned.agg(F.sum("sqdist").alias("inertia"), F.count(F.lit(1)).alias("n"))


def silhouette(vecs: DataFrame, label: str = "cluster_label", vec: str = "embedding",
               id_col: str = "vec_id") -> DataFrame:
    """M4 (squared Euclidean, as Spark's ``ClusteringEvaluator``) in O(n * k) without pairs.

    For a point x and cluster C: mean ||x - y||^2 over y in C
    = ||x - mu_C||^2 + (mean_C ||y||^2 - ||mu_C||^2).  The own cluster excludes x
    itself (factor n_C / (n_C - 1)).  A singleton cluster, a point whose two means
    are both 0, and a labelling with one cluster score 0; rows with a NULL label or
    vector are left out.  Output one row ``(silhouette, n)``.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    x = vecs.select(F.col(label).alias("_l"), F.col(vec).cast("array<double>").alias("_v")).where(
        F.col("_l").isNotNull() & complete(F.col("_v")))
    norm = F.aggregate(F.transform("_v", lambda v: v * v), F.lit(0.0), lambda p, q: p + q)
    stats = x.groupBy("_l").agg(Summarizer.mean(array_to_vector("_v")).alias("_mu"), F.avg(norm).alias("_mnn"),
                                F.count(F.lit(1)).alias("_n"))
    mu = vector_to_array("_mu")
    spread_of = F.col("_mnn") - F.aggregate(F.transform(mu, lambda v: v * v), F.lit(0.0), lambda p, q: p + q)
    stats = stats.select(F.col("_l").alias("label"), mu.alias("mu"), spread_of.alias("var"), "_n").persist()
    state = T.StructType([x.schema["_l"], x.schema["_v"], T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    out = x.select("_l", "_v", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))

    def one_pass(labels, centers, more):
        def run(batches):
            import numpy as np
            import pyarrow.compute as pc
            cm = np.array(centers)
            size = (cm * cm).sum(axis=1)
            extra, counts = np.array([m[0] for m in more]), np.array([m[1] for m in more], dtype=float)
            number = {name: k for k, name in enumerate(labels)}
            for batch in batches:
                own, other = batch.column("a"), batch.column("b")
                at, xs = _matrix(batch.column("_v"), cm.shape[1])
                names = batch.column("_l").dictionary_encode()
                of = np.array([number.get(x, -1) for x in names.dictionary.to_pylist()] or [-1])
                mine = of[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)][at] if len(at) else at
                a, b = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.inf)
                here = np.zeros(batch.num_rows, dtype=bool)
                for s in blocks(xs, len(cm)):
                    d = squared(xs[s], cm, size) + extra[None, :]
                    rows = np.flatnonzero(mine[s] >= 0)
                    k = mine[s][rows]
                    a[at[s][rows]] = np.where(counts[k] > 1, d[rows, k] * counts[k] / np.maximum(counts[k] - 1, 1), np.nan)
                    here[at[s][rows]] = True
                    d[rows, k] = np.inf
                    b[at[s]] = d.min(axis=1)
                b = np.fmin(b, other.fill_null(np.inf).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pc.if_else(pa.array(here), pa.array(a), own),
                                                  pa.array(b, mask=~np.isfinite(b))], names=batch.schema.names)
        return run

    ship_package(vecs.sparkSession)
    try:
        for labels, centers, more in _center_blocks(stats, "label", "mu", ["var", "_n"]):
            out = out.mapInArrow(one_pass(labels, centers, more), state)
    finally:
        stats.unpersist()
    top = F.greatest("a", "b")
    s = F.when(F.isnan("a") | F.col("b").isNull() | (top <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return out.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def _center_table(spark, centers) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster_label int, center array<double>")


def kmeans_cluster(vecs: DataFrame, k: int = 50, seed: int = 42, id_col: str = "vec_id",
                   vec: str = "embedding", max_iter: int = MAX_ITER):
    """M2: k-means (``kmeans``).  Returns ``(assignments, centroids, cost)``.

    Assignments are the nearest-centroid labels (M3, narrow); a NULL or incomplete vector gets a NULL label.
    """
    fit = kmeans_sweep(vecs, [k], seed, vec, max_iter)
    cents = _center_table(vecs.sparkSession, fit.centers.get(k, []))
    return assign_nearest(vecs, cents, id_col, vec).select(id_col, "cluster_label"), cents, fit.cost.get(k, 0.0)


def elbow_curve(vecs: DataFrame, ks, seed: int = 42, id_col: str = "vec_id", vec: str = "embedding",
                max_iter: int = MAX_ITER) -> DataFrame:
    """M5: k-means cost (inertia) for each k; one scan per iteration serves every k."""
    fit = kmeans_sweep(vecs, ks, seed, vec, max_iter)
    return vecs.sparkSession.createDataFrame([(int(k), float(c)) for k, c in sorted(fit.cost.items())], "k int, inertia double")


def silhouette_sweep(vecs: DataFrame, ks, seed: int = 42, id_col: str = "vec_id",
                     vec: str = "embedding", max_iter: int = MAX_ITER) -> DataFrame:
    """M4: ``(k, silhouette, low, high)``: the mean Euclidean silhouette of the k-means labelling for each k, with bounds.

    ``silhouettes`` says how the bounds come about.  Fit and measure read the vectors once for all k, in every scan.
    """
    ship_package(vecs.sparkSession)
    rows = training_rows(vecs, vec).persist()
    scanned = packed(rows).persist()
    try:
        fit = lloyd(scanned, seeds(rows, ks, seed), max_iter)
        found = sweep_silhouettes(scanned, fit.centers)
    finally:
        scanned.unpersist()
        rows.unpersist()
    return vecs.sparkSession.createDataFrame([(int(k), float(mid), float(low), float(high)) for k, (low, mid, high) in sorted(found.items())],
                                             "k int, silhouette double, low double, high double")


def lloyd_steps(vecs: DataFrame, centroids: DataFrame, steps: int = 1, id_col: str = "vec_id",
                vec: str = "embedding") -> DataFrame:
    """M2 building block: centroids after ``steps`` Lloyd steps (assign, then mean) from given centroids."""
    for _ in range(steps):
        labelled = assign_nearest(vecs, centroids, id_col, vec, keep=(vec,)).where("cluster_label is not null")
        centroids = centroids_by_label(labelled, "cluster_label", vec)
    return centroids


def project_2d(vecs: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """M6, linear form: 2-D coordinates per row by PCA (``projection.project_neighbours`` keeps neighbourhoods).

    Vectors that are NULL, incomplete or of another than the usual length get NULL coordinates; no vectors, no rows fitted.
    """
    dim = usual_width(vecs, vec)
    v = F.col(vec).cast("array<double>")
    rows = vecs.select(id_col, F.when(complete(v, dim), v).alias("_v"))
    fitted = rows.where("_v is not null").select(id_col, array_to_vector("_v").alias("features"))
    none = F.lit(None).cast("double")
    if dim < 2 or fitted.isEmpty():
        return rows.select(id_col, none.alias("x"), none.alias("y"))
    model = PCA(k=2, inputCol="features", outputCol="_p").fit(fitted)
    p = vector_to_array(F.col("_p"))
    return model.transform(fitted).select(id_col, p[0].alias("x"), p[1].alias("y")).unionByName(
        rows.where("_v is null").select(id_col, none.alias("x"), none.alias("y")))


def attach_cluster_name(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Left join to the (k-row) cluster-name table."""
    return assigned.join(broadcast_if_small(names.select("cluster_label", "name")), "cluster_label", "left")


def cluster_sizes(named: DataFrame) -> DataFrame:
    """Rows per cluster name, unnamed rows excluded, sorted by name."""
    return (named.where(F.col("name").isNotNull()).groupBy("name")
            .agg(F.count(F.lit(1)).alias("size")).orderBy("name"))


def cluster_members(assigned: DataFrame, text: str = "headline", id_col: str = "doc_id",
                    limit: int | None = None) -> DataFrame:
    """Members of each cluster as a long table ordered by (label, text, id).

    The long form keeps any cluster size distributed (a global sort
    range-partitions on the composite key, splitting a hot cluster).  With
    ``limit`` the first ``limit`` members per cluster are kept.
    """
    cols = ["cluster_label", id_col, text]
    if limit is None:
        return assigned.select(*cols).orderBy("cluster_label", text, id_col)
    w = Window.partitionBy("cluster_label").orderBy(text, id_col)
    return (assigned.select(*cols).withColumn("member_rank", F.row_number().over(w))
            .where(F.col("member_rank") <= limit))


def cluster_keywords(assigned: DataFrame, text: str = "headline", k: int = 5,
                     first_seen_by: str | None = None) -> DataFrame:
    """A22 + W2: the ``k`` most frequent whitespace words per cluster, joined as a label.

    Ties are broken by the word itself, or - with ``first_seen_by`` (a column
    giving the order of the texts) - by first appearance, as a running
    counter over the texts in that order would.  Word counts use a partial
    aggregate, so a hot cluster costs one row per distinct word, and the
    ``rank <= k`` filter becomes a partial top-k before the shuffle.
    Output ``(cluster_label, top_words)``.
    """
    order = [F.col(first_seen_by)] if first_seen_by else []
    words = assigned.select("cluster_label", *order,
                            F.posexplode(F.split(F.trim(F.col(text)), r"\s+")).alias("_p", "word"))
    first = F.min(F.struct(*order, F.col("_p"))) if first_seen_by else F.lit(None)
    counts = words.where(F.length("word") > 0).groupBy("cluster_label", "word").agg(
        F.count(F.lit(1)).alias("n"), first.alias("_first"))
    tie = [F.asc("_first")] if first_seen_by else []
    w = Window.partitionBy("cluster_label").orderBy(F.desc("n"), *tie, F.asc("word"))
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy("cluster_label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]),
                     " ").alias("top_words"))


def join_scores_clusters(scores: DataFrame, assigned: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Inner equi-join of scores with cluster assignments."""
    return scores.join(assigned, list(keys), "inner")


def reassign_by_cluster(scores: DataFrame, named: DataFrame, cluster_topic: DataFrame,
                        id_col: str = "doc_id", keys=()) -> DataFrame:
    """Texts with no topic score get their ``whole`` score copied to each topic
    mapped from their cluster name (case-insensitive); other rows are untouched.

    ``cluster_topic(name, topics array<string>)``; returns the augmented scores.
    """
    from corpuspulse.operators.filters import no_topic_scored
    whole = scores.where(F.col("topic") == "whole").select(id_col, *keys, F.col("score").alias("_w"))
    unscored = no_topic_scored(whole, scores, id_col)
    mapping = cluster_topic.select(F.lower("name").alias("_name"), F.explode("topics").alias("topic"))
    target = (unscored.join(named.select(id_col, F.lower("name").alias("_name")), id_col)
              .join(broadcast_if_small(mapping), "_name")
              .select(id_col, *keys, "topic", F.col("_w").alias("score")))
    return scores.unionByName(target)
