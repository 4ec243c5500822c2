"""Registered queries: vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.functions import text as T
from corpuspulse.operators import clusters as C
from corpuspulse.operators import content_join as CJ
from corpuspulse.operators import kmeans as KM
from corpuspulse.operators import scoring as SC
from corpuspulse.operators import silhouettes as SI
from corpuspulse.operators import topics as TP
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import HEADS, OBS, register, with_
from corpuspulse.plans.text_queries import _CLEAN_KW
from corpuspulse.sources.tables import driver_table

CENT = """cent AS (
  SELECT label AS cluster_label, list(m ORDER BY i) AS center FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
    FROM (SELECT label, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings) e
    GROUP BY label, i) t
  GROUP BY label)"""

DIST = """dist AS (
  SELECT v.vec_id, c.cluster_label,
         list_sum(list_transform(generate_series(1, len(v.embedding)),
           lambda i: (CAST(v.embedding[i] AS DOUBLE) - c.center[i]) * (CAST(v.embedding[i] AS DOUBLE) - c.center[i]))) AS d
  FROM embeddings v, cent c),
best AS (
  SELECT vec_id, cluster_label, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_label) AS rn FROM dist) t WHERE rn = 1)"""

# Fixed parameter tables: names for the given labels (label 9 unnamed) and name -> topics.
NAMES = [(i, f"c{i}") for i in range(9)]
CLUSTER_TOPIC = [("c0", ["conj", "article"]), ("C1", ["pron"]), ("c2", ["conj"]), ("c3", ["article", "pron"])]

NAMES_SQL = "names AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in NAMES) + \
    ") AS t(cluster_label, name))"
CT_SQL = "ct AS (SELECT lower(name) AS name, unnest(topics) AS topic FROM (VALUES " + ", ".join(
    f"('{n}', [{', '.join(repr(t) for t in ts)}])" for n, ts in CLUSTER_TOPIC) + ") AS t(name, topics))"
ASSIGNED_SQL = """assigned AS (
  SELECT h.doc_id, h.paper, h.headline, e.label AS cluster_label FROM heads h JOIN embeddings e ON e.vec_id = h.doc_id)"""


def _vecs(spark, sf):
    return driver_table(spark, sf, "embeddings")


def _centroids(spark, sf):
    return C.centroids_by_label(_vecs(spark, sf))


def _names(spark):
    return spark.createDataFrame(NAMES, "cluster_label int, name string")


def _assigned(spark, sf):
    """Headlines with the cluster label of their embedding row."""
    e = _vecs(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_label"))
    return S.heads(spark, sf).select("doc_id", "paper", "headline").join(e, "doc_id")


@register("assign_nearest", with_(CENT, DIST) + "SELECT vec_id, cluster_label, round(d, 6) AS sqdist FROM best")
def q_assign_nearest(spark, sf):
    """M3: nearest of the per-label mean centroids (centroids embedded in the plan)."""
    r = C.assign_nearest(_vecs(spark, sf), _centroids(spark, sf))
    return r.select("vec_id", "cluster_label", F.round("sqdist", 6).alias("sqdist"))


@register("inertia", with_(CENT, DIST) + "SELECT round(sum(d), 4) AS inertia, CAST(count(*) AS BIGINT) AS n FROM best")
def q_inertia(spark, sf):
    """M5 own form: sum of squared distances to the nearest centroid."""
    r = C.inertia(C.assign_nearest(_vecs(spark, sf), _centroids(spark, sf)))
    return r.select(F.round("inertia", 4).alias("inertia"), "n")


@register("silhouette", with_(CENT) + """,
pd AS (
  SELECT v.vec_id, v.label AS own, c.cluster_label AS other,
         list_sum(list_transform(generate_series(1, len(v.embedding)),
           lambda i: (CAST(v.embedding[i] AS DOUBLE) - c.center[i]) * (CAST(v.embedding[i] AS DOUBLE) - c.center[i]))) AS dc,
         list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nn
  FROM embeddings v, cent c),
st AS (SELECT label, count(*) AS n,
              avg(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS mnn
       FROM embeddings GROUP BY label),
md AS (
  -- mean squared distance to all members of a cluster = ||x - mu||^2 + (mean ||y||^2 - ||mu||^2)
  SELECT p.vec_id, p.own, p.other, s.n,
         p.dc + s.mnn - list_sum(list_transform(c.center, lambda m: m * m)) AS d
  FROM pd p JOIN st s ON s.label = p.other JOIN cent c ON c.cluster_label = p.other),
pts AS (
  SELECT vec_id,
         max(CASE WHEN other = own THEN d * n / (n - 1) END) AS a,
         min(CASE WHEN other <> own THEN d END) AS b,
         max(CASE WHEN other = own THEN n END) AS own_n
  FROM md GROUP BY vec_id)
SELECT round(avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       CAST(count(*) AS BIGINT) AS n FROM pts""")
def q_silhouette(spark, sf):
    """M4 own form: squared-Euclidean silhouette of the given labelling, O(n * k)."""
    v = _vecs(spark, sf).withColumnRenamed("label", "cluster_label")
    r = C.silhouette(v)
    return r.select(F.round("silhouette", 6).alias("silhouette"), "n")


@register("kmeans_cluster")
def q_kmeans_cluster(spark, sf):
    """M2: k-means (k=50, seed 42) labels per vector."""
    assigned, _, _ = C.kmeans_cluster(_vecs(spark, sf), k=50, seed=42)
    return assigned


@register("elbow_curve")
def q_elbow_curve(spark, sf):
    """M5: k-means cost for k = 10, 20, ..., 100."""
    return C.elbow_curve(_vecs(spark, sf), range(10, 101, 10))


@register("silhouette_sweep")
def q_silhouette_sweep(spark, sf):
    """M4: Euclidean silhouette, with bounds, of k-means labellings for k = 10..59."""
    return C.silhouette_sweep(_vecs(spark, sf), range(10, 60))


@register("lloyd_step", with_(CENT, DIST) + """
SELECT b.cluster_label, CAST(i AS INT) AS dim, round(avg(CAST(v.embedding[i] AS DOUBLE)), 6) AS value
FROM best b JOIN embeddings v USING (vec_id), range(1, 65) AS r(i) GROUP BY 1, 2""")
def q_lloyd_step(spark, sf):
    """M2: one Lloyd step of k-means from given centroids, as (cluster, dimension, value) rows."""
    c = C.lloyd_steps(_vecs(spark, sf), _centroids(spark, sf))
    return c.select("cluster_label", F.posexplode("center").alias("p", "v")).select(
        "cluster_label", (F.col("p") + 1).alias("dim"), F.round("v", 6).alias("value"))


STEP_KS, STEPS = tuple(range(10, 101, 10)), 3


@register("lloyd_sweep", f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings),
ks AS (SELECT unnest({list(STEP_KS)}) AS k),
run AS (
  SELECT 0 AS step, k, r AS c, v AS centre FROM ks JOIN v ON r < k
  UNION ALL
  SELECT step + 1, k, c, CAST(list(m ORDER BY i) AS DOUBLE[64]) FROM (
    SELECT step, k, c, i, avg(v[i]) AS m FROM (
      SELECT run.step, run.k, arg_min(run.c, array_distance(v.v, run.centre)) AS c, any_value(v.v) AS v
      FROM run, v WHERE run.step < {STEPS} GROUP BY run.step, run.k, v.vec_id) AS near, range(1, 65) AS d(i)
    GROUP BY step, k, c, i) AS mean GROUP BY step, k, c),
last AS (
  SELECT run.k, v.vec_id, arg_min(run.c, array_distance(v.v, run.centre)) AS c, min(array_distance(v.v, run.centre)) AS d
  FROM run, v WHERE run.step = {STEPS} GROUP BY run.k, v.vec_id),
size AS (SELECT k, c, count(*) AS n, sum(d * d) AS s FROM last GROUP BY k, c)
SELECT CAST(k AS INT) AS k, round(sum(s), 4) AS inertia, max(n) AS largest, min(n) AS smallest, count(*) AS clusters FROM size GROUP BY k""")
def q_lloyd_sweep(spark, sf):
    """M2/M5: three Lloyd steps for every k of the elbow curve in shared scans, started at the first k vectors."""
    import numpy as np
    v = _vecs(spark, sf)
    first = np.array([r["embedding"] for r in v.orderBy("vec_id").limit(max(STEP_KS)).collect()], dtype=float)
    out = KM.lloyd(KM.training_rows(v).persist(), {k: first[:k] for k in STEP_KS}, STEPS, tol=-1.0)
    rows = [(k, round(out.cost[k], 4), int(n.max()), int(n[n > 0].min()), int((n > 0).sum())) for k, n in out.sizes.items()]
    return spark.createDataFrame(rows, "k int, inertia double, largest long, smallest long, clusters long")


@register("silhouette_euclidean", """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
z AS (SELECT a.vec_id, a.label AS own, b.label AS other, array_distance(a.v, b.v) ** 2 AS z FROM v a JOIN v b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, own, other, avg(z) AS m, greatest(avg(z * z) - avg(z) ** 2, 0) AS s2 FROM z GROUP BY 1, 2, 3),
d AS (SELECT vec_id, own, other, sqrt(m) * greatest(1 - s2 / (2 * m * m), 0) AS lo, sqrt(m) * (1 - least(s2 / (m * m), 4) / 8) AS mid, sqrt(m) AS hi FROM m),
p AS (
  SELECT vec_id, max(lo) FILTER (WHERE own = other) AS al, max(mid) FILTER (WHERE own = other) AS am, max(hi) FILTER (WHERE own = other) AS ah,
         min(lo) FILTER (WHERE own <> other) AS bl, min(mid) FILTER (WHERE own <> other) AS bm, min(hi) FILTER (WHERE own <> other) AS bh
  FROM d GROUP BY vec_id)
SELECT vec_id, round(coalesce((bl - ah) / greatest(bl, ah), 0), 6) + 0.0 AS low, round(coalesce((bm - am) / greatest(bm, am), 0), 6) + 0.0 AS silhouette,
       round(coalesce((bh - al) / greatest(bh, al), 0), 6) + 0.0 AS high FROM p""")
def q_silhouette_euclidean(spark, sf):
    """M4: every vector's Euclidean silhouette under the given labels: guaranteed bounds and the estimate."""
    out = SI.silhouette_points(_vecs(spark, sf), "label")
    return out.select("vec_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("low", "silhouette", "high")])


def _by_k(ks):
    """Labellings ``vec_id % k`` for each k, with their own centres (SQL side of the sweeps)."""
    return f"""ks AS (SELECT unnest({list(ks)}) AS k),
lab AS (SELECT k, vec_id, vec_id % k AS l, embedding FROM embeddings, ks),
mu AS (SELECT k, l, list(m ORDER BY i) AS c, any_value(n) AS n FROM (
         SELECT k, l, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS n
         FROM (SELECT k, l, embedding, generate_subscripts(embedding, 1) AS i FROM lab) e GROUP BY k, l, i) t GROUP BY k, l)"""


_SQ = "list_sum(list_transform(generate_series(1, len({a})), lambda i: (CAST({a}[i] AS DOUBLE) - {b}[i]) * (CAST({a}[i] AS DOUBLE) - {b}[i])))"


@register("inertia_by_k", with_(_by_k(range(10, 101, 10))) + f"""
SELECT CAST(lab.k AS INT) AS k, round(sum({_SQ.format(a='embedding', b='c')}), 4) AS inertia
FROM lab JOIN mu ON mu.k = lab.k AND mu.l = lab.l GROUP BY lab.k""")
def q_inertia_by_k(spark, sf):
    """M5: inertia of a given labelling for every k of the elbow curve."""
    out = None
    for k in range(10, 101, 10):
        v = _vecs(spark, sf).withColumn("l", F.col("vec_id") % k)
        j = v.join(C.centroids_by_label(v, "l"), F.col("l") == F.col("cluster_label"))
        d = F.aggregate(F.zip_with("embedding", "center", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                        F.lit(0.0), lambda p, q: p + q)
        r = j.agg(F.lit(k).alias("k"), F.round(F.sum(d), 4).alias("inertia"))
        out = r if out is None else out.unionByName(r)
    return out


SWEEP = (10, 20, 35, 59)


@register("silhouette_by_k", with_(_by_k(SWEEP)) + f""",
var AS (SELECT lab.k, lab.l, any_value(mu.c) AS c, any_value(mu.n) AS n, avg({_SQ.format(a='embedding', b='mu.c')}) AS v
        FROM lab JOIN mu ON mu.k = lab.k AND mu.l = lab.l GROUP BY lab.k, lab.l),
d AS (SELECT lab.k, lab.vec_id, lab.l AS own, var.l AS other, var.n, {_SQ.format(a='lab.embedding', b='var.c')} + var.v AS d
      FROM lab JOIN var ON var.k = lab.k),
p AS (SELECT k, vec_id, max(CASE WHEN other = own THEN d * n / (n - 1) END) AS a, min(CASE WHEN other <> own THEN d END) AS b
      FROM d GROUP BY k, vec_id)
SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM p GROUP BY k""")
def q_silhouette_by_k(spark, sf):
    """M4: silhouette of a given labelling for several k of the sweep."""
    out = None
    for k in SWEEP:
        v = _vecs(spark, sf).withColumn("cluster_label", F.col("vec_id") % k)
        r = C.silhouette(v).select(F.lit(k).alias("k"), F.round("silhouette", 6).alias("silhouette"))
        out = r if out is None else out.unionByName(r)
    return out


@register("project_2d")
def q_project_2d(spark, sf):
    """M6: PCA projection to two coordinates."""
    return C.project_2d(_vecs(spark, sf))


@register("embed_text")
def q_embed_text(spark, sf):
    """M1: baseline hashed TF-IDF encoder over the documents (64 dims)."""
    d = S.text_table(spark, sf, "documents").select("doc_id", "text")
    return C.embed_text(d, "text", 64)


def _length_model():
    def run(pdf):
        import pandas as pd
        h = pdf["headline"].fillna("")
        return pd.DataFrame({"n_chars": h.str.len().astype("int64"),
                             "n_words": h.str.split().str.len().fillna(0).astype("int64")})
    return run


@register("batch_infer", with_(HEADS) + """
SELECT doc_id, headline, CAST(length(headline) AS BIGINT) AS n_chars,
       CAST(len(list_filter(regexp_split_to_array(trim(headline), '\\s+'), lambda t: length(t) > 0)) AS BIGINT) AS n_words
FROM heads""")
def q_batch_infer(spark, sf):
    """M8: a caller's batch model (here a deterministic length model) over Arrow batches."""
    h = S.heads(spark, sf).select("doc_id", "headline")
    return SC.batch_infer(h, ["headline"], _length_model, "n_chars bigint, n_words bigint")


@register("attach_cluster_name", with_(NAMES_SQL) + """
SELECT e.vec_id, e.label AS cluster_label, n.name FROM embeddings e LEFT JOIN names n ON n.cluster_label = e.label""")
def q_attach_cluster_name(spark, sf):
    """Left join of assignments to the cluster-name table."""
    a = _vecs(spark, sf).select("vec_id", F.col("label").alias("cluster_label"))
    return C.attach_cluster_name(a, _names(spark)).select("vec_id", "cluster_label", "name")


@register("cluster_sizes", with_(NAMES_SQL) + """
SELECT n.name, CAST(count(*) AS BIGINT) AS size FROM embeddings e JOIN names n ON n.cluster_label = e.label
GROUP BY n.name ORDER BY n.name""")
def q_cluster_sizes(spark, sf):
    """Rows per cluster name (unnamed excluded)."""
    a = _vecs(spark, sf).select("vec_id", F.col("label").alias("cluster_label"))
    return C.cluster_sizes(C.attach_cluster_name(a, _names(spark)))


@register("cluster_members", with_(HEADS, ASSIGNED_SQL) + """
SELECT cluster_label, doc_id, headline FROM assigned ORDER BY cluster_label, headline, doc_id""")
def q_cluster_members(spark, sf):
    """Cluster members as a long, ordered table."""
    return C.cluster_members(_assigned(spark, sf))


@register("cluster_keywords", with_(HEADS, ASSIGNED_SQL) + """,
words AS (SELECT cluster_label, unnest(regexp_split_to_array(trim(headline), '\\s+')) AS word FROM assigned),
counts AS (SELECT cluster_label, word, count(*) AS n FROM words WHERE length(word) > 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY n DESC, word) AS rk FROM counts)
SELECT cluster_label, string_agg(word, ' ' ORDER BY rk) AS top_words FROM ranked WHERE rk <= 5 GROUP BY cluster_label""")
def q_cluster_keywords(spark, sf):
    """A22 + W2: five most frequent words per cluster."""
    return C.cluster_keywords(_assigned(spark, sf))


@register("join_scores_clusters", with_(OBS) + """
SELECT o.obs_id, o.paper, o.topic, o.score, e.label AS cluster_label
FROM obs o JOIN embeddings e ON e.vec_id = o.obs_id""")
def q_join_scores_clusters(spark, sf):
    """Inner equi-join of scores and cluster assignments on the text id."""
    a = _vecs(spark, sf).select(F.col("vec_id").alias("obs_id"), F.col("label").alias("cluster_label"))
    s = S.obs(spark, sf).select("obs_id", "paper", "topic", "score")
    return C.join_scores_clusters(s, a, ["obs_id"])


@register("join_on_content", with_(HEADS) + """
SELECT h.doc_id, h.paper, d.doc_id AS other_id, d.lang AS other_lang FROM heads h JOIN heads d ON d.headline = h.headline AND d.paper = h.paper""")
def q_join_on_content(spark, sf):
    """J1 on texts: headlines and papers joined by their content through kept, bucketed tables."""
    h = S.heads(spark, sf)
    on = ["headline", "paper"]
    left = CJ.keep_bucketed(h.select("doc_id", *on), on, buckets=8)
    right = CJ.keep_bucketed(h.select(F.col("doc_id").alias("other_id"), F.col("lang").alias("other_lang"), *on), on, buckets=8)
    return CJ.join_on_content(left, right, on).select("doc_id", "paper", "other_id", "other_lang")


def _stand_scores(spark, sf):
    """Topic rows from the keyword match (score 0.5) plus a ``whole`` row per headline."""
    texts = S.heads(spark, sf).select("doc_id", T.clean_en("headline").alias("text"))
    hits = TP.match_topics(texts, TP.prepare_keywords(S.kw(spark)), "doc_id", "text")
    whole = texts.select("doc_id", F.lit("whole").alias("topic"),
                         ((F.col("doc_id") % 11) / 10.0 - 0.5).alias("score"))
    return hits.select("doc_id", "topic", F.lit(0.5).alias("score")).unionByName(whole)


@register("reassign_by_cluster", _CLEAN_KW + f""",
{NAMES_SQL}, {CT_SQL},
sc AS (SELECT doc_id, topic, 0.5 AS score FROM hits
       UNION ALL SELECT doc_id, 'whole' AS topic, (doc_id % 11) / 10.0 - 0.5 AS score FROM th),
un AS (SELECT doc_id, score FROM sc WHERE topic = 'whole'
       AND doc_id NOT IN (SELECT doc_id FROM sc WHERE topic <> 'whole' AND score IS NOT NULL)),
nm AS (SELECT e.vec_id AS doc_id, lower(n.name) AS name FROM embeddings e JOIN names n ON n.cluster_label = e.label)
SELECT doc_id, topic, round(score, 6) AS score FROM sc
UNION ALL
SELECT u.doc_id, ct.topic, round(u.score, 6) AS score FROM un u JOIN nm ON nm.doc_id = u.doc_id JOIN ct ON ct.name = nm.name""")
def q_reassign_by_cluster(spark, sf):
    """J5 (+F6): unscored headlines inherit ``whole`` on the topics mapped from their cluster name."""
    scores = _stand_scores(spark, sf)
    a = _vecs(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_label"))
    named = C.attach_cluster_name(a, _names(spark)).where(F.col("name").isNotNull())
    ct = spark.createDataFrame(CLUSTER_TOPIC, "name string, topics array<string>")
    r = C.reassign_by_cluster(scores, named, ct)
    return r.select("doc_id", "topic", F.round("score", 6).alias("score"))


@register("cluster_members_top", with_(HEADS, ASSIGNED_SQL) + """
SELECT cluster_label, doc_id, headline, CAST(member_rank AS INT) AS member_rank FROM (
  SELECT cluster_label, doc_id, headline,
         row_number() OVER (PARTITION BY cluster_label ORDER BY headline, doc_id) AS member_rank
  FROM assigned) t WHERE member_rank <= 3""")
def q_cluster_members_top(spark, sf):
    """A21 with a per-cluster limit (the limit is the feature: a preview of each cluster)."""
    return C.cluster_members(_assigned(spark, sf), limit=3)


NB_TOPICS = ["article", "conj", "pron", "whole"]
NB_ALIAS = [("article", "articles"), ("conj", "conjunctions")]


@register("analysis_pipeline", _CLEAN_KW + f""",
{NAMES_SQL}, {CT_SQL},
hd AS (SELECT doc_id, paper, headline, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date FROM (
         SELECT *, row_number() OVER (PARTITION BY headline ORDER BY paper, doc_id) AS rn FROM heads) t WHERE rn = 1),
sc AS (SELECT h.headline, h.paper, h.date,
              CASE x.topic WHEN 'article' THEN 'articles' WHEN 'conj' THEN 'conjunctions' ELSE x.topic END AS topic,
              (h.doc_id % 7 - 3) / 4.0 AS score
       FROM hd h JOIN hits x USING (doc_id)
       UNION ALL SELECT headline, paper, date, 'whole' AS topic, (doc_id % 11) / 10.0 - 0.5 AS score FROM hd),
cl AS (SELECT h.headline, h.paper, h.date, e.label AS cluster_label FROM hd h JOIN embeddings e ON e.vec_id = h.doc_id),
jn AS (SELECT sc.*, cl.cluster_label FROM sc JOIN cl USING (date, headline, paper)),
un AS (SELECT * FROM jn WHERE topic = 'whole' AND headline NOT IN (SELECT headline FROM jn WHERE topic <> 'whole')),
al AS (SELECT paper, topic, score FROM jn
       UNION ALL SELECT un.paper, ct.topic, un.score FROM un JOIN names ON names.cluster_label = un.cluster_label
                 JOIN ct ON ct.name = lower(names.name)),
base AS (SELECT paper, topic, avg(score) AS value FROM al GROUP BY 1, 2),
grid AS (SELECT p.paper, t.topic, b.value FROM (SELECT DISTINCT paper FROM base) p CROSS JOIN (SELECT DISTINCT topic FROM base) t
         LEFT JOIN base b ON b.paper = p.paper AND b.topic = t.topic),
rows_ AS (SELECT * FROM grid UNION ALL SELECT 'total', topic, avg(value) FROM grid GROUP BY topic)
SELECT paper, topic, round(value, 6) + 0.0 AS value FROM rows_
UNION ALL SELECT paper, 'total (topic only)', round(avg(value) FILTER (WHERE topic <> 'whole'), 6) + 0.0 FROM rows_ GROUP BY paper""")
def q_analysis_pipeline(spark, sf):
    """The analysis as one job: wide score CSV -> P13 -> P10 -> J1 on (date, headline, paper) -> J5 -> A9."""
    import uuid

    from corpuspulse.operators import reports as R
    from corpuspulse.session import scratch_table_path
    from corpuspulse.sources.tables import read_table, write_table
    run = uuid.uuid4().hex
    # Texts are shuffled once, to meet their scores on the way to the CSV; everywhere else a digest stands for them.
    heads = S.heads(spark, sf, parts=False).select("doc_id", "paper", "headline", CJ.text_digest("headline").alias("text_key"))
    first = R.dedup_first(heads.drop("headline"), "text_key", ("paper", "doc_id"))
    write_table(first.withColumn("date", F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))),
                path := scratch_table_path(spark, f"first-{run}"))
    h = read_table(spark, path)
    texts = heads.groupBy("text_key").agg(F.first("headline").alias("headline"))
    hits = TP.match_topics(texts.select("text_key", T.clean_en("headline").alias("text")), TP.prepare_keywords(S.kw(spark)), "text_key", "text")
    hits = h.select("doc_id", "text_key").join(hits.select("text_key", "topic"), "text_key").select("doc_id", "topic").distinct()
    topic = h.join(hits, "doc_id").withColumn("score", (F.col("doc_id") % 7 - 3) / 4.0)
    whole = h.withColumn("topic", F.lit("whole")).withColumn("score", (F.col("doc_id") % 11) / 10.0 - 0.5)
    wide = R.widen(topic.unionByName(whole), ["date", "text_key", "paper"], NB_TOPICS)
    wide = wide.join(texts, "text_key").select("date", "headline", "paper", *[c for c in wide.columns if c.startswith("sentiment_")])
    path = scratch_table_path(spark, f"wide-{run}")
    write_table(wide, path, fmt="csv", compression="gzip")
    wide = read_table(spark, path, fmt="csv", schema=", ".join(f"`{c}` {t}" for c, t in wide.dtypes))
    # From here on a text is a key only, and a NULL one meets nothing.
    key, known = ["date", "text_key", "paper"], F.when(F.length("text_key") > 0, F.col("text_key"))
    wide = wide.withColumn("text_key", CJ.text_digest("headline")).drop("headline").withColumn("text_key", known)
    scores = R.canonical_topics(R.melt(wide, key).where("score is not null"), spark.createDataFrame(NB_ALIAS, "raw string, topic string"))
    e = _vecs(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_label"))
    clusters = h.withColumn("text_key", known).join(e, "doc_id").select(*key, "cluster_label")
    joined = C.join_scores_clusters(scores, clusters, key)
    named = C.attach_cluster_name(clusters, _names(spark)).where("name is not null").select("text_key", "name")
    ct = spark.createDataFrame(CLUSTER_TOPIC, "name string, topics array<string>")
    full = C.reassign_by_cluster(joined.select("text_key", "paper", "topic", "score"), named, ct, "text_key", ("paper",))
    return R.paper_topic_report(full, "avg").select("paper", "topic", (F.round("value", 6) + 0.0).alias("value"))
