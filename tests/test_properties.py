"""Properties (hypothesis) and ML fixtures checked against brute force."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuspulse.functions import scores as SC
from corpuspulse.operators import clusters as C
from corpuspulse.operators import reports as R
from corpuspulse.operators import voting as V

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

score_val = st.one_of(st.none(), st.sampled_from([-1.0, -0.5, 0.0, 0.25, 1.0]))
rows = st.lists(st.tuples(st.sampled_from(["p1", "p2", "p3"]), st.sampled_from(["a", "b"]), score_val),
                min_size=1, max_size=30)


@settings(**SETTINGS)
@given(rows)
def test_voting_matches_rowwise_and_shares_sum(spark, data):
    scores = spark.createDataFrame(data, "paper string, topic string, score double")
    parties = spark.createDataFrame([("A", "a", 1.0), ("A", "b", -1.0), ("B", "a", -0.5), ("C", "b", 0.0)],
                                    "party string, topic string, score double")
    agg = {(r.party, r.topic): r.votes for r in V.match_votes(scores, parties).collect()}
    row = {(r.party, r.topic): r.votes for r in V.match_votes_rowwise(scores, parties).collect()}
    assert agg == row
    pred = V.voting_prediction(scores, parties, places=None).collect()
    total = sum(r.total_votes for r in pred)
    if total:
        assert math.isclose(sum(r.pct for r in pred), 100.0)
    else:
        assert all(r.pct is None for r in pred)
    again = V.voting_prediction(scores.repartition(5), parties, places=None).collect()
    assert sorted(map(tuple, pred)) == sorted(map(tuple, again))


@settings(**SETTINGS)
@given(st.lists(st.tuples(score_val, score_val), min_size=1, max_size=20))
def test_sign_agree_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    r = df.select(SC.sign_agree("a", "b").alias("x"), SC.sign_agree("b", "a").alias("y")).collect()
    assert all(x.x == x.y for x in r)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["h1", "h2", "h3"]), st.sampled_from(["p1", "p2"]),
                          st.sampled_from(["2023-01-01", "2023-01-02", None])), min_size=1, max_size=25))
def test_dedup_idempotent_and_salted_equal(spark, data):
    df = spark.createDataFrame(data, "headline string, paper string, date_raw string")
    once = R.dedup_first(df)
    assert sorted(map(tuple, R.dedup_first(once).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, R.dedup_first_salted(df, salt_buckets=3).collect())) == sorted(map(tuple, once.collect()))
    assert once.count() == len({h for h, _, _ in data})


def test_wide_long_wide_identity(spark):
    long = spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (2, "a", -1.0), (2, "b", 0.25)],
                                 "id int, topic string, score double")
    wide = R.widen(long, ["id"], ["a", "b"])
    back = R.melt(wide, ["id"]).select("id", "topic", "score")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, long.collect()), key=str)
    assert sorted(map(tuple, R.widen(back, ["id"], ["a", "b"]).collect())) == sorted(map(tuple, wide.collect()))


def test_share_rounding_sums(spark):
    df = spark.createDataFrame([(1,), (1,), (1,)], "x long")
    r = [x.s for x in df.select(SC.share_pct("x").alias("s")).collect()]
    assert r == [33.33, 33.33, 33.33]


# ---------------------------------------------------------------- ML fixtures (rows-only queries)

def _blobs(spark):
    pts = []
    for label, (cx, cy) in enumerate([(0.0, 0.0), (20.0, 0.0), (0.0, 20.0)]):
        for i in range(10):
            pts.append((label * 100 + i, [cx + (i % 3) * 0.1, cy + (i // 3) * 0.1], label))
    return spark.createDataFrame(pts, "vec_id int, embedding array<float>, label int")


def test_kmeans_recovers_blobs(spark):
    vecs = _blobs(spark)
    assigned, cents, cost = C.kmeans_cluster(vecs, k=3, seed=42)
    j = assigned.join(vecs, "vec_id").groupBy("label").agg(F.countDistinct("cluster_label").alias("n"))
    assert all(r.n == 1 for r in j.collect())
    assert cost < 1.0
    # M3 with the fitted centroids reproduces the model's labels
    near = C.assign_nearest(vecs, cents)
    assert near.join(assigned, ["vec_id", "cluster_label"]).count() == 30


def test_elbow_decreasing_and_silhouette_high(spark):
    vecs = _blobs(spark)
    costs = [r.inertia for r in C.elbow_curve(vecs, [2, 3, 4]).orderBy("k").collect()]
    assert costs[0] > costs[1] >= costs[2]
    sil = {r.k: r.silhouette for r in C.silhouette_sweep(vecs, [2, 3]).collect()}
    assert sil[3] > 0.9 and sil[3] > sil[2]


def test_pca_and_embedding(spark):
    vecs = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], "vec_id int, embedding array<float>")
    p = C.project_2d(vecs).orderBy("vec_id").collect()
    xs = [r.x for r in p]
    assert all(abs(r.y) < 1e-6 for r in p)   # points on a line: one component carries everything
    assert abs(abs(xs[-1] - xs[0]) - math.sqrt(5) * 5) < 1e-4
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d")], "doc_id int, text string")
    emb = C.embed_text(docs, dim=16).collect()
    assert all(len(r.embedding) == 16 for r in emb)
    assert all(abs(math.sqrt(sum(x * x for x in r.embedding)) - 1.0) < 1e-5 for r in emb)


# ---------------------------------------------------------------- S1 o S6 round trip, M3 optimality

_text = st.text(alphabet=st.sampled_from(list("abcXYZ äß-\"'.,:0123")), min_size=1, max_size=25)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.sampled_from(["p1", "p2"]), st.sampled_from(["2023-09-07", "-", "07. Oktober 2023"]),
                          _text), min_size=1, max_size=12))
def test_write_read_headlines_roundtrip(spark, tmp_root, data):
    import uuid
    from corpuspulse.sources import headlines as H
    rows = [(p, d, h.strip()) for p, d, h in data if h.strip()]
    if not rows:
        return
    src = spark.createDataFrame(rows, "paper string, date_raw string, headline string")
    path = f"{tmp_root}/rt-{uuid.uuid4().hex}"
    H.write_headlines(src, path, paper_col="paper")
    back = H.read_written_headlines(spark, path).select("paper", "date_raw", "headline")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.floats(-5, 5, width=32), st.floats(-5, 5, width=32)), min_size=1, max_size=15))
def test_assign_nearest_is_optimal(spark, pts):
    vecs = spark.createDataFrame([(i, [x, y]) for i, (x, y) in enumerate(pts)], "vec_id int, embedding array<float>")
    cents = [(0, [0.0, 0.0]), (1, [2.0, 2.0]), (2, [-3.0, 1.0])]
    cdf = spark.createDataFrame(cents, "cluster_label int, center array<double>")
    for r in C.assign_nearest(vecs, cdf).collect():
        x = pts[r.vec_id]
        d = {lab: sum((float(a) - b) ** 2 for a, b in zip(x, c)) for lab, c in cents}
        assert d[r.cluster_label] <= min(d.values()) + 1e-9


@settings(**SETTINGS)
@given(rows)
def test_pos_plus_neg_within_nonnull(spark, data):
    scores = spark.createDataFrame(data, "paper string, topic string, score double")
    pos = {(r.paper, r.topic): r.value for r in R.paper_topic_report(scores, "count_pos").collect()}
    neg = {(r.paper, r.topic): r.value for r in R.paper_topic_report(scores, "count_neg").collect()}
    nn = {(r.paper, r.topic): r.n for r in scores.groupBy("paper", "topic").agg(F.count("score").alias("n")).collect()}
    for key, n in nn.items():
        assert pos[key] + neg[key] <= n
