"""The trained target classifier: features and scoring by a plain version, learning on texts with a known rule."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpuspulse.operators import target_model as M
from corpuspulse.plans import target_queries as Q

SCHEMA = "doc_id long, topic string, left string, target string, right string, label string"


def columns_of(left, target, right, buckets=M.BUCKETS):
    near = (left or "").lower().split()[-M.REACH:][::-1], (right or "").lower().split()[:M.REACH]
    names = [f"{side}{min(i, 3)}:{w}" for side, ws in zip("lr", near) for i, w in enumerate(ws)]
    names += [f"c:{w}" for ws in near for w in ws] + [f"t:{w}" for w in (target or "").lower().split()]
    return sorted({int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % buckets for s in names})


def rule_rows(n=1500, seed=2, noise=0.1):
    """The word just before the target decides, but for some noise; the same words elsewhere mean nothing."""
    rng = random.Random(seed)
    tone = {"good": "positive", "bad": "negative", "grey": "neutral"}
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        key = rng.choice(list(tone))
        label = tone[key] if rng.random() > noise else rng.choice(list(tone.values()))
        left = " ".join([rng.choice(words + list(tone)) for _ in range(rng.randint(0, 9))] + [key])
        out.append((i, "t", left, rng.choice(["party", "the party"]), " ".join(rng.choice(words + list(tone)) for _ in range(rng.randint(0, 9))), label))
    return out


def test_features_and_scores_by_a_plain_version(spark):
    rows = rule_rows(60) + [(None, "t", None, None, None, None), (901, "t", "", "", "", "x"), (902, "t", "Ä ä  É", "Zwei  Wörter", "a " * 500, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = Q._given()
    found = {str(r.doc_id): r.f for r in df.select("doc_id", M.features(F.col("left"), F.col("target"), F.col("right")).alias("f")).collect()}
    scored = {str(r.doc_id): r for r in M.score_targets(df, model).collect()}
    for i, _t, left, target, right, _l in rows:
        cols = columns_of(left, target, right)
        assert found[str(i)] == cols
        z = (model.weights[:, cols].sum(axis=1) + model.weights[:, -1]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        r = scored[str(i)]
        assert r.label == M.LABELS[int(p.argmax())] and abs(r.prob - p.max()) < 1e-9
        assert abs(r.score - {"negative": -1, "neutral": 0, "positive": 1}[r.label] * p.max()) < 1e-9


def test_the_model_learns_the_rule_and_is_calibrated(spark):
    df = spark.createDataFrame(rule_rows(), SCHEMA)
    model = M.fit_targets(df)
    q = M.target_quality(df, model).first()
    assert q.n > 200 and q.accuracy > 0.85 and q.majority < 0.45 and abs(q.calibration) < 0.08 and q.log_loss < 0.7
    sure = M.TargetModel(model.weights, model.temperature / 4)
    assert M.target_quality(df, sure).first().log_loss > q.log_loss
    assert math.isclose(M.fit_targets(df).temperature, model.temperature)


def test_awkward_labels(spark):
    rows = rule_rows(80)
    unlabelled = spark.createDataFrame([(*r[:5], None) for r in rows], SCHEMA)
    assert not M.fit_targets(unlabelled).weights.any()
    assert not M.fit_targets(unlabelled.limit(0)).weights.any()
    one = spark.createDataFrame([(*r[:5], "positive") for r in rows], SCHEMA)
    assert {r.label for r in M.score_targets(one, M.fit_targets(one)).collect()} == {"positive"}
    two = spark.createDataFrame([r for r in rows if r[5] != "positive"], SCHEMA)
    assert "positive" not in {r.label for r in M.score_targets(two, M.fit_targets(two)).collect()}


def test_quality_on_the_documents(spark):
    """Stated quality on sf0.01: no worse than naming the most frequent label (the invented prose carries little tone)."""
    df = Q._labelled(spark, "/root/testdata/sf0.01")
    q = M.target_quality(df, M.fit_targets(df)).first()
    print(f"held out {q.n}: accuracy {q.accuracy:.3f}, majority {q.majority:.3f}, log loss {q.log_loss:.3f}, calibration {q.calibration:+.3f}")
    assert q.accuracy > q.majority - 0.08 and abs(q.calibration) < 0.15


def test_long_sides_are_not_split_whole(spark):
    far = "x" * 300
    rows = [(1, "t", "Wort " * 900 + "a b C d e f g", "t", "h i j k l m n " + "wort " * 900, None), (2, "t", f"a {far} b {far}", "t", f"{far} c {far} d", None),
            (3, "t", " \t ".join(["Ä", far, "ΑΣ"]) + " " * 300, "t", "\n" * 300 + "ΟΔΟΣ q", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    f = M.features(F.col("left"), F.col("target"), F.col("right"))
    assert "substring" in str(f)
    for r in df.select("left", "target", "right", f.alias("f")).collect():
        assert r.f == columns_of(r.left, r.target, r.right)
