"""M9, a trained target classifier: hashed position features of (left, target, right), a linear model, calibrated odds.

A segment's features are the tokens nearest to the target with their side and distance, the target's own tokens, and the
unplaced tokens of both sides, each hashed to one of ``BUCKETS`` columns.  The model is a multinomial logistic regression
fitted by Spark ML over all labelled segments; its size depends on parameters only.  One number, the temperature, is then
chosen on segments held out by a hash of their id so that the probabilities fit the labels there.  Scoring is a projection:
the weights travel as one literal array and every segment sums its features' rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.functions.text import tokens
from corpuspulse.functions.util import json_literal, let

BUCKETS = 2_048
REACH = 6               # tokens on each side that count, with their distance
NEAR_CHARS = 256        # the stretch of a side that is split into tokens first
LABELS = ("negative", "neutral", "positive")
TEMPERATURES = tuple(0.25 * 1.25 ** i for i in range(16))


@dataclass
class TargetModel:
    """``weights`` (labels x (buckets + 1), the last column is the intercept) and the temperature."""

    weights: object
    temperature: float = 1.0
    labels: tuple = LABELS


def features(left: Column, target: Column, right: Column, buckets: int = BUCKETS, reach: int = REACH) -> Column:
    """Sorted distinct feature columns (array<int>) of a segment; NULL parts are empty."""
    def side(text: Column, name: str, near_end: bool) -> Column:
        whole = F.coalesce(text, F.lit(""))
        # A stretch next to the target gives the tokens, but for the one it may cut; only where they are too few is the rest read.
        stretch = F.substring(whole, -NEAR_CHARS, NEAR_CHARS) if near_end else F.substring(whole, 1, NEAR_CHARS)
        found = let(tokens(F.lower(stretch)), lambda t: F.slice(t, 2 if near_end else 1, F.greatest(F.size(t) - 1, F.lit(0))))
        ts = let(found, lambda t: F.when(F.size(t) >= reach, t).otherwise(tokens(F.lower(whole))))
        near = let(ts, lambda t: F.reverse(F.slice(t, F.greatest(F.size(t) - reach + 1, F.lit(1)), reach)) if near_end else F.slice(t, 1, reach))
        return let(near, lambda t: F.concat(F.transform(t, lambda w, i: F.concat(F.lit(name), F.least(i, F.lit(3)).cast("string"), F.lit(":"), w)),
                                            F.transform(t, lambda w: F.concat(F.lit("c:"), w))))
    own = F.transform(tokens(F.lower(F.coalesce(target, F.lit("")))), lambda w: F.concat(F.lit("t:"), w))
    column = lambda s: (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    return F.array_sort(F.array_distinct(F.transform(F.concat(side(left, "l", True), own, side(right, "r", False)), column)))


def margins(found: Column, model: TargetModel) -> Column:
    """Sum of the features' weight rows plus the intercepts: one array of a number per label."""
    import numpy as np
    w = np.asarray(model.weights, dtype=float)
    table = json_literal([[float(x) for x in row] for row in w[:, :-1].T], "array<array<double>>")
    start = F.array(*[F.lit(float(x)) for x in w[:, -1]])
    return let(table, lambda t: F.aggregate(found, start, lambda acc, f: F.zip_with(acc, F.get(t, f), lambda a, b: a + b)))


def probabilities(found: Column, model: TargetModel) -> Column:
    """Softmax of the margins over the temperature."""
    cool = F.transform(margins(found, model), lambda m: m / F.lit(float(model.temperature)))
    odds = let(cool, lambda m: F.transform(m, lambda x: F.exp(x - F.array_max(m))))
    return let(odds, lambda o: F.transform(o, lambda x: x / F.aggregate(o, F.lit(0.0), lambda a, b: a + b)))


def score_targets(segments: DataFrame, model: TargetModel, id_col: str = "doc_id", keep=()) -> DataFrame:
    """M9: ``(id, *keep, topic, label, prob, score)`` per segment; narrow.

    ``label`` is the likeliest one (ties: the first of ``labels``), ``score`` its probability with the sign of the label,
    0 for neutral.  NULL parts of a segment count as empty.
    """
    p = probabilities(features(F.col("left"), F.col("target"), F.col("right"), model.weights.shape[1] - 1), model)
    rows = segments.select(id_col, *keep, "topic", p.alias("_p"))
    best = F.array_max("_p")
    label = F.get(F.array(*[F.lit(x) for x in model.labels]), (F.array_position("_p", best) - 1).cast("int"))
    sign = F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)
    return rows.select(id_col, *keep, "topic", label.alias("label"), best.alias("prob"), (sign * best).alias("score"))


def held_out(id_: Column, parts: int = 5) -> Column:
    """One id in ``parts`` is kept from the fit; a NULL id never is."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % parts == 0, F.lit(False))


def fit_targets(segments: DataFrame, id_col: str = "doc_id", label: str = "label", buckets: int = BUCKETS, reg: float = 1e-2,
                max_iter: int = 60) -> TargetModel:
    """Fit on the labelled segments outside the held-out fifth, calibrate on that fifth (all of it where nothing is held out).

    Rows with another label, or none, are left out; without any labelled row all weights are 0.
    """
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    number = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(label)) - 1
    rows = segments.select(number.cast("double").alias("label"), held_out(F.col(id_col)).alias("held"),
                           features(F.col("left"), F.col("target"), F.col("right"), buckets).alias("f")).where("label >= 0").persist()
    try:
        present = sorted(int(r["label"]) for r in rows.where("not held").select("label").distinct().collect())
        weights = np.zeros((len(LABELS), buckets + 1))
        if len(present) == 1:
            weights[present[0], -1] = 10.0
        if len(present) > 1:
            # Column numbers as terms of a fixed vocabulary: sparse vectors without leaving the JVM.
            as_vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], "terms", "features", binary=True)
            data = as_vector.transform(rows.where("not held").select("label", F.col("f").cast("array<string>").alias("terms")))
            fit = LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter, standardization=False).fit(data)
            matrix = fit.coefficientMatrix.toArray()
            weights[:len(matrix), :-1], weights[:len(matrix), -1] = matrix, fit.interceptVector.toArray()
            for k in set(range(len(LABELS))) - set(present):
                weights[k, -1] = -30.0   # a label the fit never saw
        model = TargetModel(weights)
        model.temperature = _calibrated(rows, model)
        return model
    finally:
        rows.unpersist()


def _calibrated(rows: DataFrame, model: TargetModel) -> float:
    """The temperature with the least mean log loss on held-out rows (all tried in one aggregate)."""
    z = margins(F.col("f"), model)

    def loss(t: float) -> Column:
        scaled = F.transform("z", lambda m: m / F.lit(t))
        top = F.array_max(scaled)
        total = F.aggregate(F.transform(scaled, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, b: a + b)
        return F.avg(F.log(total) + top - F.get(scaled, F.col("label").cast("int"))).alias(f"t{t}")
    found = rows.where("held").select("label", z.alias("z")).agg(*[loss(t) for t in TEMPERATURES]).first()
    if found[0] is None:
        return 1.0
    return min(zip(found, TEMPERATURES))[1]


def target_quality(segments: DataFrame, model: TargetModel, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """One row over the held-out labelled segments: ``(n, accuracy, majority, log_loss, calibration)``.

    ``majority`` is the accuracy of always naming the most frequent label, ``calibration`` the difference between the mean
    probability of the named labels and the accuracy.
    """
    known = segments.where(F.col(label).isin(*LABELS) & held_out(F.col(id_col))).withColumn("topic", F.col(label))
    scored = score_targets(known, model, id_col)
    p = probabilities(features(F.col("left"), F.col("target"), F.col("right"), model.weights.shape[1] - 1), model)
    loss = known.select((-F.log(F.get(p, (F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(label)) - 1).cast("int")))).alias("l"))
    counts = known.groupBy(label).count().agg(F.max("count").alias("m"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("topic")).cast("double")).alias("accuracy"),
                      (counts.scalar() / F.count(F.lit(1))).alias("majority"), loss.agg(F.avg("l").alias("l")).scalar().alias("log_loss"),
                      (F.avg("prob") - F.avg((F.col("label") == F.col("topic")).cast("double"))).alias("calibration"))
