"""Weighted fair queueing against a plain queue, and the bounds a mix must keep."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from .cases import WORD, frame, texts

from corpuspulse.llm import mixing


def shared(sizes, weights, budget, passes=3):
    """Targets by rounds of resharing, in exact fractions."""
    limited = {}
    while True:
        live = [s for s in sizes if s not in limited and weights.get(s, 0) > 0]
        rest = budget - sum(limited.values())
        total = sum(weights[s] for s in live)
        share = {s: Fraction(rest) * weights[s] / total for s in live}
        over = [s for s in live if share[s] > passes * sizes[s]]
        if not over:
            return {s: limited.get(s, share.get(s, Fraction(0))) for s in sizes}
        limited |= {s: Fraction(passes * sizes[s]) for s in over}


def queued(rows, passes=3):
    """``(id, source, size) -> taken`` counts of the mix by one sorted list of all copies."""
    size = lambda t: len(WORD.findall(t or ""))
    docs = [(i, s, size(t), int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    order = sorted({d[1] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(d[2] for d in docs if d[1] == s) for s in order}
    targets = shared(total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(total.values()))
    copies, taken = [], defaultdict(int)
    for s in order:
        upto = 0
        for n, (i, _s, z, h) in enumerate(sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] is None, d[0] or 0, d[2]))):
            upto += z
            taken[(i, s, z, n)] = 0
            if z and targets[s]:
                copies += [(float(p * total[s] + upto) / float(targets[s]), order.index(s), h, upto, z, (i, s, z, n)) for p in range(passes)]
    left = sum(total.values())
    for *_key, z, of in sorted(copies):
        if z > left:
            break
        left -= z
        taken[of] += z
    return sorted(((str(i), str(s), z, t) for (i, s, z, _n), t in taken.items())), total, targets


def mixed_rows(seed=4):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["a", "B", "é", "中", None, "src10", "src9"])) for i, t in texts(seed)]
    rows += [(1000 + i, "w " * rng.randint(1, 60), "hot") for i in range(300)]
    return rows + [(2000, "", "empty"), (2001, None, "empty"), (2002, "only one", "tiny")]


def df_of(spark, rows):
    base = frame(spark, [(i, t) for i, t, _s in rows]).drop("bucket")
    from pyspark.sql import types as T
    schema = T.StructType([*base.schema.fields, T.StructField("source", T.StringType()), T.StructField("size", T.IntegerType()),
                           T.StructField("target", T.StringType()), T.StructField("weight", T.StringType())])
    return spark.createDataFrame([(i, t, "x", True, 7, 8, "r", "s", 10, s, 1, "t", "w") for i, t, s in rows], schema)


@pytest.mark.parametrize("rows_per_bucket", [2_000, 5])
def test_the_mix_is_the_truncated_queue(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(mixing, "ROWS", rows_per_bucket)
    rows = mixed_rows()
    out = mixing.mix_sources(df_of(spark, rows)).collect()
    want, total, targets = queued(rows)
    assert sorted((str(r.id), str(r.source), r.size, r.taken) for r in out) == want
    assert all(r.source_size == total[r.source] and abs(r.target - float(targets[r.source])) < 1e-6 for r in out)
    assert all(r.taken <= 3 * r.size and r.copies == len(r.finish) for r in out)
    again = mixing.mix_sources(df_of(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_targets_take_limits_in_any_order(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 10, 1000, 10 ** 6]) for k in range(rng.randint(1, 9))}
        weights = {s: rng.choice([0, 1, 2, 5, 100]) for s in sizes}
        if not sum(sizes[s] for s in sizes if weights[s]):
            continue
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"),
                                    spark.createDataFrame(list(weights.items()), "source string, weight long")).collect()
        limit = 3 * sum(sizes[s] for s in sizes if weights[s])
        want = shared(sizes, weights, min(sum(sizes.values()), limit))
        assert all(abs(r.target - float(want[r.source])) <= 1e-9 * max(1.0, r.target) for r in got)


def test_order_of_the_mix_is_fair_throughout(spark):
    """At any point of the laid out mix every source is near the same part of its target."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("aaaaabc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(df)
    target = {r.source: r.target for r in mix.select("source", "target").distinct().collect()}
    done = dict.fromkeys(target, 0)
    for k, r in enumerate(mixing.mixed_order(mix).collect()):
        done[r.source] += r.size
        if k % 200 == 199:
            parts = [done[s] / target[s] for s in target]
            assert max(parts) - min(parts) < 31 / min(target.values()) * 2
    assert all(abs(done[s] - target[s]) <= 60 for s in target)


def test_other_budgets_weights_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "a b c d", "x" if i % 2 else "y") for i in range(100)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 3), ("y", 1)], "source string, weight long")
    out = mixing.mix_sources(df, weights, budget=100).groupBy("source").sum("taken").collect()
    assert {r[0]: r[1] for r in out} == {"x": 72, "y": 24} or sum(r[1] for r in out) == 100
    everything = mixing.mix_sources(df, weights, budget=10 ** 6).groupBy("source").sum("taken").collect()
    assert {r[0]: r[1] for r in everything} == {"x": 600, "y": 600}
    none = mixing.mix_sources(df, weights.where("weight > 5")).groupBy("source").sum("taken").collect()
    assert {r[1] for r in none} == {0}
    assert mixing.mix_sources(df.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix_sources(df.selectExpr("doc_id", "cast(null as string) as text", "source")).collect()} == {0}


def test_native(spark):
    df = spark.createDataFrame(mixed_rows()[:20], "doc_id long, text string, source string")
    plan = mixing.mix_sources(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in ("Python", "Pandas", "Arrow"))
