"""Segmented scans against a plain loop, with one group over most rows and groups that cross ranges."""

import random

from corpuspulse.operators import scans as S


def rows_of(seed=1, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 3 else rng.choice(["a", "b", None, "c"])
        out.append((g, rng.randint(-40, 40), i, rng.choice([None, None, rng.randint(-5, 5)])))
    return out


def expected(rows):
    last, total, out = {}, {}, {}
    for g, a, b, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is not None:
            last[g] = v
            total[g] = total.get(g, 0) + v
        out[b] = (last.get(g), total.get(g))
    return out


def test_scans_equal_a_loop(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g string, a int, b int, v int").repartition(7)
    carried = S.carry_forward(df, "v", ["g"], ["a", "b"], out="last")
    summed = S.running_sum(df, "v", ["g"], ["a", "b"])
    want = expected(rows)
    assert {r.b: r.last for r in carried.collect()} == {b: w[0] for b, w in want.items()}
    assert {r.b: r.running for r in summed.collect()} == {b: w[1] for b, w in want.items()}
    assert carried.columns == ["g", "a", "b", "v", "last"]


def test_the_hot_group_lies_in_many_blocks(spark):
    df = spark.createDataFrame(rows_of(), "g string, a int, b int, v int")
    blocks = S.sorted_blocks(df, ["g"], ["a", "b"]).where("g = 'hot'").groupBy(S._PART).count().collect()
    assert len(blocks) >= 4 and max(r["count"] for r in blocks) <= 300


def test_one_group_descending_and_empty(spark):
    rows = [(i, None if i % 4 else i) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, v int")
    up = {r.i: r.v for r in S.carry_forward(df, "v", [], ["i"]).collect()}
    assert up == {i: i // 4 * 4 for i in range(50)}
    down = {r.i: r.v for r in S.carry_forward(df, "v", [], [df["i"].desc()]).collect()}
    assert down == {i: (-(-i // 4) * 4 if -(-i // 4) * 4 < 50 else None) for i in range(50)}
    assert S.carry_forward(df.limit(0), "v", [], ["i"]).collect() == []
    nothing = spark.createDataFrame([(i, None) for i in range(9)], "i int, v int")
    assert {r.v for r in S.carry_forward(nothing, "v", [], ["i"]).collect()} == {None}
