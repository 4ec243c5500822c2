"""The neighbour graph and the projection, against brute force and (for kept neighbours) DuckDB on the original vectors."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpuspulse.operators import clusters as C
from corpuspulse.operators import projection as P

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


def brute(names, x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    out = {}
    for i, n in enumerate(names):
        order = sorted((d[i, j], names[j]) for j in range(len(names)) if j != i)[:k]
        out[n] = [m for _d, m in order]
    return out


def found(graph):
    out = {}
    for r in sorted(graph.collect(), key=lambda r: (r.node, r.rank)):
        out.setdefault(r.node, []).append(r.neighbour)
    return out


def test_graph_is_exact_in_one_cell_and_near_it_in_many(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    nodes = P.graph_nodes(df)
    want = brute(list(range(900)), x, 5)
    assert found(P.knn_graph(nodes, 5)) == want
    many = found(P.knn_graph(nodes, 5, cell=100))
    hit = sum(len(set(many[i]) & set(want[i])) for i in want) / (5 * 900)
    assert set(many) == set(want) and hit > 0.8


def test_cells_that_no_projection_divides_stay_bounded(spark):
    """Most vectors nearly equal: cells are cut by hash, every node still gets neighbours of its own kind."""
    rng = np.random.default_rng(2)
    x = np.vstack([np.ones((600, 6)) + 1e-13 * rng.standard_normal((600, 6)), rng.standard_normal((100, 6)) * 5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    nodes = P._cut(P.graph_nodes(df))
    sizes = P._dealt(nodes, nodes.count(), 50, 4, 1).groupBy("leaf").count().collect()
    assert sum(r["count"] for r in sizes) == 4 * 700 and max(r["count"] for r in sizes) <= 4 * 50
    got = found(P.knn_graph(nodes, 3, cell=50, trees=4))
    assert set(got) == set(range(700)) and all(m < 600 for n in range(600) for m in got[n])


def test_awkward_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 1.0]), (5, [0.0, 3.0]), (6, None), (7, [1.0, None]),
            (8, [float("nan"), 0.0]), (9, [1.0]), (10, []), (None, [5.0, 5.0]), (11, [-1.0, 2.0]), (11, [4.0, 4.0])]
    out = P.project_neighbours(spark.createDataFrame(rows, SCHEMA), k=2, rounds=3).collect()
    assert len(out) == len(rows)
    at = {}
    for r in out:
        at.setdefault(r.vec_id, []).append((r.x, r.y))
    assert at[1] == at[2] and at[1][0][0] is not None
    assert all(at[i] == [(None, None)] for i in (6, 7, 8, 9, 10, None))
    assert P.project_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    one = P.project_neighbours(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert len(one) == 1


def kept_by_sql(vectors: pd.DataFrame, coords: pd.DataFrame, k: int = 10) -> float:
    """Share of the k nearest by original vectors that are among the k nearest by coordinates."""
    con = duckdb.connect()
    con.register("vectors", vectors)
    con.register("coords", coords)
    return con.execute(f"""
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e FROM vectors),
        a AS (SELECT p.vec_id AS i, q.vec_id AS j FROM v p JOIN v q ON p.vec_id <> q.vec_id
              QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY array_distance(p.e, q.e), q.vec_id) <= {k}),
        b AS (SELECT p.vec_id AS i, q.vec_id AS j FROM coords p JOIN coords q ON p.vec_id <> q.vec_id
              QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2, q.vec_id) <= {k})
        SELECT (SELECT count(*) FROM a JOIN b USING (i, j)) / (SELECT count(*) FROM a)""").fetchone()[0]


@pytest.mark.parametrize("rounds", [40])
def test_the_layout_keeps_more_neighbours_than_pca(spark, rounds):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    plain = vecs.toPandas()[["vec_id", "embedding"]]
    pca = kept_by_sql(plain, C.project_2d(vecs).toPandas())
    spectral = kept_by_sql(plain, P.project_neighbours(vecs, rounds=0).toPandas())
    layout = kept_by_sql(plain, P.project_neighbours(vecs, rounds=rounds).toPandas())
    assert spectral > 1.3 * pca and layout > 2.5 * pca


def test_kept_share_of_perfect_and_random_coordinates(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    nodes = P.graph_nodes(df)
    graph = P.knn_graph(nodes, 10)
    same = nodes.selectExpr("node", "v[0] as x", "v[1] as y")
    assert P.kept_neighbours(graph, same).first().share == 1.0
    mixed = nodes.selectExpr("node", "hash(node) / 1e9 as x", "hash(node + 1) / 1e9 as y")
    assert P.kept_neighbours(graph, mixed).first().share < 0.2
