"""Registered queries: neighbour graph, spectral coordinates and layout (M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.operators import projection as P
from corpuspulse.plans.registry import register
from corpuspulse.sources.tables import driver_table

GRAPH = """nodes AS (
  SELECT min(vec_id) AS node, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings) t GROUP BY v),
near AS (
  SELECT a.node, b.node AS neighbour, array_distance(a.v, b.v) * array_distance(a.v, b.v) AS sqdist,
         row_number() OVER (PARTITION BY a.node ORDER BY array_distance(a.v, b.v), b.node) AS rank
  FROM nodes a JOIN nodes b ON a.node <> b.node QUALIFY rank <= 10)"""

SPECTRAL = GRAPH + f""",
edges AS MATERIALIZED (SELECT node AS src, neighbour AS dst FROM near UNION SELECT neighbour, node FROM near),
deg AS (SELECT src AS node, count(*) AS deg FROM edges GROUP BY src),
signed AS (
  SELECT node, list_sum(list_transform(generate_series(1, 64), lambda i: v[i] * (CASE WHEN (i - 1) % 2 = 0 THEN 1 ELSE -1 END))) AS x,
         list_sum(list_transform(generate_series(1, 64), lambda i: v[i] * (CASE WHEN (i - 1) // 2 % 2 = 0 THEN 1 ELSE -1 END))) AS y
  FROM nodes),
start AS (
  SELECT node, x - (SELECT sum(x * deg) / sum(deg) FROM signed JOIN deg USING (node)) AS x,
         y - (SELECT sum(y * deg) / sum(deg) FROM signed JOIN deg USING (node)) AS y FROM signed),
walk AS (
  SELECT 0 AS t, node, x, y FROM start
  UNION ALL
  SELECT t + 1, src, avg(x), avg(y) FROM walk JOIN edges ON dst = node WHERE t < {P.STEPS} GROUP BY t, src),
last AS (SELECT node, x, y FROM walk WHERE t = {P.STEPS}),
mid AS (
  SELECT node, x - (SELECT sum(x * deg) / sum(deg) FROM last JOIN deg USING (node)) AS x,
         y - (SELECT sum(y * deg) / sum(deg) FROM last JOIN deg USING (node)) AS y FROM last),
g AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM mid),
coords AS (SELECT node, x / sqrt(xx) AS x, (y - x * (xy / xx)) / sqrt(yy - xy * xy / xx) AS y FROM mid, g)"""


def _graph(spark, sf):
    nodes = P._cut(P.graph_nodes(driver_table(spark, sf, "embeddings")))
    return nodes, P._cut(P.knn_graph(nodes))


@register("knn_graph", f"WITH {GRAPH}\nSELECT node, neighbour, CAST(rank AS INT) AS rank, round(sqdist, 6) AS sqdist FROM near")
def q_knn_graph(spark, sf):
    """M6: the ten nearest other vectors of every vector."""
    return _graph(spark, sf)[1].select("node", "neighbour", "rank", F.round("sqdist", 6).alias("sqdist"))


@register("spectral_2d", f"WITH RECURSIVE {SPECTRAL}\nSELECT node, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM coords")
def q_spectral_2d(spark, sf):
    """M6: spectral coordinates of the neighbour graph."""
    out = P.spectral_2d(*_graph(spark, sf))
    return out.select("node", *[(F.round(c, 6) + 0.0).alias(c) for c in "xy"])


@register("spectral_kept", f"""WITH RECURSIVE {SPECTRAL},
flat AS (
  SELECT a.node, b.node AS neighbour, row_number() OVER (
    PARTITION BY a.node ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.node) AS rank
  FROM coords a JOIN coords b ON a.node <> b.node QUALIFY rank <= 10)
SELECT 10 AS k, count(*) AS pairs, count(flat.node) AS kept, round(count(flat.node) / count(*), 6) AS share
FROM near LEFT JOIN flat ON flat.node = near.node AND flat.neighbour = near.neighbour""")
def q_spectral_kept(spark, sf):
    """M6: the share of neighbours that the spectral coordinates keep, against the original vectors."""
    nodes, graph = _graph(spark, sf)
    out = P.kept_neighbours(graph, P.spectral_2d(nodes, graph))
    return out.select("k", "pairs", "kept", F.round("share", 6).alias("share"))


@register("project_neighbours")
def q_project_neighbours(spark, sf):
    """M6: the neighbour-keeping layout in two dimensions (tests hold its kept share against PCA's by SQL)."""
    return P.project_neighbours(driver_table(spark, sf, "embeddings"))
