"""M6, a projection that keeps neighbourhoods: nearest-neighbour graph, spectral coordinates, layout.

The graph is a table ``(node, neighbour, rank, sqdist)``.  Up to ``CELL`` vectors meet in one cell and the graph is
exact; above that, vectors are dealt to cells by the signs of random projections, several times over, and the nearest
ones of all dealings are kept.  Spectral coordinates are a power iteration on the graph's random walk, written as joins
and sums: a step replaces each node's coordinates by the mean of its neighbours'.  The layout then moves the nodes by
the forces of stochastic neighbour embedding: attraction is a join over the edges, repulsion comes from a grid whose
cells are summed up per round (at most ``GRID`` squared rows), so a round costs one shuffle of the edges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.operators.vectors import complete_vectors, matrix, partial_sums, usual_width
from corpuspulse.session import scratch_table_path, ship_package

CELL = 4096      # vectors that are compared with each other in one cell
TREES = 12       # dealings, where one cell does not hold all
GRID = 48
STEPS = 20       # power steps of the spectral coordinates
ROUNDS = 40      # layout rounds


def _cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: short lineage, and sizes the planner can trust in a loop of joins."""
    path = scratch_table_path(df.sparkSession, f"projection-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def graph_nodes(vecs: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(node, v)``: the distinct complete vectors, named by their smallest id (equal vectors are one node)."""
    dim = usual_width(vecs, vec)
    rows = complete_vectors(vecs.where(F.col(id_col).isNotNull()), vec, dim, id_col)
    return rows.groupBy("v").agg(F.min(id_col).alias("node")).select("node", "v")


def _dealt(nodes: DataFrame, n: int, cell: int, trees: int, seed: int) -> DataFrame:
    """``(leaf, node, v)``: every node once per dealing, in cells of about ``cell`` nodes."""
    import numpy as np
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / cell))))
    if depth == 0:
        return nodes.select(F.lit(0).cast("long").alias("leaf"), "node", "v")
    dim = nodes.select(F.size("v").alias("d")).first()["d"]

    def sums(batches):
        total = np.zeros(dim + 1)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                total += np.append(x.sum(axis=0), len(x))
        return {0: total}
    mean = partial_sums(nodes, sums, dim + 1)[0]
    mean = mean[:-1] / mean[-1]
    bits = min(48, depth + 24)
    planes = np.random.default_rng(seed).standard_normal((trees, dim, bits))

    def deal(batches):
        import pyarrow as pa
        powers = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v")) - mean
                for t in range(trees):
                    code = ((x @ planes[t]) > 0) @ powers
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(code), batch.column("node"), batch.column("v")],
                                                     names=["tree", "code", "node", "v"])
    kind = dict(nodes.dtypes)["node"]
    rows = nodes.mapInArrow(deal, f"tree long, code long, node {kind}, v array<double>")
    # A cell that holds more than twice its share is divided by further projections; the sizes are a small table.
    leaf = lambda d: F.struct("tree", F.lit(d).alias("d"), F.shiftright("code", bits - d).alias("p"))
    deep = [depth, *range(depth + 3, bits + 1, 3)]
    code_counts = _cut(rows.groupBy("tree", F.shiftright("code", bits - min(bits, depth + 12)).alias("top")).count())
    top = min(bits, depth + 12)
    out, done = [], None
    for d in [d for d in deep if d <= top]:
        prefix = code_counts.groupBy("tree", F.shiftright("top", top - d).alias("p")).agg(F.sum("count").alias("n"))
        last = d + 3 > top
        small = prefix.where((F.col("n") <= 2 * cell) | F.lit(last)).select("tree", F.lit(d).alias("d"), "p", "n")
        if done is not None:  # only below cells that were too large so far
            small = small.join(done, (small["tree"] == done["_t"]) & (F.shiftright(small["p"], 3) == done["_p"]), "left_semi")
        done = prefix.where(F.col("n") > 2 * cell).select(F.col("tree").alias("_t"), F.col("p").alias("_p"))
        out.append(small)
    cells = out[0]
    for more in out[1:]:
        cells = cells.unionByName(more)
    cells = _cut(cells.select("tree", "d", "p", F.ceil(F.col("n") / (2 * cell)).alias("pieces")))
    tagged = rows.withColumn("d", F.explode(F.array(*[F.lit(d) for d in deep if d <= top])))
    tagged = tagged.withColumn("p", F.expr(f"shiftright(code, {bits} - d)")).drop("code")
    met = tagged.join(F.broadcast(cells) if cells.count() <= 100_000 else cells, ["tree", "d", "p"])
    # What no projection divides (a cell of near copies) is cut into pieces by hash.
    return met.select(F.xxhash64("tree", "d", "p", F.pmod(F.xxhash64("node"), F.col("pieces"))).alias("leaf"), "node", "v")


def _nearest_in_cells(dealt: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every node inside its cell; a task holds one cell at a time."""
    node = dict(dealt.dtypes)["node"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def nearest(names, x):
            names = np.array(names)
            order = np.argsort(names, kind="stable")
            names, x = names[order], x[order]
            size = (x * x).sum(axis=1)
            for a in range(0, len(x), 1024):
                d = size[a:a + 1024, None] + size[None, :] - 2 * x[a:a + 1024] @ x.T
                m = len(d)
                d[np.arange(m), a + np.arange(m)] = np.inf
                take = min(k + 4, len(x) - 1)
                if take <= 0:
                    continue
                near = np.argpartition(d, take - 1, axis=1)[:, :take]
                # The few nearest are measured again by differences, which ranks ties and near ties exactly.
                exact = ((x[a:a + 1024, None, :] - x[near]) ** 2).sum(axis=2)
                rank = np.lexsort((near, exact), axis=1)[:, :k]
                near, exact = np.take_along_axis(near, rank, 1), np.take_along_axis(exact, rank, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[a:a + 1024], near.shape[1])), pa.array(names[near.ravel()]),
                                                  pa.array(exact.ravel())], names=["node", "neighbour", "sqdist"])

        leaf, names, parts = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves, x = batch.column("leaf").to_numpy(), matrix(batch.column("v"))
            edges = np.flatnonzero(np.diff(leaves)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(leaves))):
                if leaf is not None and leaves[a] != leaf:
                    yield from nearest(names, np.concatenate(parts))
                    names, parts = [], []
                leaf = leaves[a]
                names.extend(batch.column("node").slice(a, b - a).to_pylist())
                parts.append(x[a:b])
        if names:
            yield from nearest(names, np.concatenate(parts))

    return dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, f"node {node}, neighbour {node}, sqdist double")


def knn_graph(nodes: DataFrame, k: int = 10, cell: int = CELL, trees: int = TREES, seed: int = 42) -> DataFrame:
    """``(node, neighbour, rank, sqdist)``: the ``k`` nearest other nodes by Euclidean distance, ties to the smaller name.

    ``nodes(node, v)`` comes from ``graph_nodes``.  Exact while one cell holds all nodes, else the nearest of ``trees``
    dealings (the README gives the measured recall).  A row per node and neighbour, fewer than ``k`` where there are
    fewer nodes; an empty table gives an empty graph.
    """
    ship_package(nodes.sparkSession)
    nodes = _cut(nodes)
    found = _nearest_in_cells(_dealt(nodes, nodes.count(), cell, trees, seed), k)
    best = found.groupBy("node", "neighbour").agg(F.min("sqdist").alias("sqdist"))
    w = Window.partitionBy("node").orderBy("sqdist", "neighbour")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("node", "neighbour", "rank", "sqdist")


def _edges(graph: DataFrame) -> DataFrame:
    """Both directions of every link, once."""
    one = graph.select(F.col("node").alias("src"), F.col("neighbour").alias("dst"))
    return one.unionByName(graph.select(F.col("neighbour").alias("src"), F.col("node").alias("dst"))).distinct()


def spectral_2d(nodes: DataFrame, graph: DataFrame, steps: int = STEPS) -> DataFrame:
    """``(node, x, y)``: two slow directions of the graph's random walk, by ``steps`` power steps as joins and sums.

    The start is two fixed sign patterns over the vector's entries, free of the walk's constant direction, so reruns
    agree.  The result is centred (by degree), of unit length, and ``y`` is free of ``x``.
    """
    edges = _cut(_edges(graph))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).withColumnRenamed("src", "node")
    signed = lambda s: F.aggregate(F.transform("v", s), F.lit(0.0), lambda a, c: a + c)
    start = nodes.select("node", signed(lambda c, i: F.when(i % 2 == 0, c).otherwise(-c)).alias("x"),
                         signed(lambda c, i: F.when(F.floor(i / 2) % 2 == 0, c).otherwise(-c)).alias("y"))
    at = _cut(start.join(degree, "node"))
    mean = at.agg(*[(F.sum(F.col(c) * F.col("deg")) / F.sum("deg")).alias(c) for c in "xy"]).first()
    at = at.select("node", "deg", *[(F.col(c) - F.lit(mean[c])).alias(c) for c in "xy"]) if mean["x"] is not None else at
    for step in range(steps):
        told = edges.join(at.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(
            F.count(F.lit(1)).alias("deg"), F.avg("x").alias("x"), F.avg("y").alias("y"))
        at = told.withColumnRenamed("src", "node")
        if step % 5 == 4:
            at = _cut(at)
    at = _cut(at)
    m = at.agg(F.sum("deg").alias("w"), *[F.sum(F.col(c) * F.col("deg")).alias(c) for c in "xy"]).first()
    if not m["w"]:
        return at.select("node", "x", "y")
    at = at.select("node", *[(F.col(c) - F.lit(m[c] / m["w"])).alias(c) for c in "xy"])
    g = at.agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
    unit = lambda s: s ** 0.5 if s > 0 else 1.0
    rest = g["yy"] - g["xy"] ** 2 / (g["xx"] or 1.0)
    return at.select("node", (F.col("x") / unit(g["xx"])).alias("x"),
                     ((F.col("y") - F.col("x") * (g["xy"] / (g["xx"] or 1.0))) / unit(rest)).alias("y"))


def layout_2d(coords: DataFrame, graph: DataFrame, rounds: int = ROUNDS, early: float = 4.0) -> DataFrame:
    """``(node, x, y)`` after ``rounds`` rounds of neighbour-embedding forces, from the coordinates given.

    Attraction runs along the edges, stronger in the first third of the rounds.  Each round's state (five numbers a node)
    goes to the shared folder, so a lost executor costs one round.
    """
    import numpy as np
    ship_package(coords.sparkSession)
    edges = _cut(_edges(graph))
    total = edges.count()
    scale = coords.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")).first()
    n = scale["n"]
    if n < 3 or not total:
        return coords
    kind = dict(coords.dtypes)["node"]
    state = _cut(coords.select("node", *[(F.col(c) / (scale[c] or 1.0)).alias(c) for c in "xy"], F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")))
    low, width = np.array([-3.0, -3.0]), np.array([6.0, 6.0])

    def cells_of(state, low, width):
        place = [F.least(F.lit(GRID - 1), F.greatest(F.lit(0), F.floor((F.col(c) - F.lit(float(low[i]))) * F.lit(GRID / float(width[i])))))
                 for i, c in enumerate("xy")]
        return np.array([tuple(r) for r in state.groupBy((place[0] * GRID + place[1]).alias("c")).agg(
            F.count(F.lit(1)), F.avg("x"), F.avg("y"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).drop("c").collect()])

    cells = cells_of(state, low, width)
    for r in range(rounds):
        low = np.minimum.reduce(cells[:, 3:5])
        width = np.maximum(np.maximum.reduce(cells[:, 5:7]) - low, 1e-9)
        count, centre = cells[:, 0], cells[:, 1:3]

        def around(x, y):
            dx, dy = x[:, None] - centre[None, :, 0], y[:, None] - centre[None, :, 1]
            return dx, dy, 1 / (1 + dx * dx + dy * dy)

        # The sum of all affinities, from the cells among themselves.
        z = max(float(((around(centre[:, 0], centre[:, 1])[2] * count[None, :]).sum(axis=1) * count).sum()) - n, 1.0)
        first = r < rounds * 0.3
        pull, keep, rate = (early if first else 1.0), (0.5 if first else 0.8), float(n)

        def step(batches, centre=centre, count=count, around=around, z=z, pull=pull, keep=keep, rate=rate):
            import pyarrow as pa
            for batch in batches:
                x, y, vx, vy, ax, ay = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "vx", "vy", "ax", "ay"))
                fx, fy = np.empty(len(x)), np.empty(len(x))
                for a in range(0, len(x), 2048):
                    s = slice(a, a + 2048)
                    dx, dy, q = around(x[s], y[s])
                    q = q * q * count / z
                    fx[s], fy[s] = (q * dx).sum(axis=1), (q * dy).sum(axis=1)
                vx = keep * vx - rate * 4 * (pull * ax - fx)
                vy = keep * vy - rate * 4 * (pull * ay - fy)
                yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(v) for v in (x + vx, y + vy, vx, vy)]],
                                                 names=["node", "x", "y", "vx", "vy"])

        told = edges.join(state.select(F.col("node").alias("dst"), F.col("x").alias("xj"), F.col("y").alias("yj")), "dst")
        met = told.join(state.select(F.col("node").alias("src"), "x", "y"), "src")
        dx, dy = F.col("x") - F.col("xj"), F.col("y") - F.col("yj")
        w = 1 / ((1 + dx * dx + dy * dy) * float(total))
        drawn = met.groupBy("src").agg(F.sum(w * dx).alias("ax"), F.sum(w * dy).alias("ay")).withColumnRenamed("src", "node")
        moved = state.join(drawn, "node", "left").select("node", "x", "y", "vx", "vy", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ax", "ay")])
        moved = moved.mapInArrow(step, f"node {kind}, x double, y double, vx double, vy double")
        state = _cut(moved)
        cells = cells_of(state, low, width)
    return state.select("node", "x", "y")


def project_neighbours(vecs: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = 10, steps: int = STEPS,
                       rounds: int = ROUNDS) -> DataFrame:
    """M6: ``(id, x, y)`` for every row: spectral coordinates of the neighbour graph, laid out so that neighbours stay near.

    Equal vectors get equal coordinates.  Rows without id, and vectors that are NULL, hold NULL or non-finite entries or
    have another than the usual length, get NULL coordinates; an empty table gives an empty result.
    """
    ship_package(vecs.sparkSession)
    nodes = _cut(graph_nodes(vecs, id_col, vec))
    graph = _cut(knn_graph(nodes, k))
    coords = layout_2d(spectral_2d(nodes, graph, steps), graph, rounds)
    v = F.col(vec).cast("array<double>")
    named = nodes.join(coords, "node").select(F.col("v").alias("_v"), "x", "y")
    return vecs.join(named, (v == F.col("_v")) & F.col(id_col).isNotNull(), "left").select(id_col, "x", "y")


def kept_neighbours(graph: DataFrame, coords: DataFrame, k: int = 10) -> DataFrame:
    """One row ``(k, pairs, kept, share)``: how many links of a graph are among the ``k`` nearest by coordinates."""
    flat = knn_graph(coords.select("node", F.array("x", "y").alias("v")), k).select("node", "neighbour", F.lit(1).alias("near"))
    met = graph.select("node", "neighbour").join(flat, ["node", "neighbour"], "left")
    return met.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("pairs"), F.count("near").alias("kept")).select(
        "*", (F.col("kept") / F.col("pairs")).alias("share"))
