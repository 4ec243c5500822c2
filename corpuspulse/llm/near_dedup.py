"""MinHash near-dedup with an LSH forest, links confirmed on the full shingle sets.

1. One pass hashes every document's word shingles (numpy over the Arrow buffers) into a set fingerprint and
   ``TREES`` signatures of ``DEPTH`` minima each.  Documents with equal sets form one class (map-side combined
   minimum, so a text copied a million times is one row from here on).
2. Each tree is a sorted order of the class signatures.  A region is a run that shares its first ``START``
   minima.  Up to ``REGION`` classes, all its pairs are compared on full shingle sets, unless both are known to
   be connected.
3. A larger region is divided at the next minima (adaptive depth; what is still larger at full depth by a hash of
   the id), and there a class is compared with the ``REACH`` before it in signature order.  This only finds most
   links of large groups cheaply; step 5 completes it.
4. A share of the regions is looked at first.  Connected components join what was found, and of the other
   regions only those that still hold different components are looked at.  So a group of thousands of near
   copies is read a few times, not compared pair by pair.
5. Classes of large regions that still hold different components go through an exact set join (``_large_links``):
   shingles ordered with the frequent ones last, prefix, length and position filters, verification.

Two sets of similarity s share a region of a tree with probability s**START; at s = 0.8 all 20 trees miss a pair
with probability 3e-5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm import rolling as R
from corpuspulse.llm.common import cut, keyed, prepare
from corpuspulse.llm.components import connected_components

TREES, START, DEPTH = 20, 4, 8
FIRST = 3  # of TREES shares of the regions are looked at first
REGION = 64
PART = 4096
REACH = 4
FREQUENT = 200_000  # shingles with a known place at the end of the order of the set join
POSTING = 2_000  # rows of one shingle that are joined in one group
PIECE_BYTES = 250_000  # a piece takes about 32 times its bytes in a Python worker
SHINGLE_BASE = np.uint64(0xD1B54A32D192ED03)
_RNG = np.random.Generator(np.random.PCG64(5))
FACTORS = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SIGNED = "key long, th long, n int, f1 long, f2 long, trees array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Distinct shingle hashes of each text, concatenated, and their number per text."""
    h, counts = R.words(LOWER[data], offsets)
    left = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(h))
    short = counts[row] < size if len(row) else np.zeros(0, bool)
    end = np.where(short, left[row + 1], start + size)
    ok = np.where(short, start == left[row], end <= left[row + 1]) if len(row) else np.zeros(0, bool)
    start, end, row = start[ok], end[ok], row[ok]
    g = R.mix(R.spans(R.prefix(h, SHINGLE_BASE), start, end, SHINGLE_BASE) + (end - start).astype(np.uint64))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.bincount(row, minlength=len(counts))


def _signatures(g: np.ndarray, counts: np.ndarray):
    """Fingerprints and packed tree signatures of the texts that have shingles."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
    f1 = np.add.reduceat(R.mix(g), first).view(np.int64)
    f2 = np.add.reduceat(R.mix(g ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)
    low = np.empty((len(first), TREES * DEPTH), np.uint64)
    for j, a in enumerate(FACTORS):
        low[:, j] = np.minimum.reduceat(g * a, first)
    low = (low >> np.uint64(32)).reshape(len(first), TREES, DEPTH)
    p = np.zeros(low.shape[:2], np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
    for d in range(START):
        p = R.mix(p * np.uint64(0xA0761D6478BD642F) + low[:, :, d])
    q = (low[:, :, START] << np.uint64(32)) | low[:, :, START + 1]
    r = (low[:, :, START + 2] << np.uint64(32)) | low[:, :, START + 3]
    return f1, f2, np.stack([p, q, r], axis=2).view(np.int64).reshape(len(first), -1)


def _sign(size: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            data, offsets = R.buffers(batch.column("text"))
            key, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th"))
            for a, b in R.pieces(offsets, PIECE_BYTES):
                g, counts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                f1, f2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                trees, width = np.zeros(0, np.int64), 3 * TREES
                some = counts > 0
                if some.any():
                    f1[some], f2[some], t = _signatures(g, counts)
                    trees = t.reshape(-1)
                off = np.concatenate([[0], np.cumsum(np.where(some, width, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a:b]), pa.array(th[a:b]), pa.array(counts.astype(np.int32)), pa.array(f1), pa.array(f2),
                     pa.ListArray.from_arrays(off, pa.array(trees))], names=["key", "th", "n", "f1", "f2", "trees"])
    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted shingle sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(size: int, percent: int):
    def run(batches):
        """Rows arrive sorted by (region, signature): compare each with all before it in its region.

        In a part of a large region, only with its nearest predecessors in the order.
        """
        import pyarrow as pa
        at, near, parent = None, [], {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for batch in batches:
            data, offsets = R.buffers(batch.column("text"))
            region = batch.column("region").to_pylist()
            large = batch.column("large").to_pylist()
            comp = batch.column("comp").to_pylist()
            out_a, out_b = [], []
            for a, b in R.pieces(offsets, PIECE_BYTES):
                g, counts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                ends = np.cumsum(counts)
                for k in range(a, b):
                    if region[k] != at:
                        at, parent = region[k], {}
                        near = []
                    mine = g[ends[k - a] - counts[k - a]:ends[k - a]].copy()
                    for c2, other in near[-REACH:] if large[k] else near:
                        if root(comp[k]) != root(c2) and _linked(mine, other, percent):
                            out_a.append(comp[k])
                            out_b.append(c2)
                            x, y = sorted((root(comp[k]), root(c2)))
                            parent[y] = x
                    near.append((comp[k], mine))
                    if large[k]:
                        near = near[-REACH:]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
    return run


def regions(rows: DataFrame) -> DataFrame:
    """Give tree rows ``(p, q, r, key, th)`` their region, at the smallest depth where it holds few classes.

    ``large`` marks rows whose whole region (the run of equal ``p``) holds more than ``REGION`` classes.  Rows that share no region are left out.  Counting is a combined aggregate, so a hot region is one small row
    there; only rows of large regions are counted again, at all deeper prefixes in one pass.
    """
    stats = rows.groupBy("p").agg(F.count("*").alias("size"), F.min("key").alias("k1"), F.max("key").alias("k2"))
    found = cut(rows.join(stats.where("k1 <> k2").select("p", "size"), "p"))
    small = found.where(F.col("size") <= REGION).select(F.col("p").alias("region"), "p", "q", "r", "key", "th", F.lit(False).alias("large"))
    large = found.where(F.col("size") > REGION).drop("size")
    step = lambda c: F.shiftright(F.col(c), 32)
    deeper = [F.xxhash64("p", step("q")), F.xxhash64("p", "q"), F.xxhash64("p", "q", step("r")), F.xxhash64("p", "q", "r")]
    keys = large.select("p", "q", "r", "key", "th", F.posexplode(F.array(*deeper)).alias("depth", "region"))
    sizes = keys.groupBy("depth", "region").agg(F.count("*").alias("size"))
    last = len(deeper) - 1
    best = (keys.join(sizes, ["depth", "region"]).where((F.col("size") <= REGION) | (F.col("depth") == last))
            .groupBy("p", "q", "r", "key", "th").agg(F.min(F.struct("depth", "region", "size")).alias("b")))
    # What is still large at full depth is divided into parts of bounded size; nothing else is.
    part = F.when(F.col("b.size") > REGION, F.pmod(F.xxhash64("key"), F.ceil(F.col("b.size") / PART))).otherwise(0)
    return small.unionByName(best.select(F.xxhash64("b.region", part).alias("region"), "p", "q", "r", "key", "th",
                                             F.lit(True).alias("large")))


def _shingles(size: int):
    """Shingles and how many texts of a piece hold each."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            data, offsets = R.buffers(batch.column("text"))
            for a, b in R.pieces(offsets, PIECE_BYTES):
                g, _ = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                g, held = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(held)], names=["g", "held"])
    return run


def _prefixes(size: int, percent: int, frequent: np.ndarray, place: np.ndarray):
    """The first shingles of each text in the join's order, with their position.

    The order is (place among the frequent shingles, 0 for all others; hash).
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            data, offsets = R.buffers(batch.column("text"))
            key, th, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th", "comp"))
            for a, b in R.pieces(offsets, PIECE_BYTES):
                g, counts = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                row = np.repeat(np.arange(b - a), counts)
                g = g.view(np.int64)
                at = np.zeros(len(g), np.int64)
                if len(frequent):
                    near = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
                    at = np.where(frequent[near] == g, place[near], 0)
                order = np.lexsort((g, at, row))
                g, row = g[order], row[order]
                pos = np.arange(len(g)) - np.repeat(np.cumsum(counts) - counts, counts)
                ok = pos <= (counts - -(-percent * counts // 100))[row]
                g, row, pos = g[ok], row[ok], pos[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(key[a:b][row]), pa.array(th[a:b][row]), pa.array(comp[a:b][row]),
                     pa.array(counts[row].astype(np.int32)), pa.array(pos.astype(np.int32))],
                    names=["g", "key", "th", "comp", "n", "pos"])
    return run


def _verify(size: int, percent: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            sides = [R.buffers(batch.column(c)) for c in ("text", "text2")]
            ca, cb = (batch.column(c).to_pylist() for c in ("comp", "comp2"))
            out, done = [], set()
            for k in range(len(ca)):
                if (ca[k], cb[k]) in done:
                    continue
                x, y = (shingle_sets(d[o[k]:o[k + 1]], o[k:k + 2] - o[k], size)[0] for d, o in sides)
                if _linked(x, y, percent):
                    done.add((ca[k], cb[k]))
                    out.append((ca[k], cb[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                              pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
    return run


def _large_links(placed: DataFrame, comps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Every link between different components inside the large regions (None: there are no such regions).

    A set of n shingles that shares at least c of them with another one shares one of its first n - c + 1 in any
    common order, and at the first shared one enough are left in both.  The order needs no exact frequencies: the
    ``FREQUENT`` most frequent shingles go last, so that boilerplate rarely is in a prefix.  A shingle of many rows
    is salted: one side is divided, the other one repeated.
    """
    rows = (placed.where("large").select("p", "key", "th").join(comps.withColumnRenamed("node", "key"), "key", "left")
            .select("p", "key", "th", F.coalesce("component", "key").alias("comp")))
    mixed = rows.groupBy("p").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("p")
    work = cut(rows.join(mixed, "p").select("key", "th", "comp").distinct())
    if work.isEmpty():
        return None
    held = texts.join(work, ["key", "th"])
    top = (held.select("text").mapInArrow(_shingles(size), "g long, held long").groupBy("g").agg(F.sum("held").alias("held"))
           .where("held > 1").orderBy(F.desc("held"), "g").limit(FREQUENT).toArrow())
    g = top.column("g").to_numpy()
    order = np.argsort(g)
    place = len(g) - order  # the most frequent one last
    posts = cut(held.select("key", "th", "comp", "text").mapInArrow(
        _prefixes(size, percent, g[order], place), "g long, key long, th long, comp long, n int, pos int"))
    hot = (posts.groupBy("g").agg(F.count("*").alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
           .where("c1 <> c2").select("g", F.ceil(F.col("m") / POSTING).cast("int").alias("salts")))
    posts = posts.join(hot, "g")
    left = posts.withColumn("salt", F.pmod(F.xxhash64("key", "th"), F.col("salts")).cast("int")).drop("salts")
    right = posts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = right.select("g", "salt", *[F.col(c).alias(c + "2") for c in ("key", "th", "comp", "n", "pos")])
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    pairs = (left.join(right, ["g", "salt"])
             .where((F.col("comp") < F.col("comp2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
                    & ((100 + percent) * rest.cast("long") >= percent * (F.col("n").cast("long") + F.col("n2"))))
             .select("key", "th", "comp", "key2", "th2", "comp2").distinct())
    other = texts.select(F.col("key").alias("key2"), F.col("th").alias("th2"), F.col("text").alias("text2"))
    return (pairs.join(texts, ["key", "th"]).join(other, ["key2", "th2"]).select("comp", "comp2", "text", "text2")
            .mapInArrow(_verify(size, percent), "a long, b long"))


def near_components(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    rec: bool = False) -> DataFrame:
    """``(id, n_shingles, component_id, kept[, text, rec])`` for every row of ``docs``.

    Lower-cases A-Z; words are runs of non-white-space; a set holds the distinct shingles of ``size`` words
    (of fewer words: the whole sequence).  Sets are linked when ``100 * both >= percent * either``.  Defined
    cases: a text without words has no shingles and stands alone; a NULL id takes no part (its component is
    NULL and it is kept); rows with the same id are one node of the graph; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    signed = cut(rows.where("id is not null").select("key", "th", "text").mapInArrow(_sign(size), SIGNED))
    # Classes of equal sets: the smallest id stands for all from here on.
    classes = signed.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("key", "th")).alias("rep"))
    nodes = cut(signed.join(classes, ["f1", "f2", "n"]).select(
        "key", "th", F.col("rep.key").alias("node"),
        F.when((F.col("key") == F.col("rep.key")) & (F.col("th") == F.col("rep.th")), F.col("trees")).alias("trees")))
    # Rows with one id are one node whatever their texts: their classes are linked through it.
    links = (nodes.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b").select("a", "b"))
    tree = nodes.where("trees is not null").dropDuplicates(["key", "th"]).withColumn(
        "t", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    item = lambda k: F.get("trees", 3 * F.col("t") + k)
    placed = cut(regions(tree.select(item(0).alias("p"), item(1).alias("q"), item(2).alias("r"), "key", "th"))
                 .withColumn("round", F.when(F.pmod(F.xxhash64("region"), F.lit(TREES)) < FIRST, 0).otherwise(1)))
    # Only texts of classes that share a region are read again.
    texts = cut(rows.where("id is not null").select("key", "th", "text")
                .join(placed.select("key", "th").distinct(), ["key", "th"]).dropDuplicates(["key", "th"]))
    comps = None
    for step in (0, 1):
        work = placed.where(F.col("round") == step)
        if comps is None:
            work = work.withColumn("comp", F.col("key"))
        else:  # regions whose classes are all connected by now need no further look
            work = work.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("component", "key"))
            mixed = work.groupBy("region").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("region")
            work = work.join(mixed, "region")
        ordered = (work.join(texts, ["key", "th"]).select("region", "large", "p", "q", "r", "key", "comp", "text")
                   .repartition("region").sortWithinPartitions("region", "p", "q", "r", "key"))
        found = ordered.select("region", "large", "comp", "text").mapInArrow(_confirm(size, percent), "a long, b long")
        links = links.unionByName(found) if comps is None else found.unionByName(
            comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
        comps = connected_components(links)
    more = _large_links(placed, comps, texts, size, percent)
    if more is not None:
        comps = connected_components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return _result(docs, rows, signed, nodes, comps, id_col, text_col, rec)


def _result(docs, rows, signed, nodes, comps, id_col, text_col, rec):
    own = nodes.select("key", "th", "node").dropDuplicates(["key", "th"])
    out = (signed.select("key", "th", F.col("n").cast("long").alias("n_shingles")).join(own, ["key", "th"], "left")
           .withColumn("node", F.coalesce("node", "key")).join(comps, "node", "left")
           .withColumn("component_id", F.coalesce("component", "node")))
    out = out.select("key", "th", "n_shingles", "component_id", (F.col("component_id") == F.col("key")).alias("kept"))
    if not rec:
        nulls = rows.where("id is null").select(
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n_shingles"),
            F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
        return out.select(F.col("key").alias("id"), "n_shingles", "component_id", "kept").unionByName(nulls)
    full = keyed(docs, id_col, text_col, rec=True)
    got = out.dropDuplicates(["key", "th"])
    return (full.join(got, ["key", "th"], "left")
            .select("id", "n_shingles", "component_id", F.coalesce("kept", F.lit(True)).alias("kept"), "text", "rec"))
