"""Best-fit packing: a grouping genetic algorithm on islands with elite migration.

Documents become token pieces of at most ``size`` ids (only longer documents are cut).  Full pieces are
sequences of their own.  The other pieces are dealt by hash into shards of about ``SHARD_ITEMS`` (so a shard's
work is bounded, whatever the input), and each shard is solved by ``ISLANDS`` islands, one Spark task group each:

* a chromosome is a packing, its genes are whole bins;
* crossover injects well-filled bins of one parent into another, drops the receiver's bins that hold any of the
  injected items, and puts displaced items back by best fit (largest first);
* after each epoch every island's elite migrates to the next island of its shard, as rows through a shuffle.

The best packing of each shard is kept.  Only item numbers and sizes travel, never texts or ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm.common import cut, prepare

SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CHILDREN = 10
SEPARATOR = 2
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: dict[int, int], items, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Add ``items`` (largest first) to ``bins``, each into the fullest bin that still takes it."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    bins = [list(b) for b in bins]
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        need = sizes[i]
        at = bisect_left(free, (need, -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > need:
            insort(free, (room - need, k))
    return bins


def _cost(bins, sizes, capacity) -> tuple[int, float]:
    """Fewer bins first; then uneven filling (full bins leave one loose bin to improve)."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def cross(receiver, donor, sizes, capacity, rng) -> list[list[int]]:
    """Inject a random half of the donor's best-filled bins into the receiver."""
    fill = [sum(sizes[i] for i in b) for b in donor]
    good = [b for b, f in zip(donor, fill) if f >= 0.98 * capacity] or donor
    pick = [good[k] for k in np.flatnonzero(rng.random(len(good)) < 0.5).tolist()] or good[:1]
    taken = {i for b in pick for i in b}
    stay = [b for b in receiver if taken.isdisjoint(b)]
    loose = [i for b in receiver if not taken.isdisjoint(b) for i in b if i not in taken]
    return best_fit(sizes, loose, [*pick, *stay], capacity)


def mutate(bins, sizes, capacity, rng) -> list[list[int]]:
    """Open the emptiest bins and a few random ones, and best-fit their items again."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    out = set(order[:max(2, len(bins) // 50)]) | set(rng.integers(0, len(bins), max(1, len(bins) // 50)).tolist())
    return best_fit(sizes, [i for k in out for i in bins[k]], [b for k, b in enumerate(bins) if k not in out], capacity)


def evolve(sizes: dict[int, int], start: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """One epoch of one island; ``start`` holds known packings (own elite and a migrant)."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes.values()) // capacity)
    pop = list(start) or [best_fit(sizes, sizes, [], capacity)]
    while len(pop) < POPULATION and min(map(len, pop)) > least:
        keep = [b for b in pop[0] if rng.random() < 0.5]
        held = {i for b in keep for i in b}
        pop.append(best_fit(sizes, [i for i in sizes if i not in held], keep, capacity))
    pop.sort(key=lambda p: _cost(p, sizes, capacity))
    for _ in range(CHILDREN):
        if len(pop[0]) <= least or len(pop) < 2:
            break
        a, b = rng.choice(min(len(pop), POPULATION), 2, replace=False).tolist()
        child = mutate(cross(pop[a], pop[b], sizes, capacity, rng), sizes, capacity, rng)
        pop = sorted([*pop, child], key=lambda p: _cost(p, sizes, capacity))[:POPULATION]
    return pop[0]


def _epoch(capacity: int, epoch: int):
    def run(key, table):
        import pyarrow as pa
        shard, island = (int(x.as_py()) for x in key)
        item, size = table.column("item").to_pylist(), table.column("length").to_pylist()
        sizes = dict(zip(item, size))
        known: dict[int, dict[int, list[int]]] = {}
        for i, s, b in zip(item, table.column("source").to_pylist(), table.column("bin").to_pylist()):
            if s is not None:
                known.setdefault(s, {}).setdefault(b, []).append(i)
        start = [[sorted(b) for _, b in sorted(k.items())] for _, k in sorted(known.items())]
        order = dict(sorted(sizes.items()))
        best = evolve(order, start, capacity, shard * 1_000_003 + island * 101 + epoch)
        n, fill = _cost(best, sizes, capacity)
        flat = [(i, k, sizes[i]) for k, b in enumerate(best) for i in b]
        return pa.table({"shard": pa.array([shard] * len(flat), pa.int32()), "source": pa.array([island] * len(flat), pa.int32()),
                         "item": pa.array([x[0] for x in flat], pa.int64()), "length": pa.array([x[2] for x in flat], pa.int64()),
                         "bin": pa.array([x[1] for x in flat], pa.int32()),
                         "cost": pa.array([n + fill / (len(best) + 1)] * len(flat), pa.float64())})
    return run


_STATE = "shard int, source int, item long, length long, bin int, cost double"


def pack_items(items: DataFrame, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``(item, bin, shard, offset)`` for ``items(item long unique, length long <= capacity)``."""
    n = items.count()
    shards = max(1, -(-n // SHARD_ITEMS))
    state = (items.select(F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), "item", "length",
                          F.lit(None).cast("int").alias("source"), F.lit(None).cast("int").alias("bin"))
             .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))))
    for epoch in range(epochs):
        solved = state.groupBy("shard", "island").applyInArrow(_epoch(capacity, epoch), _STATE)
        # Elite migration: each island meets its own elite and that of its neighbour.
        state = solved.withColumn("island", F.explode(F.array_distinct(F.array(
            F.col("source"), F.pmod(F.col("source") + 1, F.lit(islands)).cast("int")))))
    solved = cut(solved)
    best = solved.groupBy("shard").agg(F.min(F.struct("cost", "source")).alias("b")).select("shard", F.col("b.source").alias("source"))
    won = solved.join(best, ["shard", "source"])
    from pyspark.sql import Window
    w = Window.partitionBy("shard", "bin").orderBy(F.col("length").desc(), "item")
    return won.select("item", "shard", "bin", (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
                                               - F.col("length")).alias("offset"))


_ENCODERS: dict[str, object] = {}
_BY_RANK: dict[str, bool] = {}


def ranks_suffice(path: str) -> bool:
    """Whether merging by token rank equals the file's merge list.

    That holds when every token is the result of its own bytes and ids follow the order of the merges, as in
    trained vocabularies.  Checked once per application, on the driver.
    """
    if path not in _BY_RANK:
        from corpuspulse.llm.bpe import Vocabulary
        v = Vocabulary(path)
        made = [m for _, m in v.pair.values()]
        _BY_RANK[path] = len(v.own) == len(v.ids) and all(a < b for a, b in zip(made, made[1:]))
    return _BY_RANK[path]


def _encoder(path: str, by_rank: bool):
    """``text -> ids`` equal to the tokenizers library, built from its vocabulary file."""
    if path not in _ENCODERS:
        import json

        import tiktoken

        from corpuspulse.llm.bpe import PATTERN, byte_symbols, vocabulary
        if not by_rank:
            v = vocabulary(path)
            _ENCODERS[path] = lambda t: np.frombuffer(v.encode_batch([t])[0], "<i4").tolist()
            return _ENCODERS[path]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        byte = byte_symbols()
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = set(special)
        _ENCODERS[path] = lambda t: enc.encode(t, allowed_special=names) if any(s in t for s in names) else enc.encode_ordinary(t)
    return _ENCODERS[path]


def _cut(path: str, by_rank: bool, size: int, end: int):
    def run(batches):
        import pyarrow as pa
        encode = _encoder(path, by_rank)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end], "<u4").tobytes()
                n, at, piece = len(ids) // 4, 0, 0
                step = (n % size or size) if n > size else n  # the shorter piece comes first
                while at < n:
                    rows.append((i, piece, at, step, zlib.crc32(ids[4 * at:4 * (at + step)])))
                    at, piece, step = at + step, piece + 1, size
            c = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])],
                names=["id", "piece", "start", "length", "ids_crc32"])
    return run


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end: int = SEPARATOR,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is its ids followed by ``end``; one of more than ``size`` ids is cut so that all pieces but the
    first are full.  Pieces of a sequence lie gapless from offset 0.  A NULL or empty text is the one id
    ``end``; every row (also with a NULL or repeated id) is packed; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Written once: the numbering below must not change when a task is run again.
    pieces = cut(rows.mapInArrow(_cut(path, ranks_suffice(path), size, end), PIECES).withColumn("item", F.monotonically_increasing_id()))
    packed = pack_items(pieces.where(F.col("length") < size).select("item", "length"), size)
    # Packed sequences count up from 0 by (shard, bin); full pieces count down from -1.
    short = (pieces.where(F.col("length") < size).join(packed, "item")
             .withColumn("sequence_id", F.col("shard").cast("long") * (2 * SHARD_ITEMS * 1024) + F.col("bin")))
    full = pieces.where(F.col("length") >= size).withColumns(
        {"sequence_id": -F.col("item") - 1, "offset": F.lit(0).cast("long")})
    cols = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset")]
    return short.select(*cols).unionByName(full.select(*cols))
