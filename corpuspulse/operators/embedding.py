"""M1, a text encoder that learns from the corpus: co-occurrence counts, positive mutual information, randomised SVD.

Counting is one scan: every token looks at the next ``window`` tokens, pairs of vocabulary words are summed in the tasks
(numpy over Arrow batches), and what is shuffled is distinct pairs, each in one order.  The matrix of positive pointwise mutual information has a sparse row per vocabulary
word; a product with a thin matrix is one narrow pass over these rows with the thin matrix as a parameter.  Its size
(``MAX_WORDS`` times the vector length) is fixed by parameters, never by the corpus, and so is all that the driver holds.
A text's vector is the mean of its words' vectors weighted by ``a / (a + share of the word)``, free of the direction that
all texts have in common, and of unit length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.operators.vectors import partial_sums
from corpuspulse.session import ship_package

TOKEN = r"[\p{L}\p{N}]+"
MAX_WORDS = 50_000
WINDOW = 4
RARE = 1e-3
TOKENS_AT_ONCE = 65_536   # tokens that a task turns into vectors at a time
PAIRS_HELD = 1 << 22      # pairs that a task gathers before it sums them, and sums that it holds before it hands them on


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script; NULL for NULL."""
    return F.regexp_extract_all(F.lower(text.cast("string")), F.lit(TOKEN), F.lit(0))


def vocabulary(df: DataFrame, col: str = "text", size: int = 20_000, least: int = 2) -> DataFrame:
    """``(idx, word, n)``: the ``size`` most frequent words with at least ``least`` uses (ties: the word), numbered from 0."""
    if size > MAX_WORDS:
        raise ValueError(f"a vocabulary of {size} words; at most {MAX_WORDS} are supported")
    counts = df.select(F.explode(word_tokens(F.col(col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size)
    return top.select((F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).alias("idx"), "word", "n")


def _hashed(text: Column) -> Column:
    return F.transform(word_tokens(text), lambda t: F.xxhash64(t))


def cooccurrence(df: DataFrame, words: DataFrame, col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(i, j, n)``: how often vocabulary words ``i`` and ``j`` stand at most ``window`` tokens apart, in both orders.

    Words outside the vocabulary keep their places.  Tokens meet the vocabulary (at most ``MAX_WORDS`` rows, sent with the
    tasks) by a 64-bit hash.  A task counts pairs without their order and hands on each once for every ``PAIRS_HELD`` it has
    met; the shuffle sums them, and the two orders are made from the sums.
    """
    import numpy as np
    ship_package(df.sparkSession)
    got = sorted(words.select(F.xxhash64("word").alias("h"), "idx").collect(), key=lambda r: r["h"])
    hashes, idx = np.array([r["h"] for r in got], dtype=np.int64), np.array([r["idx"] for r in got], dtype=np.int64)
    size = int(idx.max()) + 1 if len(idx) else 1

    def summed(codes, n):
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[first], np.add.reduceat(n, first)

    def near(batch):
        """Codes of the pairs of a batch, in parts."""
        column = batch.column("tokens")
        flat, lengths = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), lengths)
        for a in range(0, len(flat), TOKENS_AT_ONCE):
            h, r = flat[a:a + TOKENS_AT_ONCE + window], row[a:a + TOKENS_AT_ONCE + window]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            at = np.where(hashes[at] == h, idx[at], -1)
            for o in range(1, window + 1):
                m = min(TOKENS_AT_ONCE, len(h) - o)
                if m > 0:
                    x, y = at[:m], at[o:m + o]
                    ok = (x >= 0) & (y >= 0) & (r[:m] == r[o:m + o])
                    x, y = x[ok], y[ok]
                    yield np.minimum(x, y) * size + np.maximum(x, y)

    def run(batches):
        import pyarrow as pa
        if not len(hashes):
            return
        kept, fresh, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged():
            codes, n = np.unique(np.concatenate(fresh), return_counts=True)
            return summed(np.concatenate([kept[0], codes]), np.concatenate([kept[1], n])) if len(kept[0]) else (codes, n)

        def out():
            for a in range(0, len(kept[0]), TOKENS_AT_ONCE):
                codes, n = kept[0][a:a + TOKENS_AT_ONCE], kept[1][a:a + TOKENS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(codes // size, pa.int32()), pa.array(codes % size, pa.int32()), pa.array(n, pa.int64())],
                                                 names=["i", "j", "n"])
        for batch in batches:
            for codes in near(batch):
                fresh.append(codes)
                waiting += len(codes)
                if waiting >= PAIRS_HELD:
                    kept, fresh, waiting = merged(), [], 0
                    if len(kept[0]) >= PAIRS_HELD:
                        yield from out()
                        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if waiting:
            kept = merged()
        yield from out()

    tokens = df.select(_hashed(F.col(col)).alias("tokens")).where("tokens is not null")
    pairs = tokens.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    cell = lambda i, j, n: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), n.alias("n"))
    n = F.col("n")
    return pairs.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(cell("i", "j", n * 2)))
                                 .otherwise(F.array(cell("i", "j", n), cell("j", "i", n)))))


def ppmi(counts: DataFrame) -> DataFrame:
    """``(i, j, v)``: positive pointwise mutual information (natural logarithm) of co-occurrence counts."""
    of = counts.groupBy("i").agg(F.sum("n").alias("ni"))
    total = counts.agg(F.sum("n").alias("t"))
    met = counts.join(F.broadcast(of), "i").join(F.broadcast(of.select(F.col("i").alias("j"), F.col("ni").alias("nj"))), "j")
    v = F.log(F.col("n").cast("double") * total.scalar().cast("double") / (F.col("ni").cast("double") * F.col("nj")))
    return met.select("i", "j", v.alias("v")).where("v > 0")


def sparse_rows(cells: DataFrame) -> DataFrame:
    """``(i, js, vs)``: one row per word, its cells sorted (at most as many as there are words)."""
    row = F.sort_array(F.collect_list(F.struct("j", "v")))
    return cells.groupBy("i").agg(row.alias("r")).select("i", F.col("r")["j"].alias("js"), F.col("r")["v"].alias("vs"))


def times(rows: DataFrame, thin) -> DataFrame:
    """``(i, y array<double>)``: the sparse rows times a thin matrix (vocabulary x columns), one narrow pass."""
    ship_package(rows.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            js, vs = batch.column("js"), batch.column("vs")
            ends = np.append(0, np.cumsum(np.diff(js.offsets.to_numpy())))
            j, v = js.flatten().to_numpy(), vs.flatten().to_numpy()
            out = np.zeros((batch.num_rows, thin.shape[1]))
            for r in range(batch.num_rows):
                s = slice(ends[r], ends[r + 1])
                out[r] = v[s] @ thin[j[s]]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.ListArray.from_arrays(
                pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))], names=["i", "y"])

    return rows.mapInArrow(run, "i int, y array<double>")


def _product(rows: DataFrame, thin):
    import numpy as np
    out = np.zeros_like(thin)
    for r in times(rows, thin).collect():
        out[r["i"]] = r["y"]
    return out


def word_vectors(rows: DataFrame, words: int, dim: int = 64, seed: int = 42, rounds: int = 2, more: int = 8):
    """Word vectors (words x dim): left singular vectors times the root of the singular values, by randomised SVD.

    A random thin matrix is multiplied ``rounds + 1`` times and made orthonormal in between; one further product gives the
    small core.  The sign of a column is fixed by its entry of largest size.
    """
    import numpy as np
    width = min(dim + more, words)
    if not words:
        return np.zeros((0, dim))
    q = np.random.default_rng(seed).standard_normal((words, width))
    for _ in range(rounds + 1):
        q = np.linalg.qr(_product(rows, q))[0]
    core = q.T @ _product(rows, q)
    w, u = np.linalg.eigh((core + core.T) / 2)
    order = np.argsort(-np.abs(w), kind="stable")[:dim]
    out = (q @ u[:, order]) * np.sqrt(np.abs(w[order]))
    sign = np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    out = out * np.where(sign == 0, 1, sign)
    return np.pad(out, ((0, 0), (0, dim - out.shape[1])))


@dataclass
class Encoder:
    """Word hashes (ascending), their weights and vectors, and the direction texts have in common."""

    hashes: object
    weights: object
    vectors: object
    common: object = None


def encoder(words: DataFrame, vectors, rare: float = RARE) -> Encoder:
    """An encoder from given word vectors (in the order of ``idx``): weights follow the words' shares of all uses."""
    import numpy as np
    got = sorted(words.select("idx", F.xxhash64("word").alias("h"), "n").collect(), key=lambda r: r["h"])
    n = np.array([r["n"] for r in got], dtype=float)
    idx = np.array([r["idx"] for r in got], dtype=np.int64)
    return Encoder(np.array([r["h"] for r in got], dtype=np.int64), rare / (rare + n / max(n.sum(), 1)), np.asarray(vectors, dtype=float)[idx])


def _sums(batch, model: Encoder):
    """Weighted sums of the word vectors of every row of ``(tokens)`` and the number of known tokens."""
    import numpy as np
    column = batch.column("tokens")
    out, known = np.zeros((batch.num_rows, model.vectors.shape[1])), np.zeros(batch.num_rows)
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), lengths)
    if not len(model.hashes):
        return out, known
    for a in range(0, len(flat), TOKENS_AT_ONCE):
        h, r = flat[a:a + TOKENS_AT_ONCE], row[a:a + TOKENS_AT_ONCE]
        at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
        ok = model.hashes[at] == h
        at, r = at[ok], r[ok]
        if len(r):
            first = np.flatnonzero(np.append(True, np.diff(r) > 0))
            out[r[first]] += np.add.reduceat(model.vectors[at] * model.weights[at][:, None], first, axis=0)
            known += np.bincount(r, minlength=batch.num_rows)
    return out / np.maximum(known, 1)[:, None], known


def encode(df: DataFrame, model: Encoder, col: str = "text", id_col: str = "doc_id", out: str = "embedding", unit: bool = True) -> DataFrame:
    """``(id, out array<float or double>)``: text vectors, one narrow pass.

    A NULL text gives NULL, a text without known words zeros.  With ``unit`` vectors have length 1 (float), without it
    they are the weighted means themselves (double).
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _known = _sums(batch, model)
            whole = np.linalg.norm(x, axis=1)
            if model.common is not None:
                x = x - (x @ model.common)[:, None] * model.common[None, :]
            if unit:  # what is nothing but the common direction becomes zeros, not rounding noise
                size = np.linalg.norm(x, axis=1)
                real = size > 1e-9 * whole
                x = np.where(real[:, None], x / np.where(real, size, 1)[:, None], 0).astype(np.float32)
            valid = batch.column("tokens").is_valid().to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(np.where(valid, x.shape[1], 0)))
            starts = pa.array(offsets, pa.int32(), mask=np.append(~valid, False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(starts, pa.array(x[valid].ravel()))], names=["id", out])

    rows = df.select(F.col(id_col).alias("id"), _hashed(F.col(col)).alias("tokens"))
    return rows.mapInArrow(run, f"id {kind}, {out} array<{'float' if unit else 'double'}>").withColumnRenamed("id", id_col)


def fit_encoder(df: DataFrame, col: str = "text", dim: int = 64, size: int = 20_000, least: int = 2, window: int = WINDOW,
                seed: int = 42, rare: float = RARE) -> Encoder:
    """Learn an encoder from all texts of ``df``: three scans (words, pairs, the common direction), the rest over the vocabulary."""
    import numpy as np
    ship_package(df.sparkSession)
    words = vocabulary(df, col, size, least).persist()
    rows = sparse_rows(ppmi(cooccurrence(df, words, col, window).persist())).persist()
    try:
        model = encoder(words, word_vectors(rows, words.count(), dim, seed), rare)
    finally:
        rows.unpersist()
        words.unpersist()

    def outer(batches):
        total = np.zeros(dim * dim)
        for batch in batches:
            if batch.num_rows:
                x = _sums(batch, model)[0]
                x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                total += (x.T @ x).ravel()
        return {0: total}
    spread = partial_sums(df.select(_hashed(F.col(col)).alias("tokens")).where("tokens is not null"), outer, dim * dim).get(0)
    if spread is not None and spread.any():
        model.common = np.linalg.eigh(spread.reshape(dim, dim))[1][:, -1]
    return model


def embed_learned(df: DataFrame, col: str = "text", dim: int = 64, id_col: str = "doc_id", out: str = "embedding", **more) -> DataFrame:
    """M1: every text's vector by an encoder learned from the same texts."""
    return encode(df, fit_encoder(df, col, dim, **more), col, id_col, out)
