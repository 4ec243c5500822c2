"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Every word covered by a window whose word sequence also starts in a document with a smaller id is removed.

How it scales.  Map tasks hash all windows of a bounded flush of documents (numpy over the Arrow buffers).
A window repeated inside the flush is settled there (pre-aggregation: only the occurrences of the flush's
smallest id travel on), so a passage found in a third of all documents sends one record per flush, not one
per document.  The rest is shipped as packed arrays, bucketed by the smallest 3-word hash inside the window
(its minimizer): neighbouring windows share a bucket, so positions and answers are runs, not single rows.
The number of buckets follows the bytes of the input.  Windows are counted per bucket first, and a bucket that a
frequent minimizer makes large is divided by the window hash (equal windows still meet), so no group grows with
the input.
Equality is that of a 56-bit window hash together with the independent bucket hash.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm import rolling as R
from corpuspulse.llm.common import keyed, prepare, text_bytes, with_rec

WINDOW_BASE = np.uint64(0xBF58476D1CE4E5B9)
GRAM_BASE = np.uint64(0x94D049BB133111EB)
HASH_BYTES = 7
FLUSH_WORDS = 1_000_000
PIECE_BYTES = 1_000_000
BUCKET_BYTES = 6_000_000
BUCKET_WINDOWS = 2_000_000
PACKED = "bucket int, docs binary, runs binary, hashes binary, done binary"


def _runs(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Start indexes of maximal runs of consecutive windows of one document (plus the end)."""
    new = np.ones(len(doc) + 1, bool)
    new[1:-1] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    return np.flatnonzero(new)


def _windows(hashes: np.ndarray, counts: np.ndarray, size: int, gram: int):
    """Per window: hash, minimizer, row and first word, for word hashes of consecutive texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return None
    left = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)[:n]
    start = np.arange(n)
    ok = start + size <= left[row + 1]
    start, row = start[ok], row[ok]
    if not len(start):
        return None
    pre = R.prefix(hashes, WINDOW_BASE)
    h = R.mix(R.spans(pre, start, start + size, WINDOW_BASE))
    g = R.prefix(hashes, GRAM_BASE)
    at = np.arange(len(hashes) - gram + 1)
    least = R.sliding_min(R.mix(R.spans(g, at, at + gram, GRAM_BASE)), size - gram + 1)[start]
    return h, least, row, start - left[row]


def _settle(keys, ths, parts, buckets: int, size: int):
    """One flush: settle repeats inside it; hash, bucket, document and position of the rest, and what was settled."""
    h = np.concatenate([p[0] for p in parts])
    bucket = ((np.concatenate([p[1] for p in parts]) >> np.uint64(11)) % np.uint64(buckets)).astype(np.int32)
    doc = np.concatenate([p[2] for p in parts]).astype(np.int32)
    pos = np.concatenate([p[3] for p in parts]).astype(np.int32)
    keys, ths = np.asarray(keys, np.int64), np.asarray(ths, np.int64)
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    owner = keys[doc[order]]
    least = np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.append(edge, len(h))))
    drop = np.zeros(len(h), bool)
    drop[order] = owner > least
    done = b""
    if drop.any():
        d, p = doc[drop], pos[drop]
        r = _runs(d, p)
        done = zlib.compress(np.stack([keys[d[r[:-1]]], ths[d[r[:-1]]], p[r[:-1]].astype(np.int64),
                                       p[r[1:] - 1].astype(np.int64) + size]).tobytes(), 1)
        keep = ~drop
        h, bucket, doc, pos = h[keep], bucket[keep], doc[keep], pos[keep]
    return keys, ths, h, bucket, doc, pos, done


def _sizes(keys, ths, parts, buckets: int, size: int):
    """Bucket and number of windows that a flush sends to it."""
    bucket, n = np.unique(_settle(keys, ths, parts, buckets, size)[3], return_counts=True)
    yield from zip(bucket.tolist(), n.tolist())


def _pack(keys, ths, parts, divide: np.ndarray, size: int):
    """One flush, packed by bucket; yields rows of ``PACKED``.  Bucket b is divided into ``divide[b]`` ones."""
    keys, ths, h, bucket, doc, pos, done = _settle(keys, ths, parts, len(divide), size)
    first = np.cumsum(divide) - divide
    bucket = first[bucket] + ((h >> np.uint64(8)) % divide[bucket].astype(np.uint64)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, h, doc, pos = bucket[order], h[order], doc[order], pos[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    for a, b in zip(edge, np.append(edge[1:], len(bucket))):
        r = _runs(doc[a:b], pos[a:b])
        d, idx = np.unique(doc[a:b][r[:-1]], return_inverse=True)
        runs = np.concatenate([idx.astype(np.int32).view(np.uint8), pos[a:b][r[:-1]].view(np.uint8),
                               np.diff(r).astype(np.int32).view(np.uint8)])
        raw = h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
        yield (int(bucket[a]), zlib.compress(np.stack([keys[d], ths[d]]).tobytes(), 1),
               zlib.compress(runs.tobytes(), 1), raw, None)
    if done:
        yield int(abs(int(ths[0])) % divide.sum()), None, None, None, done


def _map(size: int, gram: int, buckets: int, divide: np.ndarray | None = None):
    """Packed flushes, or without ``divide`` only the number of windows per bucket."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())] if divide is None else
                           [("bucket", pa.int32())] + [(c, pa.binary()) for c in ("docs", "runs", "hashes", "done")])

        def flush():
            if divide is None:
                got = list(_sizes(keys, ths, parts, buckets, size))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in got], schema=schema)
                return
            for row in _pack(keys, ths, parts, divide, size):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

        keys, ths, parts, held = [], [], [], 0
        for batch in batches:
            data, offsets = R.buffers(batch.column("text"))
            k, t = batch.column("key").to_numpy(zero_copy_only=False), batch.column("th").to_numpy(zero_copy_only=False)
            for a, b in R.pieces(offsets, PIECE_BYTES):
                off = offsets[a:b + 1] - offsets[a]
                got = _windows(*R.words(data[offsets[a]:offsets[b]], off), size, gram)
                if got is not None:
                    parts.append((got[0], got[1], got[2] + len(keys), got[3]))
                    held += len(got[0])
                keys.extend(k[a:b].tolist())
                ths.extend(t[a:b].tolist())
                if held >= FLUSH_WORDS:
                    yield from flush()
                    keys, ths, parts, held = [], [], [], 0
        if parts:
            yield from flush()
    return run


def _reduce(size: int):
    def run(table):
        """One bucket: windows whose hash also occurs under a smaller id, as word spans."""
        import pyarrow as pa
        hs, keys, ths, pos, out = [], [], [], [], []
        for docs, runs, raw, done in zip(*(table.column(c).to_pylist() for c in ("docs", "runs", "hashes", "done"))):
            if done is not None:
                out.append(np.frombuffer(zlib.decompress(done), np.int64).reshape(4, -1))
                continue
            d = np.frombuffer(zlib.decompress(docs), np.int64).reshape(2, -1)
            idx, start, length = np.frombuffer(zlib.decompress(runs), np.int32).reshape(3, -1)
            wide = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
            wide[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
            hs.append(wide.reshape(-1).view("<u8"))
            row = np.repeat(np.arange(len(idx)), length)
            first = np.cumsum(length) - length
            pos.append(start[row] + (np.arange(len(row)) - first[row]))
            keys.append(d[0][idx][row])
            ths.append(d[1][idx][row])
        if hs:
            h, key, th, at = (np.concatenate(x) for x in (hs, keys, ths, pos))
            order = np.argsort(h, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            own = key[order]
            least = np.repeat(np.minimum.reduceat(own, edge), np.diff(np.append(edge, len(h))))
            drop = np.zeros(len(h), bool)
            drop[order] = own > least
            key, th, at = key[drop], th[drop], at[drop]
            if len(key):
                new = np.ones(len(key) + 1, bool)
                new[1:-1] = (key[1:] != key[:-1]) | (th[1:] != th[:-1]) | (at[1:] != at[:-1] + 1)
                r = np.flatnonzero(new)
                out.append(np.stack([key[r[:-1]], th[r[:-1]], at[r[:-1]], at[r[1:] - 1] + size]).astype(np.int64))
        got = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pa.table({"key": got[0], "th": got[1], "s": got[2].astype(np.int32), "e": got[3].astype(np.int32)})
    return run


def packed_windows(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """All windows as rows of ``PACKED``, about ``BUCKET_WINDOWS`` to a bucket at most."""
    buckets = max(8, -(-text_bytes(docs, text_col) // BUCKET_BYTES))
    rows = keyed(docs, id_col, text_col).where(F.col("text").isNotNull()).select("key", "th", "text")
    divide = np.ones(buckets, np.int64)
    hot = (rows.mapInArrow(_map(size, min(3, size), buckets), "bucket int, n long").groupBy("bucket")
           .agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET_WINDOWS))
    for r in hot.collect():  # at most ``buckets`` rows
        divide[r["bucket"]] = -(-r["n"] // BUCKET_WINDOWS)
    return rows.mapInArrow(_map(size, min(3, size), buckets, divide), PACKED)


def repeated_spans(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word spans ``(key, th, s, e)`` covered by windows that also start in a document with a smaller id."""
    prepare(docs.sparkSession)
    return packed_windows(docs, size, id_col, text_col).groupBy("bucket").applyInArrow(_reduce(size), "key long, th long, s int, e int")


def _cut_words(batches):
    import pyarrow as pa
    for batch in batches:
        n_words, n_removed, kept, spans = [], [], [], []
        for text, got in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            words = (text or "").encode().split()
            n_words.append(len(words))
            if not got:
                n_removed.append(0)
                kept.append(b" ".join(words))
                spans.append([])
                continue
            step = np.zeros(len(words) + 1, np.int32)
            np.add.at(step, [x["s"] for x in got], 1)
            np.add.at(step, [x["e"] for x in got], -1)
            gone = np.cumsum(step)[:-1] > 0
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans.append([{"s": int(a), "e": int(b)} for a, b in turn.reshape(-1, 2)])
        span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span), batch.column("rec")],
            names=["id", "text", "n_words", "n_removed", "kept_text", "spans", "rec"])


def dedup_windows(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_words, n_removed, kept_text, spans, rec)`` per row of ``docs``.

    Words are runs of non-white-space (``[^\\x20\\x09-\\x0D]+``).  ``spans`` are the maximal removed word
    intervals ``[s, e)``, ``kept_text`` the kept words joined by one space, ``rec`` the further columns.
    Defined cases: a NULL or empty text has no words and keeps ``''``; a text shorter than ``size`` words
    loses nothing; rows with the same id never remove each other's words; a NULL id counts as larger than
    every id; an empty table gives an empty result.
    """
    found = (repeated_spans(docs, size, id_col, text_col).groupBy("key", "th")
             .agg(F.collect_list(F.struct("s", "e")).alias("found")))
    rows = keyed(docs, id_col, text_col, rec=True)
    joined = rows.join(found, ["key", "th"], "left").select("id", "text", "found", "rec")
    return joined.mapInArrow(_cut_words, with_rec(
        "id long, text string, n_words long, n_removed long, kept_text string, spans array<struct<s:int,e:int>>", joined))
