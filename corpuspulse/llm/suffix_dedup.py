"""Suffix-array dedup: every byte covered by a ``size``-byte string that occurs elsewhere is removed.

Method: column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.  Each round
takes one symbol of every string (right to left), finds where the lengthened suffix belongs by counting that
symbol in the transform so far, inserts it, and derives its common prefix with both neighbours from the range
minima above its parent.  After the last round, neighbouring suffixes with a common prefix of ``size`` are the
repeated strings.

To run it over a cluster, the collection is cut so that equal windows always meet in one bounded block:

1. Every window of ``size`` bytes belongs to its minimizer (smallest hash of its ``GRAM``-byte parts).  Runs of
   windows with one minimizer form a string of run + size - 1 bytes.  Only hashes and places of runs are kept.
2. A minimizer met once (and not twice inside its own string) cannot repeat: counted in Spark, dropped here.
3. Remaining strings are cut out of the texts.  Of one minimizer's strings, only those are compared that share a
   stretch around it with another one, as two strings with a common window must.  Equal strings are settled where they meet: inside a task's flush
   at once (a passage found in a third of all documents sends one row per flush), and again per bucket.
   A minimizer with very many strings is divided by its windows' minimizers under further hash orders.
4. Buckets follow the bytes to compare; the transform is built per block of about ``BLOCK_BYTES``.

Blocks are bounded, so the per-round files of the method are sequentially rewritten arrays in memory; the tables
between the steps are the external files.  Minimizers only route: equality is decided on the bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm import rolling as R
from corpuspulse.llm.common import cut, keyed, prepare, with_rec

GRAM = 32
PIECE_BYTES = 1_000_000
FLUSH_BYTES = 4_000_000
BUCKET_BYTES = 3_000_000
BLOCK_BYTES = 130_000
HOT = 2_000
U = np.uint64
ORDERS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 32, dtype=np.uint64) * U(2) + U(1)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    at = np.arange(len(data) - gram + 1)
    return R.mix(R.spans(R.prefix(R.BYTE_CODE[data], R.BASE), at, at + gram, R.BASE))


def _least(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of ``width`` values the smallest (without its low bits), and its first place."""
    bits = max(1, int(len(g)).bit_length())
    low = (U(1) << U(bits)) - U(1)
    got = R.sliding_min((g & ~low) | np.arange(len(g), dtype=U), width)
    return got & ~low, (got & low).view(np.int64)


def window_runs(data: np.ndarray, offsets: np.ndarray, size: int, gram: int = GRAM):
    """Runs of windows with one minimizer: text number, first window, length, hash, and place in the string."""
    if len(data) < size:
        return None
    g = _grams(data, gram)
    width = size - gram + 1
    value, first = _least(g, width)
    ok = np.zeros(len(first), bool)  # windows that lie within one text
    new = np.zeros(len(first), bool)
    new[1:] = value[1:] != value[:-1]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            ok[a:b - size + 1] = True
            new[a] = True
    begin = np.flatnonzero(new & ok)
    if not len(begin):
        return None
    # A run ends at the next one, or where its text has no further window.
    row = np.searchsorted(offsets, begin, side="right") - 1
    length = np.minimum(np.append(begin[1:], len(first)), offsets[row + 1] - size + 1) - begin
    most = max(width, 100)  # one minimizer serves at most ``width`` windows, so longer runs are periodic text: cut
    if (length > most).any():
        parts = -(-length // most)
        extra = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, row = np.repeat(begin, parts) + extra * most, np.repeat(row, parts)
        length = np.minimum(np.repeat(length, parts) - extra * most, most)
    # Place of the minimizer in its string; -1 where the windows of the string differ in it (equal windows of one
    # string would, as their minimizers lie as far apart as they do).
    final = first[begin + length - 1]
    place = np.where(first[begin] == final, final - begin, -1)
    return row, begin - offsets[row], length, g[first[begin]], place


def _map_runs(size: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            data, offsets = R.buffers(batch.column("text"))
            key, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th"))
            for a, b in R.pieces(offsets, PIECE_BYTES):
                off = offsets[a:b + 1] - offsets[a]
                got = window_runs(data[offsets[a]:offsets[b]], off, size, min(GRAM, size))
                row, s, n, h, place = got if got is not None else (np.zeros(0, np.int64),) * 5
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                pick = lambda x, t: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(t)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a:b]), pa.array(th[a:b]), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))),
                     # start, length and place of a run in one number
                     pick((s.astype(np.int64) << 24) | (n.astype(np.int64) << 12) | (place.astype(np.int64) + 1), np.int64)],
                    names=["key", "th", "h", "x"])
    return run


def _divide(raw: np.ndarray, size: int, gram: int, level: int):
    """Cut a hot minimizer's string where its windows' minimizers under ``level`` further orders change."""
    g = _grams(raw, gram)
    n = len(raw) - size + 1
    tag = np.zeros(n, U)
    for j in range(level):
        tag = R.mix(tag * U(0x9E3779B97F4A7C15) + R.sliding_min(g * ORDERS[j], size - gram + 1)[:n])
    cut_at = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
    return [(int(a), int(b), int(tag[a].view(np.int64))) for a, b in zip(cut_at, [*cut_at[1:], n])]


def _strings(size: int, buckets: int):
    def run(batches):
        """Cut out the candidate strings; settle the ones that occur again in the same flush."""
        import pyarrow as pa
        schema = pa.schema([("bucket", pa.int32()), ("m", pa.int64()), ("text", pa.binary()), ("mid", pa.int32()),
                            ("weight", pa.int32()), ("key", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("done", pa.binary())])
        held: dict[tuple[int, bytes], list] = {}
        volume = 0

        def flush():
            rows, done = [], []
            for (m, raw), (mid, places) in held.items():
                only = places[0] if len(places) == 1 else None
                if only is None:
                    done += [(k, t, at, at + len(raw)) for k, t, at in places]
                k, t, at = only or (None, None, None)
                rows.append((m % buckets, m, raw, mid, min(2, len(places)), k, t, at, None))
            if done:
                blob = zlib.compress(np.array(done, np.int64).T.tobytes(), 1)
                rows.append((abs(done[0][1]) % buckets, *[None] * 7, blob))
            for a in range(0, len(rows), 5_000):
                c = list(zip(*rows[a:a + 5_000]))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(c, schema)], schema=schema)

        for batch in batches:
            for key, th, text, found in zip(*(batch.column(c).to_pylist() for c in ("key", "th", "text", "found"))):
                raw = text.encode()
                for x in found:
                    s, n, mid, m = x["x"] >> 24, (x["x"] >> 12) & 4095, (x["x"] & 4095) - 1, x["h"]
                    piece = raw[s:s + n + size - 1]
                    cuts = [(0, n, m)] if not x["level"] else _divide(
                        np.frombuffer(piece, np.uint8), size, min(GRAM, size), x["level"])
                    for a, b, tag in cuts:
                        at = (m ^ tag) if x["level"] else m
                        held.setdefault((at, piece[a:b + size - 1]), (mid - a if mid >= 0 else -1, []))[1].append((key, th, s + a))
                        volume += b - a + size + 200
                    if volume > FLUSH_BYTES:
                        yield from flush()
                        held.clear()
                        volume = 0
        if held:
            yield from flush()
    return run


def transform(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (compact codes, 0 = start of a string), common prefixes (at most ``size``) of
    neighbouring suffixes, and the place each suffix moves to when its preceding symbol is put in front."""
    m = len(strings)
    lengths = np.array([len(s) for s in strings])
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.unique(flat)
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    flat = code[flat]
    last = np.cumsum(lengths) - 1
    kind = np.uint8 if size < 255 else np.uint16
    bwt, lcp = np.zeros(m, np.uint8), np.zeros(m + 1, kind)  # the empty suffixes, in string order
    order = np.zeros(0, np.int32)  # places of all known symbols, by symbol and place
    first = np.zeros(len(used) + 2, np.int64)  # where each symbol's places begin in ``order``
    place, active = np.arange(m), np.arange(m)
    for j in range(int(lengths.max())):
        going = lengths[active] > j
        active, place = active[going], place[going]
        c = flat[last[active] - j]
        by = np.lexsort((place, c))
        place, active, c = place[by], active[by], c[by]
        bwt[place] = c  # the symbol before each newest suffix is known now
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
        at = np.empty(len(c), np.int64)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            k = int(c[x])
            at[x:y] = first[k] + np.searchsorted(order[first[k]:first[k + 1]], place[x:y])
        order = np.insert(order, at, place)
        first[1:] += np.cumsum(np.bincount(c, minlength=len(first) - 1))[:len(first) - 1]
        rank = at + np.arange(len(c))  # symbols sort the lengthened suffixes: this is their order
        target = rank + m  # the m empty suffixes stay in front
        # Neighbours in the new symbol's range: previous and next place that holds the same symbol.
        n = len(bwt)
        prev = order[np.maximum(rank - 1, 0)]
        has_prev = (rank > 0) & (bwt[prev] == c)
        nxt = order[np.minimum(rank + 1, len(order) - 1)]
        has_next = (rank < len(order) - 1) & (bwt[nxt] == c)
        above, below = np.zeros(len(c), kind), np.zeros(len(c), kind)
        for got, ok, lo, hi in ((above, has_prev, prev, place), (below, has_next, place, nxt)):
            if ok.any():
                pair = np.empty(2 * int(ok.sum()), np.int64)
                pair[::2], pair[1::2] = lo[ok] + 1, hi[ok] + 1
                low = np.minimum.reduceat(lcp, pair)[::2]
                got[ok] = np.minimum(low, size - 1) + 1
        at_old = target - np.arange(len(c))  # where the new suffixes go, in places before the insertion
        keep = np.ones(n + len(c), bool)
        keep[target] = False
        new_bwt, new_lcp = np.zeros(n + len(c), np.uint8), np.zeros(n + len(c) + 1, kind)
        new_bwt[keep] = bwt
        new_lcp[:-1][keep] = lcp[:-1]
        follow = has_next & np.append(target[1:] != target[:-1] + 1, True)  # the next one is not new itself
        new_lcp[target[follow] + 1] = below[follow]
        new_lcp[target] = above
        gaps = np.diff(at_old, prepend=0, append=n)
        order += np.repeat(np.arange(len(c) + 1, dtype=np.int32), gaps)[order]  # places after the insertion
        bwt, lcp, place = new_bwt, new_lcp, target
    move = np.zeros(len(bwt), np.int64)
    move[order] = np.arange(len(order)) + m
    return bwt, lcp, move


def repeated_starts(strings: list[bytes], size: int) -> list[np.ndarray]:
    """Offsets in each string at which a ``size``-byte string starts that starts elsewhere in the collection too."""
    bwt, lcp, move = transform(strings, size)
    twice = (lcp[:-1] >= size) | (lcp[1:] >= size)
    lengths = np.array([len(s) for s in strings])
    out: list[list[int]] = [[] for _ in strings]
    place, active = np.arange(len(strings)), np.arange(len(strings))
    for j in range(1, int(lengths.max()) + 1):
        going = lengths[active] >= j
        active, place = active[going], move[place[going]]
        if j >= size:
            for i in active[twice[place]].tolist():
                out[i].append(len(strings[i]) - j)
    return [np.array(x[::-1], np.int64) for x in out]


def _related(group: dict[bytes, list], size: int, gram: int, step: int = 24) -> dict[bytes, list[tuple[int, int]]]:
    """Ranges of windows in which a string may share a window with another one of its group (none is missed).

    A window holds the minimizer and ``size - gram`` further bytes, some left of it and some right.  Rounding the
    left part down to a multiple of ``step`` leaves a stretch around the minimizer that both strings must share.
    """
    if any(x[0] < 0 for x in group.values()):
        # A minimizer that stands twice in a string has no one place to compare at.
        return {raw: [(0, len(raw) - size + 1)] for raw in group}
    spare = size - gram
    seen: dict[tuple[int, bytes], bytes] = {}
    shared: dict[bytes, set[int]] = {}
    for raw, x in group.items():
        for left in range(0, spare + 1, step):
            right = max(0, spare - left - step + 1)
            a, b = x[0] - left, x[0] + gram + right
            if a >= 0 and b <= len(raw):
                other = seen.setdefault((left, raw[a:b]), raw)
                if other is not raw:
                    shared.setdefault(raw, set()).add(left)
                    shared.setdefault(other, set()).add(left)
    out = {}
    for raw, lefts in shared.items():
        ranges: list[tuple[int, int]] = []
        for left in sorted(lefts, reverse=True):
            a = max(0, group[raw][0] - left - step + 1)
            b = min(len(raw) - size, group[raw][0] - left) + 1
            if a < b:
                if ranges and ranges[-1][1] >= a:
                    ranges[-1] = (ranges[-1][0], b)
                else:
                    ranges.append((a, b))
        if ranges:
            out[raw] = ranges
    return out


def _compare(size: int):
    def run(table):
        """One bucket: which windows of its strings occur twice, as byte spans of their documents."""
        import pyarrow as pa
        groups: dict[int, dict[bytes, list]] = {}
        out = []
        for m, text, mid, weight, key, th, at, done in zip(*(table.column(c).to_pylist() for c in ("m", "text", "mid", "weight", "key", "th", "at", "done"))):
            if done is not None:
                out.append(np.frombuffer(zlib.decompress(done), np.int64).reshape(4, -1))
                continue
            got = groups.setdefault(m, {}).setdefault(text, [mid, 0, []])
            got[1] += weight
            if key is not None:
                got[2].append((key, th, at))
        block, held, spans = [], 0, []

        def solve():
            for (raw, places), starts in zip(block, repeated_starts([raw for raw, _ in block], size)):
                if len(starts) and places:
                    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > size, [True]]))
                    for a, b in zip(new[:-1], new[1:]):
                        spans.extend((k, t, at + int(starts[a]), at + int(starts[b - 1]) + size) for k, t, at in places)

        todo = []
        for group in groups.values():
            # A string met twice is repeated as a whole; it stays in the comparison for the sake of the others.
            for raw, (_, weight, places) in group.items():
                if weight >= 2:
                    spans.extend((k, t, at, at + len(raw)) for k, t, at in places)
            if all(x[1] >= 2 for x in group.values()):
                continue
            near = _related(group, size, min(GRAM, size))
            if any(group[raw][1] < 2 for raw in near):
                parts = []
                for raw, ranges in near.items():
                    places = group[raw][2] if group[raw][1] < 2 else []
                    parts += [(raw[a:b + size - 1], [(k, t, at + a) for k, t, at in places]) for a, b in ranges]
                todo.append((max(len(raw) for raw, _ in parts), len(todo), parts))
        # A round of the transform rewrites its whole block and a block has as many rounds as its longest string:
        # groups of like length share blocks.
        for _, _, parts in sorted(todo):
            block += parts
            held += sum(len(raw) + 1 for raw, _ in parts)
            if held >= BLOCK_BYTES:
                solve()
                block.clear()
                held = 0
        if block:
            solve()
        if spans:
            out.append(np.array(spans, np.int64).T)
        got = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pa.table({"key": got[0], "th": got[1], "s": got[2], "e": got[3]})
    return run


def _cut_bytes(batches):
    import pyarrow as pa
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for batch in batches:
        n, gone, spans, kept = [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            raw = (text or "").encode()
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            left, parts = 0, []
            for s, e in merged:
                parts.append(raw[left:s])
                left = e
            rest = b"".join([*parts, raw[left:]])
            n.append(len(raw))
            gone.append(len(raw) - len(rest))
            spans.append([{"s": s, "e": e} for s, e in merged])
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span),
                                          pa.array(kept, pa.binary()), batch.column("rec")],
                                         names=["id", "n_bytes", "n_removed", "spans", "kept", "rec"])


def dedup_bytes(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept, rec)`` per row of ``docs``.

    ``spans`` are the maximal removed byte intervals ``[s, e)``, ``kept`` the remaining bytes, ``rec`` the further
    columns.  Defined cases: NULL text counts as empty; a text shorter than ``size`` bytes loses nothing; rows
    repeating a whole text of at least ``size`` bytes all lose it (also rows with equal or NULL ids); matches
    never cross rows; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    runs = cut(rows.where(F.octet_length("text") >= size).select("key", "th", "text").mapInArrow(
        _map_runs(size), "key long, th long, h array<bigint>, x array<bigint>"))
    flat = runs.select("key", "th", F.explode(F.arrays_zip("h", "x")).alias("r")).select(
        "key", "th", F.col("r.h").alias("h"), F.col("r.x").alias("x"))
    # A minimizer that stands twice in one string (place 0 in the packed number) may repeat on its own.
    often = (flat.groupBy("h").agg(F.sum(F.when(F.col("x") % 4096 == 0, 2).otherwise(1)).alias("c")).where("c > 1")
             .select("h", F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / HOT))).cast("int").alias("level")))
    found = cut(flat.join(often, "h").groupBy("key", "th").agg(F.collect_list(F.struct("x", "h", "level")).alias("found")))
    length = lambda x: F.shiftright(x["x"], 12).bitwiseAND(F.lit(4095).cast("long"))
    volume = found.agg(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + length(x) + size))).first()[0] or 0
    buckets = max(8, -(-int(volume) // BUCKET_BYTES))
    texts = keyed(docs, id_col, text_col, rec=True)
    # All columns of ``texts`` pass here, so that its shuffle is the one the last join uses again.
    strings = (texts.join(found, ["key", "th"]).select("key", "th", "text", "found", "id", "rec")
               .mapInArrow(_strings(size, buckets), "bucket int, m long, text binary, mid int, weight int, key long, th long, "
                                                    "at int, done binary"))
    spans = strings.groupBy("bucket").applyInArrow(_compare(size), "key long, th long, s long, e long")
    gone = spans.groupBy("key", "th").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    joined = texts.join(gone, ["key", "th"], "left").select("id", "text", "found", "rec")
    return joined.mapInArrow(_cut_bytes, with_rec(
        "id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary", joined))
