"""J3 for any number of phrases: every phrase is found through its rarest gram.

A gram is seven bytes, as many as a number holds beside its length (a shorter phrase is its own gram), or ten bytes hashed to
a number where a phrase has as many.  How often grams occur is guessed from the openings of a few texts, and how many phrases
share them from those of a batch, which decides nothing but speed.  Each phrase is keyed by its rarest gram.  The texts are
read once, and a bit filter over the keys drops nearly every place.

Phrases of up to ``CARRIED_BYTES`` travel to the tasks in pieces of ``PIECE_BYTES``, of which a task holds one at a time: the
places that stay meet the piece's phrases there, byte by byte, so a row's first phrase of each topic is known where the row
was read and nothing is shuffled.  Beyond that the bytes around each place, as far as the key's phrases reach, leave the row,
meet the phrases in an equi-join on the gram and are confirmed there; texts and all their grams are never exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.session import broadcast_if_small, ship_package

GRAM = 7
LONG = 10                 # bytes of a hashed gram: phrases that share seven bytes would meet at each of their places
SAMPLE, OPENING = 100, 4_000   # texts, and characters of each, that the rarity of grams is guessed from
COUNTERS = 20             # bits of the rarity table
MAX_KEYS = 1 << 20        # keys that travel with the scan in full; beyond that the bit filter alone decides
CHUNK = 1 << 18           # bytes looked at together; their hits are handed on before the next ones are looked for
PIECE_BYTES = 64 << 20    # phrases that a task holds at a time
CARRIED_BYTES = 1 << 30   # phrases that travel to the tasks at all
PAIRS = 1 << 18           # places with a phrase of the same gram that are compared together


def _words(data, m: int):
    """The eight bytes that start at each of the first ``m`` bytes, as a number; ``data`` has seven more bytes at least."""
    import numpy as np
    return np.ndarray((m,), "<u8", data, strides=(1,))


def _padded(data):
    import numpy as np
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)])


def _codes(data, n: int):
    """The ``n``-byte gram that starts at each byte, as a number that also tells its length (up to ``GRAM``) or as a hash."""
    import numpy as np
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n > GRAM:
        words = _words(_padded(data), m + n - 8)
        return (words[:m] * np.uint64(0x9E3779B97F4A7C15) ^ words[n - 8:]) >> np.uint64(1)
    return (_words(_padded(data), m) & np.uint64((1 << 8 * n) - 1)) | np.uint64(n << 56)


def _mixed(codes, bits: int):
    import numpy as np
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _bytes_of(column):
    """Byte buffer, starts and ends of a binary Arrow column."""
    import numpy as np
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, dtype=np.uint8)), at[:-1], at[1:]


def _rarity(texts: DataFrame, col: str, sizes):
    """Hashed counts of grams in the openings of a few texts: a guess at how rare each gram is."""
    import numpy as np
    some = texts.select(F.substring(F.col(col), 1, OPENING)).limit(SAMPLE).collect()
    data = np.frombuffer("\0".join(r[0] or "" for r in some).encode(), dtype=np.uint8)
    total = np.zeros(1 << COUNTERS, dtype=np.int64)
    for n in sizes:
        total += np.bincount(_mixed(_codes(data, n), COUNTERS), minlength=len(total))
    return total.astype(np.int32)


def keyed_phrases(phrases: DataFrame, rarity) -> DataFrame:
    """``(code, before, after, topic, pos, keyword)``: each phrase by its rarest gram and the bytes it reaches around that."""
    schema = phrases.select("topic", "pos", "keyword").schema
    ddl = "code long, before int, after int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, ends = _bytes_of(batch.column("keyword").cast(pa.binary()))
            starts, ends = starts.astype(np.int64), ends.astype(np.int64)
            sizes = np.where(ends - starts >= LONG, LONG, np.minimum(ends - starts, GRAM))
            code, at = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
            for n in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == n)
                codes = _codes(data[:ends[-1]], n)
                h = _mixed(codes, COUNTERS)
                # The places of the phrases of this size, one after the other.
                many = ends[some] - starts[some] - n + 1
                first = np.cumsum(many) - many
                place = np.arange(many.sum()) - np.repeat(first - starts[some], many)
                shared = np.bincount(h[place], minlength=1 << COUNTERS)
                cost = np.minimum((rarity[h[place]] + 1) * shared[h[place]], 1 << 31)
                best = np.minimum.reduceat((cost << 31) | place, first) & ((1 << 31) - 1)
                code[some], at[some] = codes[best].astype(np.int64), best - starts[some]
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(at.astype(np.int32)), pa.array((ends - starts - at).astype(np.int32)),
                                              *batch.columns], names=["code", "before", "after", "topic", "pos", "keyword"])
    return phrases.select("topic", "pos", "keyword").mapInArrow(run, ddl)


def _filter_of(keyed: DataFrame):
    """Bit filter, sorted keys (or None) and how far each key's phrases reach: ``(bits, filter, keys, before, after)``."""
    import numpy as np
    reach = keyed.groupBy("code").agg(F.max("before").alias("b"), F.max("after").alias("a")).persist()
    n = reach.count()
    bits = int(min(27, max(12, np.ceil(np.log2(16 * max(n, 1))))))
    table = np.zeros(1 << bits, dtype=bool)
    try:
        if n <= MAX_KEYS:
            got = reach.toArrow().sort_by("code")
            keys = got.column("code").to_numpy().astype(np.uint64)
            table[_mixed(keys, bits)] = True
            return bits, table, keys, got.column("b").to_numpy(), got.column("a").to_numpy()

        def places(batches):
            import pyarrow as pa
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"p": _mixed(batch.column("code").to_numpy().astype(np.uint64), bits)})
        for r in reach.select("code").mapInArrow(places, "p long").distinct().toLocalIterator():
            table[r["p"]] = True
        far = reach.agg(F.max("b"), F.max("a")).first()
        return bits, table, None, far[0], far[1]
    finally:
        reach.unpersist()


def snippets(texts: DataFrame, col: str, keep, found, sizes) -> DataFrame:
    """``(_row, *keep, code, snippet)``: the distinct surroundings of every place of a text row where a key starts."""
    import numpy as np
    bits, table, keys, before, after = found

    def hits(data, n):
        for a in range(0, len(data), CHUNK):
            codes = _codes(data[a:a + CHUNK + n - 1], n)
            at = np.flatnonzero(table[_mixed(codes, bits)])
            c = codes[at]
            if keys is None:
                yield at + a, c, np.full(len(at), before), np.full(len(at), after)
            else:
                near = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                ok = keys[near] == c
                yield at[ok] + a, c[ok], before[near[ok]], after[near[ok]]

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            data, starts, ends = _bytes_of(batch.column("b"))
            base, end = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
            for n in sizes:
                for at, code, left, right in hits(data[base:end], n):
                    at = at + base
                    row = np.searchsorted(starts, at, side="right") - 1
                    inside = at + n <= ends[row]
                    at, code, row, left, right = at[inside], code[inside], row[inside], left[inside], right[inside]
                    # A key that is all of its phrases is the same at every place: once per row is enough.
                    plain = (left == 0) & (right == n) & (n <= GRAM)
                    if plain.any():
                        first = np.unique(np.stack([row[plain], code[plain].astype(np.int64)]), axis=1, return_index=True)[1]
                        plain_at = np.flatnonzero(plain)[first]
                        chosen = np.sort(np.concatenate([np.flatnonzero(~plain), plain_at]))
                        at, code, row, left, right = at[chosen], code[chosen], row[chosen], left[chosen], right[chosen]
                    low, high = np.maximum(at - left, starts[row]), np.minimum(at + right, ends[row])
                    view = memoryview(data)
                    pieces = {(r, c, bytes(view[a:b])) for r, c, a, b in zip(row.tolist(), code.tolist(), low.tolist(), high.tolist())}
                    if pieces:
                        rows, codes, parts = zip(*pieces)
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("_row", *keep)], pa.array(codes, pa.int64()), pa.array(parts, pa.binary())],
                                                         names=["_row", *keep, "code", "snippet"])
    kinds = dict(texts.dtypes)
    ddl = ", ".join(["_row long", *[f"`{c}` {kinds[c]}" for c in keep], "code long, snippet binary"])
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(col).cast("binary").alias("b"))
    return rows.where("b is not null").mapInArrow(run, ddl)


def _piece(table, last) -> dict:
    """Ordered phrases as arrays: slots of the hashed grams, bytes, and numbers of the topics; ``last``: the phrase before them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    rows = table.select(["topic", "pos", "keyword"]).combine_chunks().to_batches()[0]
    code = table.column("code").to_numpy().astype(np.uint64)
    data, starts, ends = _bytes_of(rows.column("keyword").cast(pa.binary()))
    topics = pc.dictionary_encode(rows.column("topic"), null_encoding="encode").indices.to_numpy()
    slot_bits = int(max(4, np.ceil(np.log2(2 * len(code)))))
    bits = slot_bits + 2
    h = _mixed(code, bits)
    order = np.argsort(h, kind="stable")
    marks = np.zeros(1 << bits, dtype=bool)
    marks[h] = True
    return {"bits": bits, "slot_bits": slot_bits, "filter": marks, "code": code[order], "order": order.astype(np.int32),
            "slots": np.searchsorted(h[order] >> 2, np.arange((1 << slot_bits) + 1)).astype(np.int32),
            "before": table.column("before").to_numpy(), "data": _padded(data[:ends[-1]]), "starts": starts.copy(), "size": ends - starts,
            "topic": np.concatenate([[0], np.cumsum(topics[1:] != topics[:-1])]), "rows": rows,
            "goes_on": last is not None and last == table.column("topic")[0].as_py()}


def _pieces(keyed: DataFrame) -> list:
    """The phrases by topic, pos and phrase, as broadcast pieces; a piece may go on with the topic of the one before."""
    import pyarrow as pa
    sc = keyed.sparkSession.sparkContext

    def packed(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])

    out, waiting, size, last = [], [], 0, None

    def sent():
        table = pa.concat_tables(waiting)
        out.append(sc.broadcast(_piece(table, last)))
        return table.column("topic")[-1].as_py()

    for r in keyed.orderBy("topic", "pos", "keyword").mapInArrow(packed, "b binary").toLocalIterator():
        if waiting and size + len(r["b"]) > PIECE_BYTES:
            last, waiting, size = sent(), [], 0
        waiting.append(pa.ipc.open_stream(r["b"]).read_all())
        size += len(r["b"])
    if waiting:
        sent()
    return out


def _same_bytes(words, at, piece, p):
    """Which pairs of a place and a phrase hold the same bytes, eight at a time."""
    import numpy as np
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    own = _words(piece["data"], len(piece["data"]) - 7)
    q, left, pair, done = piece["starts"][p].astype(np.int64), piece["size"][p], np.arange(len(p)), []
    while len(pair):
        same = ((words[at] ^ own[q]) & mask[np.minimum(left, 8)]) == 0
        over = left <= 8
        done.append(pair[same & over])
        on = same & ~over
        at, q, left, pair = at[on] + 8, q[on] + 8, left[on] - 8, pair[on]
    return np.concatenate(done) if done else pair


def _phrases_in(data, starts, ends, piece, sizes):
    """Rows and phrases that meet in ``data``: ``row * phrases + phrase``, ascending and distinct."""
    import numpy as np
    bits, n_phrases = piece["bits"], len(piece["order"])
    words = _words(_padded(data), len(data) + 1)
    out = np.zeros(0, dtype=np.int64)
    for a in range(0, len(data), CHUNK):
        found = [out]
        for n in sizes:
            codes = _codes(data[a:a + CHUNK + n - 1], n)
            h = _mixed(codes, bits)
            at = np.flatnonzero(piece["filter"][h])
            slot, code = h[at] >> (bits - piece["slot_bits"]), codes[at]
            at = at + a
            row = np.searchsorted(starts, at, side="right") - 1
            first = piece["slots"][slot].astype(np.int64)
            many = piece["slots"][slot + 1] - first
            upto = np.cumsum(many)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] - many[i] + PAIRS, side="right")))
                place = np.repeat(np.arange(i, j), many[i:j])
                k = np.arange(len(place)) - (upto - many)[place] + upto[i] - many[i] + first[place]
                i = j
                same = piece["code"][k] == code[place]
                place, p = place[same], piece["order"][k[same]]
                s, r = at[place] - piece["before"][p], row[place]
                inside = (s >= starts[r]) & (s + piece["size"][p] <= ends[r])
                s, r, p = s[inside], r[inside], p[inside]
                same = _same_bytes(words, s, piece, p)
                found.append(r[same] * n_phrases + p[same])
        out = np.sort(np.concatenate(found))
        out = out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out
    return out


def _groups(starts, ends):
    """Rows that are looked at together: at most ``CHUNK`` bytes, or a single row."""
    import numpy as np
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        yield i, j
        i = j


def row_hits(texts: DataFrame, col: str, keep, keyed: DataFrame, sizes) -> DataFrame:
    """``(*keep, topic, pos, keyword)``: the first phrase of each topic in each row, found in the row's own task."""
    import numpy as np
    pieces = _pieces(keyed)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts, ends = _bytes_of(batch.column("b"))
            starts, ends = starts.astype(np.int64), ends.astype(np.int64)
            hit = np.zeros(len(starts), dtype=bool)  # rows that hold the last topic so far
            for b in pieces:
                piece = b.value
                n, topic = len(piece["order"]), piece["topic"]
                before, hit = hit, (hit.copy() if piece["goes_on"] and topic[-1] == 0 else np.zeros(len(starts), dtype=bool))
                for i, j in _groups(starts, ends):
                    base = starts[i]
                    keys = _phrases_in(data[base:ends[j - 1]], starts[i:j] - base, ends[i:j] - base, piece, sizes)
                    row, p = keys // n + i, keys % n
                    new = np.ones(len(keys), dtype=bool)
                    new[1:] = (row[1:] != row[:-1]) | (topic[p[1:]] != topic[p[:-1]])
                    hit[row[topic[p] == topic[-1]]] = True
                    if piece["goes_on"]:
                        new &= (topic[p] != 0) | ~before[row]
                    if new.any():
                        rows, phrases = pa.array(row[new]), piece["rows"].take(pa.array(p[new]))
                        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in keep], *phrases.columns],
                                                         names=[*keep, "topic", "pos", "keyword"])
                if len(pieces) > 1 and hasattr(b, "_path"):
                    del b._value  # read again for the next rows
                piece = None
    kinds = dict(texts.dtypes)
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"{c} {t}" for c, t in keyed.select("topic", "pos", "keyword").dtypes]])
    rows = texts.select(*keep, F.col(col).cast("binary").alias("b"))
    return rows.where("b is not null").mapInArrow(run, ddl)


def phrase_hits(texts: DataFrame, phrases: DataFrame, col: str, keep=(), sample: DataFrame | None = None) -> DataFrame:
    """``(*keep, topic, pos, keyword)``: the first phrase (by pos, then phrase) of each topic, for every row of ``texts``.

    ``phrases(topic, pos, keyword)`` without NULL or empty phrases.  Rows are matched one by one, also equal ones; NULL and
    empty texts contain nothing, and an empty phrase table gives an empty result.  ``sample`` has the same texts in a form
    whose first rows are cheap to read; the rarity of grams is guessed from them.
    """
    ship_package(texts.sparkSession)
    width = F.octet_length("keyword") + F.coalesce(F.octet_length(F.col("topic").cast("string")), F.lit(0)) + 32
    long = F.octet_length("keyword") >= LONG
    found = phrases.groupBy(F.when(long, LONG).otherwise(F.least(F.lit(GRAM), F.octet_length("keyword"))).alias("n")).agg(F.sum(width).alias("b")).collect()
    sizes = sorted(r["n"] for r in found)
    if not sizes:
        return texts.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in phrases.select("topic", "pos", "keyword").dtypes]).limit(0)
    keyed = keyed_phrases(phrases, _rarity(texts if sample is None else sample, col, sizes))
    if sum(r["b"] for r in found) <= CARRIED_BYTES:
        return row_hits(texts, col, list(keep), keyed, sizes)
    places = snippets(texts, col, list(keep), _filter_of(keyed), sizes)
    met = places.join(broadcast_if_small(keyed.select("code", "topic", "pos", "keyword")), "code").where(
        F.contains("snippet", F.col("keyword").cast("binary")))
    first = met.groupBy("_row", *keep, "topic").agg(F.min(F.struct("pos", "keyword")).alias("b"))
    return first.select(*keep, "topic", "b.pos", "b.keyword")
