"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

The lattice of a conversation has a node for each (messages read, state of what was written), where the state is
nothing, ``s``, ``..u`` or ``..a`` and the written roles must read ``(s?(ua)+)?``.  Edges keep, rerole or delete the next
message or insert an empty one.  A forward heap grows from the start, a reverse heap from the accepted ends, until
no path as cheap as the best one found can be left unseen; of all crossings of that cost the least concatenated
audit wins.  Two audits of one cost that reach the same node are never prefixes of each other (the rest would be
inserts, which cost), so least parts concatenate to least wholes and a lattice may be cut between any two messages.

How it scales.  Messages are sorted once by (conversation, turn) into ranges of bounded size, so a conversation with
a third of all rows lies on many tasks.  Each task repairs the conversations that lie wholly in its range; for the
first and the last one it returns a table, the cheapest path from every state to every state, and such tables are
composed per conversation (a row per range, not per message).  Repeated messages are found by an aggregate over
digests.  Repaired messages are then replayed from the audits in one streaming pass that holds one message at a time.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm.common import cut, prepare

# Fixed values of the cost model.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = ("user", "user", "assistant", "user")      # the only role that may be written after each state
AFTER = (USER, USER, ASSISTANT, USER)             # ... and the state behind it
ENDS = (NOTHING, ASSISTANT)
LEGAL = ("su", "ua", "au")
OK, CUT_OFF, BLANK, REPEATED = range(4)           # faults of a message
CHUNK = 128                                       # messages one search takes
RANGE_BYTES = 32 << 20                            # text of one sorted range


def _edges(initial: str, fault: int, state: int):
    """What may happen to a message in a state: ``(letter, cost, next state)``."""
    yield "D", DELETE, state
    if fault not in (BLANK, REPEATED):
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial == "s" and state == NOTHING:
            yield "K", more, SYSTEM
        elif initial == NEXT[state][0]:
            yield "K", more, AFTER[state]
        yield "R", REROLE + more, AFTER[state]


def cheapest(messages: list[tuple[str, int]], start: int, ends) -> tuple[int, str] | None:
    """Least ``(cost, audit)`` from ``start`` to one of the states ``ends`` over ``(initial, fault)`` messages."""
    n = len(messages)
    ahead = [{(0, start): (0, "")}, {(n, e): (0, "") for e in ends}]
    heaps = [[(0, 0, start)], [(0, 0, e) for e in ends]]
    settled: list[dict] = [{}, {}]
    best = None

    def out(i, state):
        yield "I", INSERT, (i, AFTER[state])
        if i < n:
            for letter, cost, then in _edges(*messages[i], state):
                yield letter, cost, (i + 1, then)

    def into(i, state):
        for before in STATES:
            if AFTER[before] == state:
                yield "I", INSERT, (i, before)
            if i:
                for letter, cost, then in _edges(*messages[i - 1], before):
                    if then == state:
                        yield letter, cost, (i - 1, before)

    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else None for h in heaps]
        if best is not None and (None in tops or tops[0] + tops[1] > best):
            break
        side = 0 if tops[1] is None or (tops[0] is not None and tops[0] <= tops[1]) else 1
        cost, _far, state = heapq.heappop(heaps[side])
        # Equal costs are settled in the order of messages, hence after all nodes they may be reached from for free.
        i = _far if side == 0 else n - _far
        node = (i, state)
        if node in settled[side] or ahead[side][node][0] != cost:
            continue
        audit = settled[side][node] = ahead[side][node]
        if node in settled[1 - side]:
            total = cost + settled[1 - side][node][0]
            best = total if best is None else min(best, total)
        for letter, w, other in (out if side == 0 else into)(i, state):
            label = (cost + w, audit[1] + letter if side == 0 else letter + audit[1])
            if other not in settled[side] and (other not in ahead[side] or label < ahead[side][other]):
                ahead[side][other] = label
                heapq.heappush(heaps[side], (label[0], other[0] if side == 0 else n - other[0], other[1]))
            if other in settled[1 - side]:
                total = label[0] + settled[1 - side][other][0]
                best = total if best is None else min(best, total)
    if best is None:
        return None
    found = []
    for (i, state), (cost, audit) in settled[0].items():
        if (i, state) in settled[1] and cost + settled[1][i, state][0] == best:
            found.append(audit + settled[1][i, state][1])
        for letter, w, other in out(i, state):
            if other in settled[1] and cost + w + settled[1][other][0] == best:
                found.append(audit + letter + settled[1][other][1])
    return best, min(found)


Table = dict[tuple[int, int], tuple[int, str]]


def compose(a: Table, b: Table) -> Table:
    """Cheapest paths through two consecutive pieces."""
    out: Table = {}
    for (s, m), (c1, a1) in a.items():
        for t in STATES:
            if (m, t) in b:
                c2, a2 = b[m, t]
                if (s, t) not in out or c1 + c2 <= out[s, t][0]:
                    label = (c1 + c2, a1 + a2)
                    out[s, t] = min(out.get((s, t), label), label)
    return out


def composed(tables: list[Table]) -> Table:
    """All tables in order, composed in pairs (so that an audit is copied a logarithm of times)."""
    while len(tables) > 1:
        tables = [compose(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def table(messages: list[tuple[str, int]]) -> Table:
    """Cheapest path from every state to every state."""
    pieces = []
    for a in range(0, max(1, len(messages)), CHUNK):
        part = messages[a:a + CHUNK]
        pieces.append({(s, t): got for s in STATES for t in STATES if (got := cheapest(part, s, (t,))) is not None})
    return composed(pieces)


def whole(messages: list[tuple[str, int]]) -> tuple[int, str]:
    """Cheapest repair of a whole conversation."""
    if len(messages) <= CHUNK:
        return cheapest(messages, NOTHING, ENDS)
    paths = table(messages)
    return min(paths[NOTHING, e] for e in ENDS if (NOTHING, e) in paths)


# ---- messages as rows ---------------------------------------------------------------------------------------------

def _or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def as_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, tie, copy)``: NULL roles and texts as one blank; ``tie`` orders messages of one turn."""
    c = lambda name: F.col(f"`{name}`")
    return rows.select(c(conv).alias("conv"), c(turn).cast("long").alias("turn"), _or_blank(c(role)).alias("role"), _or_blank(c(text)).alias("text"),
                       F.xxhash64(c(role), c(text)).alias("tie"), F.lit(0).alias("copy"))


def damaged(rows: DataFrame, every: int = 20) -> DataFrame:
    """Rows of ``as_rows`` damaged by the CRC of ``conv:turn``: dropped, emptied, cut, repeated or given the user's role."""
    at = F.crc32(F.concat(_or_blank(F.col("conv")), F.lit(":"), _or_blank(F.col("turn"))).cast("binary")) % every
    some = rows.withColumn("_at", at).where("_at <> 0")
    text = F.when(F.col("_at") == 1, F.lit("")).when(F.col("_at") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_at") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return some.select("conv", "turn", F.when(F.col("_at") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), "tie", F.explode(copies).alias("copy"))


def _sorted_ranges(rows: DataFrame) -> DataFrame:
    """The messages in global order with ``pos``, kept in the shared folder: ranges of about ``RANGE_BYTES`` of text."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)) if size else 1
    key = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie").asc(), F.col("copy").asc()]
    laid = cut(rows.select("conv", "turn", "role", "text", "tie", "copy").repartitionByRange(int(parts), *key).sortWithinPartitions(*key))
    # Partitions of a checkpoint are fixed, so this id is the place in the global order, in every later reading.
    return laid.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"))


def _faults(laid: DataFrame) -> DataFrame:
    """``(conv, pos, turn, initial, fault)`` of every message; no texts from here on."""
    solid = F.translate("text", " \t\n\x0b\f\r", "")
    own = F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), OK).otherwise(CUT_OFF)
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    light = laid.select("conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), own.cast("int").alias("own"), digest.alias("digest"))
    first = (light.where(F.col("own") != BLANK).groupBy("conv", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("conv").alias("_c"), F.col("digest").alias("_d"), "first"))
    met = light.join(first, (F.col("digest") == F.col("_d")) & F.col("conv").eqNullSafe(F.col("_c")), "left")
    fault = F.when((F.col("own") != BLANK) & (F.col("pos") > F.col("first")), REPEATED).otherwise(F.col("own"))
    return met.select("conv", "pos", "turn", "initial", fault.cast("int").alias("fault"))


_PART = ("part long, n long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, "
         "blank long, duplicate long, truncated long, illegal long, froms array<int>, costs array<long>, audits array<string>")
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _segments(faults: DataFrame, conv_type: str) -> DataFrame:
    """One row per conversation and range: counts, and the cheapest paths (one where the conversation is whole there)."""
    rows = faults.withColumn("part", F.shiftright("pos", 33))

    def run(batches):
        import pyarrow as pa
        done, schema = [], None

        def summary(conv, part, seen, is_whole):
            turns = [t for t, _i, _f in seen if t is not None]
            marks = [(i, f) for _t, i, f in seen]
            paths = {(NOTHING, ASSISTANT): whole(marks)} if is_whole else table(marks)
            ends = sorted(paths)
            pairs = sum((a[0] + b[0]) not in LEGAL for a, b in zip(marks, marks[1:]))
            count = [sum(f == k for _i, f in marks) for k in (BLANK, REPEATED, CUT_OFF)]
            return {"conv": conv, "part": part, "n": len(seen), "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
                    "turns": len(set(turns)), "first_initial": marks[0][0], "last_initial": marks[-1][0], "blank": count[0],
                    "duplicate": count[1], "truncated": count[2], "illegal": pairs,
                    "froms": [-1] if is_whole else [s * 4 + t for s, t in ends],
                    "costs": [paths[e][0] for e in ends], "audits": [paths[e][1] for e in ends]}

        open_ = None          # (conv, range), its messages, whether it began the range
        for batch in batches:
            schema = _arrow_schema(batch.schema.field("conv").type)
            cols = [batch.column(c).to_pylist() for c in ("conv", "part", "turn", "initial", "fault")]
            for conv, at, t, i, f in zip(*cols):
                if open_ is None or open_[0] != (conv, at):
                    edge = open_ is None or open_[0][1] != at
                    if open_ is not None:
                        # Only the first and the last conversation of a range can go on in another one.
                        done.append(summary(*open_[0], open_[1], not (open_[2] or edge)))
                    open_ = [(conv, at), [], edge]
                open_[1].append((t, i, f))
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([summary(*open_[0], open_[1], False)], schema)

    parts = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "pos").mapInArrow(run, f"conv {conv_type}, {_PART}")


def _arrow_schema(conv_type):
    import pyarrow as pa
    long, text = pa.int64(), pa.string()
    return pa.schema([("conv", conv_type), ("part", long), ("n", long), ("first_turn", long), ("last_turn", long), ("turns", long),
                      ("first_initial", text), ("last_initial", text), ("blank", long), ("duplicate", long), ("truncated", long),
                      ("illegal", long), ("froms", pa.list_(pa.int32())), ("costs", pa.list_(long)), ("audits", pa.list_(text))])


def _join_segments(pdf):
    """The segments of one conversation that lies in several ranges, joined in order (a row per range)."""
    import pandas as pd
    pdf = pdf.sort_values("part")
    paths = composed([{divmod(int(k), 4): (int(c), a) for k, c, a in zip(r.froms, r.costs, r.audits)} for r in pdf.itertuples()])
    cost, audit = min(paths[NOTHING, e] for e in ENDS if (NOTHING, e) in paths)
    rows = list(pdf.itertuples())
    illegal = sum(int(r.illegal) for r in rows) + sum((a.last_initial + b.first_initial) not in LEGAL for a, b in zip(rows, rows[1:]))
    # Turns are sorted, so a turn is in two segments only as the last of one and the first of a later one.
    known = [r for r in rows if r.turns]
    turns = sum(int(r.turns) for r in known) - sum(a.last_turn == b.first_turn for a, b in zip(known, known[1:]))
    gaps = int(known[-1].last_turn) - int(known[0].first_turn) + 1 - turns if known else 0
    total = lambda name: int(pdf[name].sum())
    return pd.DataFrame([{"conv": pdf["conv"].iloc[0], "gaps": gaps, "blank": total("blank"), "duplicate": total("duplicate"),
                          "truncated": total("truncated"), "illegal": illegal, "cost": cost, "audit": audit}])


def _reports(segments: DataFrame, conv_type: str) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation with messages."""
    is_whole = F.col("froms")[0] == -1
    alone = segments.where(is_whole).select("conv", F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
                                            "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    several = segments.where(~is_whole).groupBy("conv").applyInPandas(_join_segments, f"conv {conv_type}, {_REPORT}")
    return alone.unionByName(several)


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reports, laid)`` for rows of ``as_rows``: counts, cost and audit per conversation, and the sorted messages."""
    prepare(rows.sparkSession)
    laid = _sorted_ranges(rows)
    kind = dict(rows.dtypes)["conv"]
    return _reports(cut(_segments(_faults(laid), kind)), kind), laid


def _replay(reports: DataFrame, laid: DataFrame, convs: DataFrame) -> DataFrame:
    """Audits and messages of a conversation in one sorted stream: its id, its report, then message by message."""
    none = lambda t: F.lit(None).cast(t)
    heads = convs.select("conv", F.lit(-2).cast("long").alias("pos"), none("string").alias("role"), none("string").alias("text"))
    counts = F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    plans = reports.select("conv", F.lit(-1).cast("long").alias("pos"), F.col("audit").alias("role"), F.to_json(counts).alias("text"))
    parts = int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (heads.unionByName(plans).unionByName(laid.select("conv", "pos", "role", "text"))
            .repartition(parts, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos"))


def _stream(batches):
    """``(conv, kind, ..)`` events of the sorted stream: ``begin``, ``report``, repaired ``message`` and ``end``."""
    conv, live, audit, at, state = None, False, "", 0, NOTHING

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv, "message", NEXT[state], ""
            state, at = AFTER[state], at + 1

    for batch in batches:
        for c, pos, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "pos", "role", "text"))):
            if pos == -2:
                if live:
                    yield from inserts()
                    yield conv, "end", None, None
                conv, live, audit, at, state = c, True, "", 0, NOTHING
                yield c, "begin", None, None
            elif pos == -1:
                audit = role
                yield c, "report", role, text
            else:
                yield from inserts()
                letter, at = audit[at], at + 1
                if letter == "K":
                    yield c, "message", role, text
                    state = SYSTEM if role[:1] == "s" else AFTER[state]
                elif letter == "R":
                    yield c, "message", NEXT[state], text
                    state = AFTER[state]
    if live:
        yield from inserts()
        yield conv, "end", None, None


def repaired_messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, place, role, text)``: the messages of every repaired conversation, ``place`` from 0."""
    plain = as_rows(rows, conv, turn, role, text)
    return replayed(plain, *plan_repairs(plain))


def replayed(rows: DataFrame, reports: DataFrame, laid: DataFrame) -> DataFrame:
    kind = dict(rows.dtypes)["conv"]

    def run(batches):
        import pyarrow as pa
        out, place, schema = [], 0, None

        def typed(it):
            nonlocal schema
            for b in it:
                schema = schema or pa.schema([("conv", b.schema.field("conv").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
                yield b

        for c, event, a, b in _stream(typed(batches)):
            if event == "begin":
                place = 0
            elif event == "message":
                out.append({"conv": c, "place": place, "role": a, "text": b})
                place += 1
            if len(out) >= 2_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return _replay(reports, laid, rows.select("conv").distinct()).mapInArrow(run, f"conv {kind}, place long, role string, text string")


def repair_conversations(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row per conversation.

    ``rows`` come from ``as_rows`` (and ``damaged``); every ``conv`` of ``originals`` gets a row, also without messages.
    The hash covers the repaired ``role:text`` lines joined by newlines; a conversation's lines are hashed as they
    stream by, never held.

    Defined cases: a NULL conversation is one of its own; NULL turns come first and count for no gap; NULL roles and
    texts are one blank; messages of one turn follow a digest of role and text, equal ones are interchangeable; a
    conversation without messages has zeros, an empty audit and the hash of the empty string; an empty table gives
    an empty result; further columns are ignored.
    """
    reports, laid = plan_repairs(rows)
    kind = dict(rows.dtypes)["conv"]

    def run(batches):
        import hashlib
        import json

        import pyarrow as pa
        out, schema, digest, report, audit, begun = [], None, None, None, "", False
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

        def typed(it):
            nonlocal schema
            for b in it:
                schema = schema or pa.schema([("conv", b.schema.field("conv").type), *[(k, pa.int64()) for k in names],
                                              ("audit", pa.string()), ("repaired_sha256", pa.string())])
                yield b

        for c, event, a, b in _stream(typed(batches)):
            if event == "begin":
                digest, report, audit, begun = hashlib.sha256(), dict.fromkeys(names, 0), "", False
            elif event == "report":
                audit, report = a, json.loads(b)
            elif event == "message":
                digest.update(b"\n" * begun + f"{a}:{b}".encode())
                begun = True
            else:
                out.append({"conv": c, **report, "audit": audit, "repaired_sha256": digest.hexdigest()})
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    convs = (rows if originals is None else originals).select("conv").distinct()
    return _replay(reports, laid, convs).mapInArrow(run, f"conv {kind}, {_REPORT}, repaired_sha256 string")
