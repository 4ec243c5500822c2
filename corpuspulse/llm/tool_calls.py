"""Chat formatting, native: link tool calls to results, order them, validate arguments, write canonical JSON.

Messages carry JSON: ``{"tool_calls": [{"id", "name", "arguments": {..}, "after": [ids]}]}`` makes calls,
``{"tool_call_id", "content"}`` is a result; any other text is an ordinary message.  Calls and results meet in a
hash join by (conversation, call id), so a conversation with very many turns spreads over all tasks.  Order is a
level per call (longest chain of ``after`` links), found by pointer doubling where calls name one dependency each,
and in rounds of settled calls elsewhere.  All steps are DataFrame functions; JSON is read and written as Spark variants, whose object keys are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpuspulse.llm.common import cut

# Argument rules of the tool the registered query derives: field, JSON type, required, least value, longest text.
REPLY_SCHEMA = {"reply": [("prompt", "string", True, None, 300), ("turn", "integer", True, 0, None),
                          ("words", "integer", True, 5, None), ("tone", "string", False, None, 20)]}
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def _part(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def calls_and_results(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``calls(conv, turn, pos, call_id, name, args, after)`` and ``results(conv, turn, call_id, content)``."""
    m = messages.select(F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.try_parse_json(F.col(text).cast("string")).alias("v")).where("v is not null")
    listed = m.select("conv", "turn", F.posexplode(_part(F.col("v"), "$.tool_calls", "array<variant>")).alias("pos", "c"))
    calls = listed.select("conv", "turn", "pos", _part(F.col("c"), "$.id", "string").alias("call_id"),
                          _part(F.col("c"), "$.name", "string").alias("name"), _part(F.col("c"), "$.arguments", "variant").alias("args"),
                          _part(F.col("c"), "$.after", "array<string>").alias("after")).where("call_id is not null")
    results = m.select("conv", "turn", _part(F.col("v"), "$.tool_call_id", "string").alias("call_id"),
                       _part(F.col("v"), "$.content", "string").alias("content")).where("call_id is not null")
    return calls, results


def argument_errors(name: Column, args: Column, schemas: dict) -> Column:
    """Comma-joined findings of the arguments against the named tool's rules ('' when valid)."""
    found = F.array(F.lit("unknown tool"))
    for tool, rules in schemas.items():
        checks = [F.when(F.coalesce(~F.schema_of_variant(args).startswith("OBJECT"), F.lit(True)), F.lit("no arguments"))]
        for field, kind, required, least, longest in rules:
            value = _part(args, f"$.{field}", "variant")
            is_kind = F.schema_of_variant(value) == _TYPES[kind]
            checks.append(F.when(value.isNull(), F.lit(f"{field} missing") if required else F.lit(None).cast("string"))
                          .when(~is_kind, F.lit(f"{field} not {kind}")))
            if least is not None:
                checks.append(F.when(is_kind & (_part(args, f"$.{field}", "long") < least), F.lit(f"{field} too small")))
            if longest is not None:
                checks.append(F.when(is_kind & (F.length(_part(args, f"$.{field}", "string")) > longest), F.lit(f"{field} too long")))
        found = F.when(name == tool, F.array(*checks)).otherwise(found)
    return F.array_join(F.filter(found, lambda x: x.isNotNull()), ",")


def _levels_by_doubling(links: DataFrame) -> DataFrame:
    """Levels of calls with one dependency each: jump to ever farther ancestors, doubling the distance per round."""
    jump = cut(links.select("conv", "call_id", "dep", F.lit(1).cast("long").alias("level")))
    done, left = None, jump.count()
    while left:
        far = jump.select("conv", F.col("call_id").alias("dep"), F.col("dep").alias("_far"), F.col("level").alias("_more"))
        jump = cut(jump.join(far, ["conv", "dep"], "left").select(
            "conv", "call_id", F.col("_far").alias("dep"), (F.col("level") + F.coalesce("_more", F.lit(0))).alias("level")))
        settled, jump_open = jump.where("dep is null"), jump.where("dep is not null").count()
        done = settled.select("conv", "call_id", "level")
        if jump_open == left:  # nothing reached a first call: the rest is on cycles, or behind them
            break
        left = jump_open
    return done if done is not None else links.select("conv", "call_id", F.lit(1).cast("long").alias("level")).limit(0)


def _levels_by_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Levels in general: each round settles the calls whose last open dependency was settled before."""
    open_ = cut(links)
    frontier = cut(nodes.join(open_.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti"))
    done, level = frontier.withColumn("level", F.lit(0).cast("long")), 0
    while not frontier.isEmpty():
        left = cut(open_.join(frontier.withColumnRenamed("call_id", "dep"), ["conv", "dep"], "left_anti"))
        frontier = cut(open_.select("conv", "call_id").distinct().join(
            left.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti"))
        open_, level = left, level + 1
        done = cut(done.unionByName(frontier.withColumn("level", F.lit(level).cast("long"))))
    return done


def levels(calls: DataFrame) -> DataFrame:
    """``(conv, call_id, level)``: 0 without known dependencies, else one more than the highest of them.

    Calls on a cycle, or behind one, are missing from the result.  Conversations whose calls name one dependency
    each need about log2(longest chain) rounds; those with several per call one round per level.
    """
    nodes = calls.select("conv", "call_id")
    links = cut(calls.select("conv", "call_id", F.explode(F.array_distinct("after")).alias("dep"))
                .join(nodes.withColumnRenamed("call_id", "dep"), ["conv", "dep"], "left_semi"))
    several = cut(links.groupBy("conv", "call_id").count().where("count > 1").select("conv").distinct())
    single = links.join(several, "conv", "left_anti")
    first = (nodes.join(several, "conv", "left_anti").join(links.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
             .withColumn("level", F.lit(0).cast("long")))
    out = first.unionByName(_levels_by_doubling(single))
    if several.isEmpty():
        return out
    return out.unionByName(_levels_by_rounds(nodes.join(several, "conv", "left_semi"), links.join(several, "conv", "left_semi")))


def link_tool_calls(messages: DataFrame, schemas: dict, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``(conv, call_id, turn, pos, name, level, linked, errors, canonical)``, one row per distinct call id.

    ``canonical`` is the JSON of the call with its result, keys sorted, no blanks; (level, turn, pos) is a
    topological order.  Defined cases: NULL or non-JSON texts are ordinary messages; a NULL conversation is one
    conversation of its own; of calls (or results) repeating an id the first by (turn, pos) counts; a result
    without its call is left out; a call without result has ``linked`` false and a NULL result; unknown
    dependencies are ignored; calls on a cycle get a NULL level; an empty table gives an empty result.
    """
    calls, results = calls_and_results(messages, conv, turn, text)
    first = lambda df, *order: (df.withColumn("_n", F.row_number().over(
        Window.partitionBy("conv", "call_id").orderBy(*order))).where("_n = 1").drop("_n"))
    calls = first(calls, "turn", "pos", F.to_json("args"))
    results = first(results, "turn", "content").select("conv", "call_id", F.lit(True).alias("_has"), "content")
    ordered = levels(calls.select("conv", "call_id", "after"))
    linked = (calls.join(results.hint("shuffle_hash"), ["conv", "call_id"], "left")
              .join(ordered.hint("shuffle_hash"), ["conv", "call_id"], "left"))
    body = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), F.col("name"),
                              F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return linked.select("conv", "call_id", "turn", "pos", "name", "level", F.col("_has").isNotNull().alias("linked"),
                         argument_errors(F.col("name"), F.col("args"), schemas).alias("errors"), body.alias("canonical"))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool messages: a user turn calls ``reply``, the next assistant turn is its result.

    Each call names the call two turns earlier as its dependency.
    """
    c = F.col
    ident = lambda t: F.concat(F.lit("c"), c("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    words = F.size(F.filter(F.split(F.coalesce(c("text"), F.lit("")), r"\s+"), lambda w: w != ""))
    call = F.struct(F.array(F.struct(
        F.lit("reply").alias("name"), ident(c("turn")).alias("id"),
        F.struct(words.cast("long").alias("words"), c("turn").alias("turn"), c("text").alias("prompt")).alias("arguments"),
        F.array(ident(c("turn") - 2)).alias("after"))).alias("tool_calls"))
    result = F.struct(ident(c("turn") - 1).alias("tool_call_id"), c("text").alias("content"))
    return conversations.select("conv_id", "turn", F.when(c("role") == "user", F.to_json(call))
                                .when(c("role") == "assistant", F.to_json(result)).otherwise(c("text")).alias("text"))
