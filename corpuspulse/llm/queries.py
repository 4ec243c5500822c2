"""The ``opN_*`` queries: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from corpuspulse.llm import bpe, licences, tool_calls, toxicity
from corpuspulse.llm.ann import nearest
from corpuspulse.llm.common import read, sha256
from corpuspulse.llm.conversations import as_rows, damaged, repair_conversations
from corpuspulse.llm.mixing import mix_sources
from corpuspulse.llm.near_dedup import near_components
from corpuspulse.llm.packing import pack_documents
from corpuspulse.llm.quality_rules import quality_rules
from corpuspulse.llm.substring_dedup import dedup_windows
from corpuspulse.llm.suffix_dedup import dedup_bytes
from corpuspulse.llm.whitening import whiten

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op1_substring_dedup", r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
first AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM (SELECT win.doc_id, win.i FROM win JOIN first USING (g) WHERE first.d < win.doc_id), range(0, 13) AS r(j)),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
         list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(ps, z[2])),
                        lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
""")
def op1_substring_dedup(spark, sf_dir):
    out = dedup_windows(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", sha256(F.col("kept_text")).alias("kept_sha256"))


@register("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def byte_bpe() -> str:
    """The public byte-level BPE vocabulary the queries use (a path, never copied)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op6_bpe")
def op6_bpe(spark, sf_dir):
    out = bpe.decode(bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe()), byte_bpe())
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
                      sha256(F.col("decoded")).alias("decoded_sha256"))


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"), byte_bpe()).withColumnRenamed("id", "doc_id")


@register("op7_nearest_neighbours")
def op7_nearest_neighbours(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return nearest(v, v.where("vec_id % 20 = 0"))


def _licence_sql() -> str:
    """The same by brute force: every line against every template, every word start against every phrase."""
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licences.PHRASES)
    templates = ", ".join(f"({k}, '{label}', {[w.decode() for w in licences.word_set(t)]})"
                          for k, (label, t) in enumerate(licences.TEMPLATES))
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({fold.format("coalesce(text, '')")}, '{licences.WORD}') AS ws,
         string_split({fold.format("coalesce(text, '')")}, chr(10)) AS lines FROM documents),
place AS (
  SELECT w.doc_id, i - 1 AS pos, label
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) AS w, (VALUES {phrases}) AS p(phrase, label)
  WHERE array_to_string(ws[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
base AS (
  SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, list_sort(list(DISTINCT label)) AS ls FROM place GROUP BY doc_id),
block AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '{licences.WORD}')) AS bs
  FROM (SELECT doc_id, unnest(lines) AS line FROM w)),
hit AS (
  SELECT doc_id, label, len(list_intersect(bs, ts)) / len(ts) AS share
  FROM block, (VALUES {templates}) AS t(k, label, ts)
  WHERE len(list_intersect(bs, ts)) >= ceil({licences.THRESHOLD} * len(ts) - 1e-9)),
found AS (SELECT doc_id, list(DISTINCT label) AS ls, max(share) AS s FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
       coalesce(array_to_string(base.ls, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(s, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@register("op2_licence_scan", _licence_sql())
def op2_licence_scan(spark, sf_dir):
    out = licences.scan_licences(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@register("op9_tool_calls", r"""
WITH c AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '-' || turn AS call_id,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS words
  FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
lev AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn - 2 * rn ORDER BY turn) - 1 AS level
  FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS rn FROM c))
SELECT c.conv_id, c.call_id, c.turn, level, r.turn IS NOT NULL AS linked,
       array_to_string(list_filter([CASE WHEN c.text IS NULL THEN 'prompt missing' END,
                                    CASE WHEN length(c.text) > 300 THEN 'prompt too long' END,
                                    CASE WHEN words < 5 THEN 'words too small' END], lambda x: x IS NOT NULL), ',') AS errors,
       sha256('{"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || ',"words":' || words || '},"id":'
              || to_json(call_id) || ',"name":"reply","result":' || coalesce(to_json(r.text), 'null') || '}') AS canonical_sha256
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 JOIN lev ON lev.conv_id = c.conv_id AND lev.turn = c.turn
""")
def op9_tool_calls(spark, sf_dir):
    out = tool_calls.link_tool_calls(tool_calls.as_messages(read(spark, sf_dir, "conversations")), tool_calls.REPLY_SCHEMA)
    return out.select(F.col("conv").cast("long").alias("conv_id"), "call_id", "turn", F.col("level").cast("long").alias("level"),
                      "linked", "errors", sha256(F.col("canonical")).alias("canonical_sha256"))


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))  # a NULL id is in no fold
    return out.select(F.col("id").alias("doc_id"), fold.alias("held_out"), "score", "predicted")


@register("op5_near_dedup")
def op5_near_dedup(spark, sf_dir):
    return near_components(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    out = dedup_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      sha256(F.col("kept")).alias("kept_sha256"))


@register("op12_source_mix", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, source_size, 3 * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS sid,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
lim AS (  -- rounds of sharing: what is above a limit is shared again among the others
  SELECT [CAST(0 AS BIGINT)] AS capped, 0 AS n
  UNION ALL
  SELECT over_, n + 1 FROM (
    SELECT n, (SELECT list(s.sid) FROM s WHERE list_contains(capped, s.sid) OR
        s.cap < s.weight * ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(cap), 0) FROM s WHERE list_contains(capped, s.sid)))
                / (SELECT sum(weight) FROM s WHERE NOT list_contains(capped, s.sid))) AS over_, capped
    FROM lim) WHERE len(over_) > len(list_filter(capped, lambda x: x > 0))),
fin AS (SELECT capped FROM lim ORDER BY n DESC LIMIT 1),
lam AS (
  SELECT CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) FILTER (WHERE list_contains(capped, sid)), 0) AS DOUBLE)
         / sum(weight) FILTER (WHERE NOT list_contains(capped, sid)) AS share FROM s, fin),
t AS (SELECT s.*, CASE WHEN list_contains(capped, sid) THEN CAST(cap AS DOUBLE) ELSE weight * share END AS target FROM s, fin, lam),
r AS (
  SELECT d.doc_id, d.size, d.h, t.sid, t.source_size, t.target,
         CAST(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         row_number() OVER () AS row_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT row_, size, (p * source_size + upto) / target AS finish, sid, h, upto
      FROM r, (VALUES (0), (1), (2)) AS v(p) WHERE size > 0 AND target > 0),
o AS (SELECT row_, size, sum(size) OVER (ORDER BY finish, sid, h, upto ROWS UNBOUNDED PRECEDING) AS words FROM q),
k AS (SELECT row_, CAST(sum(size) AS BIGINT) AS taken FROM o WHERE words <= (SELECT sum(source_size) FROM s) GROUP BY row_)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM r LEFT JOIN k USING (row_)
""")
def op12_source_mix(spark, sf_dir):
    out = mix_sources(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@register("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    rows = as_rows(read(spark, sf_dir, "conversations"))
    return repair_conversations(damaged(rows), rows).withColumnRenamed("conv", "conv_id")
