"""Registered queries: lexicon scoring and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.functions import text as T
from corpuspulse.operators import scoring as SC
from corpuspulse.operators import topics as TP
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import HEADS, KW, register, sql_clean_en, sql_list, sql_str, sql_tokens, with_
from corpuspulse.plans.text_queries import _PAR_SQL, _segment_sql

LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(
    f"({sql_str(t)}, CAST({v} AS DOUBLE))" for t, v in S.LEXICON) + ") AS t(token, valence))"


def _sql_boost(p: str) -> str:
    cases = " ".join(f"WHEN {sql_str(t)} THEN CAST({b} AS DOUBLE)" for t, b in S.BOOSTERS)
    return f"(CASE {p} {cases} ELSE CAST(0.0 AS DOUBLE) END)"


def sql_compound(name: str, src: str, keys: list[str], text_expr: str) -> str:
    """CTEs computing ``compound`` per key of ``src`` (the SQL form of M7)."""
    k = ", ".join(keys)
    p = [f"CASE WHEN i > {j} THEN toks[i - {j}] END" for j in (1, 2, 3)]
    adj = "l.valence"
    for j, decay in enumerate(SC.BOOST_DECAY):
        adj = f"({adj} + {_sql_boost('p' + str(j + 1))} * sign(l.valence) * CAST({decay} AS DOUBLE))"
    neg = " OR ".join(f"list_contains({sql_list(S.NEGATORS)}, coalesce(p{j}, ''))" for j in (1, 2, 3))
    on = " AND ".join(f"t.{c} = x.{c}" for c in keys)
    return f"""{name}_tk AS (SELECT {k}, {sql_tokens(text_expr)} AS toks FROM {src}),
{name}_ex AS (SELECT {k}, toks, generate_subscripts(toks, 1) AS i, unnest(toks) AS token FROM {name}_tk),
{name}_px AS (SELECT {k}, token, {p[0]} AS p1, {p[1]} AS p2, {p[2]} AS p3 FROM {name}_ex),
{name}_v AS (SELECT {k}, CASE WHEN {neg} THEN {adj} * CAST({SC.NEGATION_SCALAR} AS DOUBLE) ELSE {adj} END AS v
             FROM {name}_px e JOIN lex l ON e.token = l.token),
{name}_s AS (SELECT {k}, sum(v) AS s FROM {name}_v GROUP BY {k}),
{name} AS (SELECT {", ".join("t." + c for c in keys)}, coalesce(x.s, 0.0) / sqrt(coalesce(x.s, 0.0) * coalesce(x.s, 0.0) + {SC.ALPHA}) AS compound
           FROM {name}_tk t LEFT JOIN {name}_s x ON {on})"""


def _label_score_sql(c: str) -> str:
    th = SC.LABEL_THRESHOLD
    return f"CASE WHEN {c} > {th} THEN abs({c}) WHEN {c} < -{th} THEN -abs({c}) ELSE 0.0 END"


def _ctx_sql(window: int = 3) -> str:
    lt, rt = sql_tokens('"left"'), sql_tokens('"right"')
    return (f"array_to_string(list_concat(({lt})[greatest(len({lt}) - {window - 1}, 1):len({lt})], "
            f"({rt})[1:{window}]), ' ')")


def _clean_heads(spark, sf):
    return S.heads(spark, sf).select("doc_id", "paper", T.clean_en("headline").alias("text"))


_KW_ARGS = dict(boosters=S.BOOSTERS, negators=S.NEGATORS)


@register("lexicon_compound", with_(HEADS, LEX) + f""",
th AS (SELECT doc_id, {sql_clean_en('headline')} AS h FROM heads),
{sql_compound('cmp', 'th', ['doc_id'], 'h')}
SELECT doc_id, round(compound, 6) + 0.0 AS compound FROM cmp""")
def q_lexicon_compound(spark, sf):
    """M7: whole-text polarity with boosters and negators."""
    r = SC.lexicon_compound(_clean_heads(spark, sf), S.lexicon(spark), "doc_id", "text", **_KW_ARGS)
    return r.select("doc_id", (F.round("compound", 6) + 0.0).alias("compound"))


# A lexicon of realistic size, derived from the documents: the 7,500 most frequent cleaned words, signed by length.
BIG_LEXICON = 7_500
BIG_LEX = f"""wc AS (
  SELECT token, count(*) AS n FROM (SELECT unnest({sql_tokens(sql_clean_en('text'))}) AS token FROM documents) GROUP BY token),
lex AS (
  SELECT token, CAST(((n % 9) - 4) / 2.0 AS DOUBLE) AS valence
  FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rk FROM wc) WHERE rk <= {BIG_LEXICON})"""


def big_lexicon(spark, sf):
    words = S.text_table(spark, sf, "documents").select(F.explode(T.tokens(T.clean_en("text"))).alias("token"))
    top = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(BIG_LEXICON)
    return top.select("token", (((F.col("n") % 9) - 4) / 2.0).alias("valence"))


@register("lexicon_compound_join", with_(HEADS, BIG_LEX) + f""",
th AS (SELECT doc_id, {sql_clean_en('headline')} AS h FROM heads),
{sql_compound('cmp', 'th', ['doc_id'], 'h')}
SELECT doc_id, round(compound, 6) + 0.0 AS compound FROM cmp""")
def q_lexicon_compound_join(spark, sf):
    """M7 with a lexicon of 7,500 words (the same join as for a small one)."""
    r = SC.lexicon_compound(_clean_heads(spark, sf), big_lexicon(spark, sf), "doc_id", "text", **_KW_ARGS)
    return r.select("doc_id", (F.round("compound", 6) + 0.0).alias("compound"))


def _target_sql() -> str:
    base = _segment_sql("fixed")
    head, tail = base.rsplit("SELECT * FROM tr WHERE", 1)
    seg = "segs AS (SELECT * FROM tr WHERE" + tail + ")"
    return head.replace("WITH ", f"WITH {LEX},\n", 1).rstrip() + ",\n" + seg + f""",
ctx AS (SELECT doc_id, topic, {_ctx_sql()} AS c FROM segs),
{sql_compound('tc', 'ctx', ['doc_id', 'topic'], 'c')}"""


@register("target_sentiment", _target_sql() + f"""
SELECT doc_id, topic, round({_label_score_sql('compound')}, 6) + 0.0 AS score FROM tc""")
def q_target_sentiment(spark, sf):
    """M9 (+P9): targeted score from the context window around the winning phrase."""
    texts = _clean_heads(spark, sf)
    segs = TP.tag_segments(texts, TP.prepare_keywords(S.kw(spark)), "doc_id", "text")
    r = SC.target_sentiment(segs, S.lexicon(spark), "doc_id", **_KW_ARGS)
    return r.select("doc_id", "topic", (F.round("score", 6) + 0.0).alias("score"))


@register("target_sentiment_join", _target_sql() + f"""
SELECT doc_id, topic, round({_label_score_sql('compound')}, 6) + 0.0 AS score FROM tc""")
def q_target_sentiment_join(spark, sf):
    """M9 over segments from the gram join (a phrase list too large for the plan takes this way)."""
    texts = _clean_heads(spark, sf)
    segs = TP.tag_segments(texts, TP.prepare_keywords(S.kw(spark)), "doc_id", "text", in_plan=0)
    r = SC.target_sentiment(segs, S.lexicon(spark), "doc_id", **_KW_ARGS)
    return r.select("doc_id", "topic", (F.round("score", 6) + 0.0).alias("score"))


def _score_headlines_sql() -> str:
    return _target_sql() + f""",
{sql_compound('wc', 'th', ['doc_id'], 'h')}
SELECT x.doc_id, h.paper, x.topic, round({_label_score_sql('x.compound')}, 6) + 0.0 AS score
FROM tc x JOIN heads h ON h.doc_id = x.doc_id
UNION ALL
SELECT w.doc_id, h.paper, 'whole' AS topic, round(w.compound, 6) + 0.0 AS score
FROM wc w JOIN heads h ON h.doc_id = w.doc_id"""


@register("score_headlines", _score_headlines_sql())
def q_score_headlines(spark, sf):
    """Headline pipeline -> long scores per topic plus ``whole``."""
    r = SC.score_headlines(S.heads(spark, sf), S.kw(spark), S.lexicon(spark), **_KW_ARGS)
    return r.select("doc_id", "paper", "topic", (F.round("score", 6) + 0.0).alias("score"))


def _score_documents_sql() -> str:
    segs = "list_filter(list_transform(string_split(h, keyword), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) > 0)"
    return _PAR_SQL.replace("WITH pieces AS", f"WITH {LEX}, {KW},\npieces AS", 1) + f""",
par AS (SELECT doc_id, source AS party, CAST(generate_subscripts(ks, 1) - 1 AS INT) AS pos, unnest(ks) AS paragraph FROM kept),
pc AS (SELECT doc_id, pos, party, {sql_clean_en('paragraph')} AS h FROM par),
kwp AS (SELECT topic, pos AS kpos, {sql_clean_en('keyword')} AS keyword FROM kw WHERE length({sql_clean_en('keyword')}) > 0),
hits AS (SELECT doc_id, pos, topic, arg_min(keyword, kpos) AS keyword
         FROM pc JOIN kwp ON contains(h, keyword) GROUP BY doc_id, pos, topic),
sg AS (SELECT t.doc_id, t.pos, t.party, x.topic, t.h, x.keyword, {segs} AS s
       FROM pc t JOIN hits x ON t.doc_id = x.doc_id AND t.pos = x.pos),
tr AS (SELECT doc_id, pos, party, topic,
         CASE WHEN starts_with(h, keyword) THEN '' WHEN ends_with(h, keyword) THEN s[1] ELSE s[1] END AS "left",
         CASE WHEN starts_with(h, keyword) THEN s[1] WHEN ends_with(h, keyword) THEN '' ELSE s[2] END AS "right",
         CASE WHEN starts_with(h, keyword) THEN keyword WHEN ends_with(h, keyword) THEN keyword ELSE keyword END AS target
       FROM sg),
segs AS (SELECT * FROM tr WHERE "left" IS NOT NULL AND "right" IS NOT NULL AND target IS NOT NULL),
ctx AS (SELECT doc_id, pos, party, topic, {_ctx_sql()} AS c FROM segs),
{sql_compound('tc', 'ctx', ['doc_id', 'pos', 'topic'], 'c')},
scored AS (SELECT c.party, c.topic, {_label_score_sql('t.compound')} AS score
           FROM tc t JOIN ctx c ON c.doc_id = t.doc_id AND c.pos = t.pos AND c.topic = t.topic),
means AS (SELECT party, topic, avg(score) AS score FROM scored GROUP BY party, topic),
grid AS (SELECT p.party, t.topic FROM (SELECT DISTINCT source AS party FROM documents) p,
                                      (SELECT DISTINCT topic FROM kw) t)"""


@register("score_documents", _score_documents_sql() + """
SELECT g.party, g.topic, round(coalesce(m.score, 0.0), 6) + 0.0 AS score
FROM grid g LEFT JOIN means m ON m.party = g.party AND m.topic = g.topic""")
def q_score_documents(spark, sf):
    """M11 + A12: programme documents -> paragraph scores -> mean per party x topic (0 if no hit)."""
    r = SC.score_documents(S.docs(spark, sf), S.kw(spark), S.lexicon(spark), **_KW_ARGS)
    return r.select("party", "topic", (F.round("score", 6) + 0.0).alias("score"))


@register("target_mean", _target_sql() + f""",
ls AS (SELECT t.doc_id, h.paper, t.topic, {_label_score_sql('t.compound')} AS score
       FROM tc t JOIN heads h ON h.doc_id = t.doc_id)
SELECT paper, topic, round(avg(score), 6) + 0.0 AS score FROM ls GROUP BY paper, topic""")
def q_target_mean(spark, sf):
    """Mean targeted score per (paper, topic) over all target triples."""
    texts = _clean_heads(spark, sf)
    segs = TP.tag_segments(texts, TP.prepare_keywords(S.kw(spark)), "doc_id", "text", keep=("paper",))
    r = SC.target_sentiment(segs, S.lexicon(spark), "doc_id", keep=("paper",), **_KW_ARGS)
    return SC.target_mean(r, ("paper", "topic")).select("paper", "topic", (F.round("score", 6) + 0.0).alias("score"))


def _clean_docs(spark, sf):
    d = S.text_table(spark, sf, "documents")
    return d.select("doc_id", F.col("source").alias("paper"), T.clean_en("text").alias("text"))


@register("lexicon_compound_documents", with_(LEX) + f""",
td AS (SELECT doc_id, {sql_clean_en('text')} AS h FROM documents),
{sql_compound('cmp', 'td', ['doc_id'], 'h')}
SELECT doc_id, round(compound, 6) + 0.0 AS compound FROM cmp""")
def q_lexicon_compound_documents(spark, sf):
    """M7 over whole documents (every token of every text)."""
    r = SC.lexicon_compound(_clean_docs(spark, sf), S.lexicon(spark), "doc_id", "text", **_KW_ARGS)
    return r.select("doc_id", (F.round("compound", 6) + 0.0).alias("compound"))


@register("score_documents_big_lexicon", _score_documents_sql().replace(LEX, BIG_LEX) + """
SELECT g.party, g.topic, round(coalesce(m.score, 0.0), 6) + 0.0 AS score
FROM grid g LEFT JOIN means m ON m.party = g.party AND m.topic = g.topic""")
def q_score_documents_big_lexicon(spark, sf):
    """M11 + A12 with a lexicon of 7,500 words."""
    r = SC.score_documents(S.docs(spark, sf), S.kw(spark), big_lexicon(spark, sf), **_KW_ARGS)
    return r.select("party", "topic", (F.round("score", 6) + 0.0).alias("score"))


@register("match_topics_documents", with_(KW) + f""",
td AS (SELECT doc_id, {sql_clean_en('text')} AS h FROM documents),
kwp AS (SELECT topic, pos, {sql_clean_en('keyword')} AS keyword FROM kw WHERE length({sql_clean_en('keyword')}) > 0)
SELECT doc_id, topic, CAST(min(pos) AS INT) AS pos, arg_min(keyword, pos) AS keyword
FROM td JOIN kwp ON contains(h, keyword) GROUP BY doc_id, topic""")
def q_match_topics_documents(spark, sf):
    """J3 over whole documents."""
    return TP.match_topics(_clean_docs(spark, sf), TP.prepare_keywords(S.kw(spark)), "doc_id", "text")
