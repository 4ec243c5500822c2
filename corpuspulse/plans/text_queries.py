"""Registered queries: text functions and topic tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.functions import scores as SC
from corpuspulse.functions import text as T
from corpuspulse.operators import filters as FL
from corpuspulse.operators import reports as R
from corpuspulse.operators import topics as TP
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import (HEADS, KW, OBS, register, sql_clean_en, sql_list, sql_str,
                                        sql_tokens, with_)
from corpuspulse.sources.tables import driver_table


def _sql_lemma(var: str) -> str:
    cases = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in sorted(S.LEMMAS.items()))
    return f"CASE {var} {cases} ELSE {var} END"


def _sql_clean_en_full(col: str) -> str:
    base = sql_clean_en(col, S.STOP_EN)
    return f"array_to_string(list_transform(string_split({base}, ' '), lambda t: {_sql_lemma('t')}), ' ')"


@register("clean_en", with_(HEADS) + f"""
SELECT doc_id, CASE WHEN {sql_clean_en('headline', S.STOP_EN)} = '' THEN ''
                    ELSE {_sql_clean_en_full('headline')} END AS clean FROM heads""")
def q_clean_en(spark, sf):
    """English cleaner with stop words and a lemma table."""
    h = S.heads(spark, sf)
    return h.select("doc_id", T.clean_en("headline", S.STOP_EN, S.LEMMAS).alias("clean"))


_DE_KEEP = "regexp_replace(regexp_replace(headline, '-', ' ', 'g'), '[^a-zA-ZäöüÄÖÜß\\s]+|\\d+', '', 'g')"


@register("clean_de", with_(HEADS) + f"""
SELECT doc_id,
       CASE WHEN upper(headline) = headline AND lower(headline) <> headline THEN NULL
            ELSE array_to_string(list_filter({sql_tokens(_DE_KEEP)},
                                 lambda t: NOT list_contains({sql_list(S.STOP_DE)}, lower(t))), ' ') END AS clean
FROM heads""")
def q_clean_de(spark, sf):
    """German cleaner (case kept, umlauts kept, shouting -> NULL)."""
    h = S.heads(spark, sf)
    return h.select("doc_id", T.clean_de("headline", S.STOP_DE).alias("clean"))


@register("drop_shouting", """
SELECT doc_id, source AS paper FROM documents
WHERE NOT (upper(text) = text AND lower(text) <> text)""")
def q_drop_shouting(spark, sf):
    """P5: drop all-capitals texts (digits-only is not shouting)."""
    d = S.text_table(spark, sf, "documents")
    return d.where(~T.is_shouting("text")).select("doc_id", F.col("source").alias("paper"))


@register("tokens_stop_lemma", with_(HEADS) + f"""
SELECT doc_id, CAST(len({sql_tokens('headline')}) AS INT) AS n_tokens,
       CAST(len(list_filter({sql_tokens('headline')}, lambda t: NOT list_contains({sql_list(S.STOP_EN)}, t))) AS INT) AS n_kept,
       array_to_string(list_transform({sql_tokens('lower(headline)')}, lambda t: {_sql_lemma('t')}), ' ') AS lemmatised
FROM heads""")
def q_tokens_stop_lemma(spark, sf):
    """Tokenizer, stop-word filter (duplicates kept) and lemma map as separate steps."""
    h = S.heads(spark, sf)
    toks = T.tokens("headline")
    return h.select("doc_id", F.size(toks).alias("n_tokens"),
                    F.size(T.without(toks, S.STOP_EN)).alias("n_kept"),
                    F.array_join(T.lemma(T.tokens(F.lower(F.col("headline"))), S.LEMMAS), " ").alias("lemmatised"))


_PAR_SQL = """
WITH pieces AS (
  SELECT doc_id, source,
         flatten(list_transform(string_split(text, chr(10) || chr(10)),
           lambda p: flatten(list_transform(string_split(p, '. '),
             lambda q: regexp_split_to_array(q, '\\d+ ' || chr(10)))))) AS ps
  FROM documents),
kept AS (
  SELECT doc_id, source,
         list_transform(list_filter(ps, lambda p: length(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) > 0
                        AND NOT regexp_full_match(replace(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), ' ', ''), '\\d+')),
                        lambda p: regexp_replace(p, '[\\n-]', '', 'g')) AS ks
  FROM pieces)"""


@register("paragraphs", _PAR_SQL + """
SELECT doc_id, CAST(generate_subscripts(ks, 1) - 1 AS INT) AS pos, unnest(ks) AS paragraph FROM kept""")
def q_paragraphs(spark, sf):
    """Document -> ordered paragraphs."""
    return T.paragraphs(S.text_table(spark, sf, "documents"))


@register("compose_headline", with_(HEADS) + """
SELECT doc_id,
       CASE WHEN headline IS NULL THEN NULL
            WHEN lang IS NOT NULL AND length(lang) > 0 AND lang <> 'en' THEN lang || ': ' || headline
            ELSE headline END AS composed,
       coalesce(CASE WHEN headline LIKE '%,%' THEN split_part(headline, ',', 1) END, headline) AS primary_or_fallback
FROM heads""")
def q_compose_headline(spark, sf):
    """P6 + P7: ``topline: headline`` when a topline exists; primary value else fallback."""
    h = S.heads(spark, sf)
    top = F.when(F.col("lang") != "en", F.col("lang"))
    primary = F.when(F.col("headline").contains(","), F.substring_index("headline", ",", 1))
    return h.select("doc_id", SC.compose(top, "headline").alias("composed"),
                    SC.first_non_null(primary, "headline").alias("primary_or_fallback"))


@register("text_after", with_(HEADS) + """
SELECT doc_id, CASE WHEN len(string_split(headline, 'the')) = 2
                    THEN regexp_replace(string_split(headline, 'the')[2], '^\\s+|\\s+$', '', 'g') END AS after
FROM heads""")
def q_text_after(spark, sf):
    """The text after a marker only when there are exactly two parts."""
    return S.heads(spark, sf).select("doc_id", T.text_after("headline", "the").alias("after"))


@register("label_score", """
SELECT doc_id,
       round(CAST(CASE WHEN quality = 1 AND toxic = 0 THEN 0.5 + 0.1 * (doc_id % 5)
                       WHEN quality = 0 AND toxic = 0 THEN 0.0
                       ELSE -(0.5 + 0.1 * (doc_id % 5)) END AS DOUBLE), 6) AS score
FROM labels""")
def q_label_score(spark, sf):
    """Positive -> +p, neutral -> 0, anything else (negative, unknown) -> -p."""
    lab = driver_table(spark, sf, "labels")
    label = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "positive")
             .when((F.col("quality") == 0) & (F.col("toxic") == 0), "neutral")
             .when(F.col("toxic") == 1, "negative").otherwise("unknown"))
    p = F.lit(0.5) + F.lit(0.1) * (F.col("doc_id") % 5)
    return lab.select("doc_id", F.round(SC.label_score(label, p), 6).alias("score"))


@register("canonical_topics", with_(OBS) + """
SELECT coalesce(a.topic, o.topic) AS topic, CAST(count(*) AS BIGINT) AS n
FROM obs o LEFT JOIN (VALUES ('view', 'views'), ('click', 'clicks')) AS a(raw, topic) ON o.topic = a.raw
GROUP BY 1""")
def q_canonical_topics(spark, sf):
    """P10: raw topic names renamed through an alias table."""
    o = R.canonical_topics(S.obs(spark, sf), S.topic_alias(spark))
    return o.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def _clean_heads(spark, sf):
    h = S.heads(spark, sf)
    return h.select("doc_id", "paper", T.clean_en("headline").alias("text"))


def _kw(spark):
    return TP.prepare_keywords(S.kw(spark))


_CLEAN_KW = with_(HEADS, KW) + f""",
th AS (SELECT doc_id, paper, {sql_clean_en('headline')} AS h FROM heads),
kwp AS (SELECT topic, pos, {sql_clean_en('keyword')} AS keyword FROM kw WHERE length({sql_clean_en('keyword')}) > 0),
hits AS (SELECT doc_id, topic, CAST(min(pos) AS INT) AS pos, arg_min(keyword, pos) AS keyword
         FROM th JOIN kwp ON contains(h, keyword) GROUP BY doc_id, topic)"""


@register("match_topics", _CLEAN_KW + "SELECT * FROM hits")
def q_match_topics(spark, sf):
    """Contains-join of cleaned headlines and a keyword taxonomy; first phrase per topic."""
    return TP.match_topics(_clean_heads(spark, sf), _kw(spark), "doc_id", "text")


@register("match_topics_join", _CLEAN_KW + "SELECT * FROM hits")
def q_match_topics_join(spark, sf):
    """J3, join strategy for any number of phrases: found through the rarest gram, confirmed by ``contains``."""
    return TP.match_topics(_clean_heads(spark, sf), _kw(spark), "doc_id", "text", strategy="grams")


def _many_phrases(spark, sf):
    """A taxonomy of thousands of phrases: every word pair that opens a line of some document, topic by length."""
    d = S.docs(spark, sf, parts=False).select(F.explode(F.split("text", "\n")).alias("line"))
    two = F.regexp_extract(F.lower("line"), r"^([a-z]+ [a-z]+)", 1)
    return d.select(two.alias("keyword")).where("keyword <> ''").distinct().select(
        F.concat(F.lit("t"), (F.length("keyword") % 5).cast("string")).alias("topic"), F.length("keyword").cast("int").alias("pos"), "keyword")


@register("match_topics_many_phrases", r"""
WITH kw AS (
  SELECT 't' || CAST(length(keyword) % 5 AS VARCHAR) AS topic, CAST(length(keyword) AS INT) AS pos, keyword FROM (
    SELECT DISTINCT regexp_extract(lower(line), '^([a-z]+ [a-z]+)', 1) AS keyword
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE keyword <> ''),
h AS (SELECT doc_id, lower(text) AS h FROM documents)
SELECT doc_id, topic, count(*) AS phrases, min(pos) AS pos FROM (
  SELECT doc_id, topic, pos FROM h JOIN kw ON contains(h, keyword)) GROUP BY doc_id, topic""")
def q_match_topics_many(spark, sf):
    """J3 with a taxonomy that grows with the data: phrases found through their rarest gram; all hits are counted."""
    from corpuspulse.operators import gram_index as G
    kw = _many_phrases(spark, sf).persist()
    texts = S.docs(spark, sf).select("doc_id", F.lower("text").alias("h"))
    # Every phrase is a topic of its own here, so each hit is returned.
    each = kw.select(F.col("keyword").alias("topic"), "pos", "keyword")
    hits = G.phrase_hits(texts, each, "h", ["doc_id"], sample=S.docs(spark, sf, parts=False).select(F.lower("text").alias("h")))
    topic = F.concat(F.lit("t"), (F.length("keyword") % 5).cast("string"))
    return hits.groupBy("doc_id", topic.alias("topic")).agg(F.count(F.lit(1)).alias("phrases"), F.min("pos").alias("pos"))


@register("match_topics_whole_word", with_(HEADS, KW) + f""",
th AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower({sql_clean_en('headline')}), '[^a-z0-9]+'), lambda x: length(x) > 0), ' ') || ' ' AS h FROM heads),
kwp AS (SELECT topic, pos, {sql_clean_en('keyword')} AS keyword FROM kw WHERE length({sql_clean_en('keyword')}) > 0)
SELECT doc_id, topic, CAST(min(pos) AS INT) AS pos, arg_min(keyword, pos) AS keyword
FROM th JOIN kwp ON contains(h, ' ' || keyword || ' ') GROUP BY doc_id, topic""")
def q_match_topics_whole_word(spark, sf):
    """J3 whole-word mode: token n-gram equi-join (no substring hits inside words)."""
    return TP.match_topics(_clean_heads(spark, sf), _kw(spark), "doc_id", "text", whole_word=True)


def _segment_sql(mode: str) -> str:
    segs = "list_filter(list_transform(string_split(h, keyword), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) > 0)"
    if mode == "compat":
        endl, endt, endr = "''", "s[1]", "keyword"
    else:
        endl, endt, endr = "s[1]", "keyword", "''"
    return _CLEAN_KW + f""",
sg AS (SELECT t.doc_id, x.topic, t.h, x.keyword, {segs} AS s FROM th t JOIN hits x ON t.doc_id = x.doc_id),
tr AS (SELECT doc_id, topic,
         CASE WHEN starts_with(h, keyword) THEN '' WHEN ends_with(h, keyword) THEN {endl} ELSE s[1] END AS "left",
         CASE WHEN starts_with(h, keyword) THEN keyword WHEN ends_with(h, keyword) THEN {endt} ELSE keyword END AS target,
         CASE WHEN starts_with(h, keyword) THEN s[1] WHEN ends_with(h, keyword) THEN {endr} ELSE s[2] END AS "right"
       FROM sg)
SELECT * FROM tr WHERE "left" IS NOT NULL AND target IS NOT NULL AND "right" IS NOT NULL"""


@register("segment", _segment_sql("fixed"))
def q_segment(spark, sf):
    """(left, target, right) around the first winning phrase (fixed end rule)."""
    texts = _clean_heads(spark, sf)
    hits = TP.match_topics(texts, _kw(spark), "doc_id", "text")
    return TP.segment(texts, hits, "doc_id", "text")


@register("tag_segments", _segment_sql("fixed"))
def q_tag_segments(spark, sf):
    """J3 + P8 fused: per-row hits and segments, no shuffle."""
    return TP.tag_segments(_clean_heads(spark, sf), _kw(spark), "doc_id", "text")


@register("segment_compat", _segment_sql("compat"))
def q_segment_compat(spark, sf):
    """P8 with the literal ends-with slot order."""
    texts = _clean_heads(spark, sf)
    hits = TP.match_topics(texts, _kw(spark), "doc_id", "text")
    return TP.segment(texts, hits, "doc_id", "text", mode="compat")


@register("mentions_topic", _CLEAN_KW + """
SELECT doc_id, paper FROM th WHERE doc_id IN (SELECT doc_id FROM hits)""")
def q_mentions_topic(spark, sf):
    """texts with at least one topic hit."""
    return TP.mentions_topic(_clean_heads(spark, sf), _kw(spark), "doc_id", "text").select("doc_id", "paper")


@register("no_topic_scored", _CLEAN_KW + """
SELECT doc_id, paper FROM th WHERE doc_id NOT IN (SELECT doc_id FROM hits)""")
def q_no_topic_scored(spark, sf):
    """texts without any topic score (anti join); ``whole`` rows do not count."""
    texts = _clean_heads(spark, sf)
    hits = TP.match_topics(texts, _kw(spark), "doc_id", "text")
    scores = hits.select("doc_id", "topic", F.lit(1.0).alias("score")).unionByName(
        texts.select("doc_id", F.lit("whole").alias("topic"), F.lit(1.0).alias("score")))
    return FL.no_topic_scored(texts, scores).select("doc_id", "paper")
