"""Keyword taxonomy tagging: contains-join (J3), segmentation (P8), F5.

``texts(<id>, text)`` x ``keywords(topic, pos, keyword)``: a text mentions a
topic when one of the topic's phrases occurs in the lower-cased text; the
phrase with the lowest ``pos`` wins.

Physical strategy, chosen by the measured size of the keyword table, with the
same rows either way:

* small phrase lists (``strategy='array'``): the list is embedded once in the
  plan as an array of structs sorted by (topic, pos); each text row filters it
  with ``contains`` and keeps the first hit of each topic run - a narrow
  projection with no join and no shuffle, so matching and segmentation stay in
  the scan stage;
* any number of phrases (``strategy='grams'``): each phrase is keyed by its
  rarest gram; texts are scanned with a bit filter over these keys, and hits meet
  the phrases in the row's own task, or in an equi-join where they are too many
  to travel (``gram_index``);
* ``whole_word=True``: token n-grams of the text equi-joined with phrases
  (a hash join, no size limit on either side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.functions.text import clean_en
from corpuspulse.functions.util import json_literal, let, let2
from corpuspulse.operators.gram_index import phrase_hits
from corpuspulse.session import broadcast_if_small

IN_PLAN_PHRASES = 5_000  # larger phrase lists are joined by grams
SENTINEL = "\u0000"  # never produced by the text cleaners


def prepare_keywords(keywords: DataFrame, mode: str = "fixed", stop_words=(), lemmas=None) -> DataFrame:
    """Lower-case phrases; in ``fixed`` mode run them through the text cleaner
    so that they can match cleaned text (commas, hyphens, stop words)."""
    kw = F.lower(F.col("keyword"))
    if mode == "fixed":
        kw = clean_en(F.col("keyword"), stop_words, lemmas)
    return (keywords.select("topic", "pos", kw.alias("keyword"))
            .where(F.col("keyword").isNotNull() & (F.length("keyword") > 0)))


def _first_hit(pairs: DataFrame, id_col: str) -> DataFrame:
    return pairs.groupBy(id_col, "topic").agg(
        F.min("pos").alias("pos"), F.min_by("keyword", "pos").alias("keyword"))


def match_topics(texts: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 whole_word: bool = False, strategy: str | None = None,
                 in_plan: int = IN_PLAN_PHRASES) -> DataFrame:
    """``(id, topic, pos, keyword)`` - the first phrase of each topic found in each text row.

    ``keywords`` should come from ``prepare_keywords``.  Rows with repeated or
    NULL ids are matched one by one in both strategies.
    """
    t = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("_h"))
    if whole_word:
        return _first_hit(_ngram_join(t, keywords, id_col), id_col)
    rows = small_keywords(keywords, in_plan) if strategy != "grams" else None
    if rows is None:
        return phrase_hits(t, keywords, "_h", [id_col])
    staged = t.select(id_col, all_hits(F.col("_h"), keyword_array(rows)).alias("_all"))
    return staged.select(id_col, F.explode(first_of_topic(F.col("_all"))).alias("k")).select(
        id_col, "k.topic", "k.pos", "k.keyword")


def small_keywords(keywords: DataFrame, limit: int = IN_PLAN_PHRASES):
    """The phrase rows when there are at most ``limit`` of them, else ``None`` (one bounded read)."""
    rows = keywords.select("topic", "pos", "keyword").limit(limit + 1).collect()
    return None if len(rows) > limit else [(r[0], r[1], r[2]) for r in rows]


def keyword_array(rows) -> Column:
    """Phrase rows from ``small_keywords`` as one literal ``array<struct<topic,pos,keyword>>``
    sorted by (topic, pos, keyword), shipped inside the plan like a broadcast."""
    rows = sorted(rows, key=lambda r: (str(r[0]), r[1], r[2]))
    return json_literal([{"topic": t, "pos": int(p), "keyword": k} for t, p, k in rows],
                        "array<struct<topic:string,pos:int,keyword:string>>")


def all_hits(h: Column, kw_array: Column) -> Column:
    """Per text: every phrase (sorted by topic, pos) that occurs in ``h`` (``h`` evaluated once)."""
    return let(h, lambda hv: F.filter(kw_array, lambda k: F.contains(hv, k["keyword"])))


def first_of_topic(hits: Column) -> Column:
    """Keep the first element of each topic run (``hits`` evaluated once)."""
    return let(hits, lambda hs: F.filter(hs, lambda k, i: (i == 0) | (F.get(hs, i - 1)["topic"] != k["topic"])))


def _ngram_join(t: DataFrame, keywords: DataFrame, id_col: str) -> DataFrame:
    """Whole-word matching: phrase of n tokens = some n-gram of the text tokens."""
    kw = keywords.withColumn("_n", F.size(F.split("keyword", " ")))
    max_n = kw.agg(F.max("_n")).first()[0] or 1
    toks = F.filter(F.split(F.col("_h"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 0)
    def grams_of(tv: Column, n: int):
        starts = F.when(F.size(tv) >= n, F.sequence(F.lit(1), F.size(tv) - n + 1)) \
                  .otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tv, i, n), " "))

    # Phrases that travel in the plan sift the n-grams inside the row, so only hits are exploded.
    rows = small_keywords(keywords)
    some = sorted({r[2] for r in rows if r[2] is not None}) if rows is not None else None
    sizes = range(1, max_n + 1) if rows is None else sorted({len(k.split(" ")) for k in some})
    sifted = (lambda g: g) if rows is None else (lambda g: F.filter(g, lambda x: x.isin(some)))
    parts = lambda tv: [sifted(tv if n == 1 else grams_of(tv, n)) for n in sizes] or [F.array().cast("array<string>")]
    grams = t.select(id_col, let(toks, lambda tv: F.array_distinct(F.flatten(F.array(*parts(tv))))).alias("_g")).select(
        id_col, F.explode("_g").alias("keyword"))
    grams = grams.where(F.col("keyword").isNotNull())
    # The phrase table is small in practice; broadcast it (behind a bounded
    # count) so the n-grams, the large side, are never shuffled.
    return grams.join(broadcast_if_small(kw.drop("_n")), "keyword").select(id_col, "topic", "pos", "keyword")


def segment(texts: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            mode: str = "fixed") -> DataFrame:
    """``(id, topic, left, target, right)`` around the first occurrence of the winning phrase.

    * starts with the phrase: (``''``, kw, seg0);
    * ends with it: fixed (seg0, kw, ``''``); compat (``''``, seg0, kw);
    * in the middle: (seg0, kw, seg1) - later repeats dropped;
    * a needed segment missing (text equals the phrase, ...) -> no row, and
      the topic is not retried with a later phrase.
    Segments are the non-blank pieces of the text split at every occurrence.
    """
    j = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("_h")).join(hits, id_col)
    return _segment_cols(j, id_col, mode)


def tag_segments(texts: DataFrame, keywords, id_col: str = "doc_id", text_col: str = "text",
                 mode: str = "fixed", keep=(), in_plan: int = IN_PLAN_PHRASES) -> DataFrame:
    """J3 + P8: ``(id, *keep, topic, left, target, right)`` for every text row.

    A phrase list that travels in the plan is matched and segmented in one
    narrow projection; a larger one through the gram join, keyed by the row's
    content, so both give the same rows for repeated and NULL ids.
    """
    t = texts.select(F.col(id_col), *keep, F.lower(F.col(text_col)).alias("_h"))
    rows = small_keywords(keywords, in_plan)
    if rows is not None:
        t = t.select(id_col, *keep, "_h", all_hits(F.col("_h"), keyword_array(rows)).alias("_all"))
        hits = t.select(id_col, *keep, "_h", F.explode(first_of_topic(F.col("_all"))).alias("k"))
        return _segment_cols(hits.select(id_col, *keep, "_h", "k.topic", "k.pos", "k.keyword"), id_col, mode, keep)
    t = t.withColumn("_k", F.xxhash64(F.col(id_col), *keep, "_h"))
    hits = phrase_hits(t, keywords, "_h", ["_k"]).distinct()
    return _segment_cols(t.join(hits, "_k"), id_col, mode, keep)


def segment_struct(h: Column, kw: Column, mode: str = "fixed") -> Column:
    """P8 for one (text, phrase): ``struct(left, target, right)``; a field is NULL when a
    needed segment is missing.  ``h`` and ``kw`` should be cheap references."""
    def body(segs):
        seg0, seg1 = F.get(segs, 0), F.get(segs, 1)
        starts, ends = F.startswith(h, kw), F.endswith(h, kw)
        empty = F.lit("")
        end_triple = (empty, seg0, kw) if mode == "compat" else (seg0, kw, empty)
        left = F.when(starts, empty).when(ends, end_triple[0]).otherwise(seg0)
        target = F.when(starts, kw).when(ends, end_triple[1]).otherwise(kw)
        right = F.when(starts, seg0).when(ends, end_triple[2]).otherwise(seg1)
        return F.struct(left.alias("left"), target.alias("target"), right.alias("right"))
    # Literal split: replace every occurrence by a sentinel, then split on the
    # (constant) sentinel - no per-row regex compilation.
    parts = F.split(F.replace(h, kw, F.lit(SENTINEL)), SENTINEL)
    segs = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")),
                    lambda p: F.length(p) > 0)
    return let(segs, body)


def _complete(seg: Column) -> Column:
    return seg["left"].isNotNull() & seg["target"].isNotNull() & seg["right"].isNotNull()


def segments_array(h: Column, kw_rows, mode: str = "fixed") -> Column:
    """J3 + P8 per text as an array of ``struct(topic, left, target, right)`` (complete ones only)."""
    first = first_of_topic(all_hits(h, keyword_array(kw_rows)))
    return let2(h, first, lambda hv, fs: F.filter(
        F.transform(fs, lambda k: F.struct(k["topic"].alias("topic"),
                                           segment_struct(hv, k["keyword"], mode).alias("s"))),
        lambda x: _complete(x["s"])))


def _segment_cols(j: DataFrame, id_col: str, mode: str, keep=()) -> DataFrame:
    seg = segment_struct(F.col("_h"), F.col("keyword"), mode)
    out = j.select(id_col, *keep, "topic", seg.alias("_s")).where(_complete(F.col("_s")))
    return out.select(id_col, *keep, "topic", "_s.left", "_s.target", "_s.right")


topic_segments = tag_segments


def mentions_topic(texts: DataFrame, keywords: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """texts that mention at least one topic (semi join on the match)."""
    hits = match_topics(texts, keywords, id_col, text_col).select(id_col).distinct()
    return texts.join(hits, id_col, "left_semi")
