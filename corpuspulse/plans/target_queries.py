"""Registered queries: the trained target classifier (M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.operators import target_model as M
from corpuspulse.operators import topics as TP
from corpuspulse.plans.registry import register
from corpuspulse.plans.text_queries import _clean_heads, _kw, _segment_sql
from corpuspulse.sources.tables import driver_table


def _segments(spark, sf):
    return TP.tag_segments(_clean_heads(spark, sf), _kw(spark), "doc_id", "text")


def _labelled(spark, sf):
    """Segments with the label of their document: toxic is negative, else quality 1 is positive, quality 0 neutral."""
    lab = driver_table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "negative").when(
        F.col("quality") == 1, "positive").otherwise("neutral").alias("label"))
    return TP.tag_segments(_clean_heads(spark, sf).join(lab, "doc_id"), _kw(spark), "doc_id", "text", keep=("label",))


def _given(buckets: int = M.BUCKETS):
    """Fixed weights of the check: eighths, which add up exactly, by label and column."""
    import numpy as np
    c, b = np.arange(3)[:, None], np.arange(buckets + 1)[None, :]
    return M.TargetModel(((b * (c + 3)) % 11 - 5) / 8.0, 1.5)


def _side(text: str, name: str, near_end: bool) -> str:
    toks = f"list_filter(regexp_split_to_array(trim(lower({text})), '\\s+'), lambda w: length(w) > 0)"
    near = f"list_reverse({toks}[-{M.REACH}:])" if near_end else f"{toks}[1:{M.REACH}]"
    return (f"list_concat(list_transform({near}, lambda w, i: '{name}' || least(i - 1, 3) || ':' || w), list_transform({near}, lambda w: 'c:' || w))")


@register("target_model_scores", f"""WITH seg AS ({_segment_sql('fixed')}),
f AS (
  SELECT doc_id, topic, list_distinct(list_transform(list_concat(list_concat({_side('"left"', 'l', True)},
           list_transform(list_filter(regexp_split_to_array(trim(lower(target)), '\\s+'), lambda w: length(w) > 0), lambda w: 't:' || w)),
           {_side('"right"', 'r', False)}), lambda s: CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % {M.BUCKETS})) AS f FROM seg),
m AS (
  SELECT doc_id, topic, list_transform([0, 1, 2], lambda c: (coalesce(list_sum(list_transform(f, lambda b: ((b * (c + 3)) % 11 - 5) / 8.0)), 0)
           + (({M.BUCKETS} * (c + 3)) % 11 - 5) / 8.0) / 1.5) AS z FROM f),
p AS (SELECT doc_id, topic, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM m),
b AS (SELECT doc_id, topic, list_max(p) AS prob, list_position(p, list_max(p)) AS k FROM p)
SELECT doc_id, topic, ['negative', 'neutral', 'positive'][k] AS label, round(prob, 6) AS prob, round([-1.0, 0.0, 1.0][k] * prob, 6) + 0.0 AS score FROM b""")
def q_target_model_scores(spark, sf):
    """M9: segments scored by a linear model with given weights."""
    out = M.score_targets(_segments(spark, sf), _given())
    return out.select("doc_id", "topic", "label", F.round("prob", 6).alias("prob"), (F.round("score", 6) + 0.0).alias("score"))


@register("target_model_fit")
def q_target_model_fit(spark, sf):
    """M9: the model fitted on labelled segments of the documents; every segment scored (tests state its quality)."""
    return M.score_targets(_segments(spark, sf), M.fit_targets(_labelled(spark, sf)))
