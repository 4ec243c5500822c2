"""Registered queries: vote prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.functions.scores import sign_agree
from corpuspulse.operators import voting as V
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import ACTUAL, OBS, PARTY_ALIAS, PROG, register, with_

# Literal form of the vote count: every score against every party position on
# the same topic; the Spark side pre-aggregates signs instead.
_TV = """tv AS (
  SELECT p.party, CAST(count(o.obs_id) AS BIGINT) AS topic_votes
  FROM prog p LEFT JOIN obs o
    ON o.topic = p.topic AND ((o.score > 0 AND p.score > 0) OR (o.score < 0 AND p.score < 0))
  GROUP BY p.party)"""
_PM = """pm AS (
  SELECT d.party, CAST(count(o.obs_id) AS BIGINT) AS party_mentions
  FROM (SELECT DISTINCT party FROM prog) d
  LEFT JOIN party_alias a ON a.party = d.party
  LEFT JOIN obs o ON o.topic = a.topic AND o.score > 0
  GROUP BY d.party)"""
_PRED = """pred AS (
  SELECT tv.party, tv.topic_votes, pm.party_mentions, tv.topic_votes + pm.party_mentions AS total_votes,
         round(CAST(tv.topic_votes + pm.party_mentions AS DOUBLE) * 100.0
               / nullif(sum(CAST(tv.topic_votes + pm.party_mentions AS DOUBLE)) OVER (), 0), 2) AS pct
  FROM tv JOIN pm ON tv.party = pm.party)"""


def _pred(spark, sf):
    return V.voting_prediction(S.obs(spark, sf), S.prog(spark, sf), S.party_alias(spark))


@register("voting_prediction", with_(OBS, PROG, PARTY_ALIAS, _TV, _PM, _PRED) + "SELECT * FROM pred")
def q_voting_prediction(spark, sf):
    """A15 + P14 + W3 (flagship): vote shares from sign agreement + party mentions."""
    return _pred(spark, sf)


_OBS_P3 = OBS.replace("obs AS (", "obs_all AS (") + ",\nobs AS (SELECT * FROM obs_all WHERE paper = 'p3')"


@register("voting_prediction_paper",
          with_(_OBS_P3, PROG, PARTY_ALIAS, _TV, _PM, _PRED) + "SELECT * FROM pred")
def q_voting_prediction_paper(spark, sf):
    """A15 + F3: the same prediction for one paper."""
    return V.voting_prediction(S.obs(spark, sf), S.prog(spark, sf), S.party_alias(spark), paper="p3")


@register("match_votes", with_(OBS, PROG) + """
SELECT p.party, p.topic, CAST(count(*) AS BIGINT) AS votes
FROM obs o JOIN prog p ON o.topic = p.topic
WHERE (o.score > 0 AND p.score > 0) OR (o.score < 0 AND p.score < 0)
GROUP BY p.party, p.topic""")
def q_match_votes(spark, sf):
    """Sign-agreement join of scores and party positions."""
    return V.match_votes(S.obs(spark, sf), S.prog(spark, sf))


@register("topic_votes", with_(OBS, PROG) + """
SELECT p.party, p.topic, CAST(count(o.obs_id) AS BIGINT) AS votes
FROM prog p LEFT JOIN obs o
  ON o.topic = p.topic AND ((o.score > 0 AND p.score > 0) OR (o.score < 0 AND p.score < 0))
GROUP BY p.party, p.topic""")
def q_topic_votes(spark, sf):
    """Dense party x topic agreement counts."""
    return V.topic_votes(S.obs(spark, sf), S.prog(spark, sf))


@register("party_mentions", with_(OBS, PROG, PARTY_ALIAS, _PM) + "SELECT * FROM pm")
def q_party_mentions(spark, sf):
    """Positive mentions of the topic named after each party."""
    return V.party_mentions(S.obs(spark, sf), S.prog(spark, sf), S.party_alias(spark))


_BY_PAPER = """obs2 AS (SELECT paper, obs_id, topic, score FROM obs
                UNION ALL SELECT 'total' AS paper, obs_id, topic, score FROM obs),
tvp AS (
  SELECT o.paper, p.party,
         CAST(count(*) FILTER (WHERE (o.score > 0 AND p.score > 0) OR (o.score < 0 AND p.score < 0)) AS BIGINT) AS topic_votes
  FROM obs2 o JOIN prog p ON o.topic = p.topic
  GROUP BY o.paper, p.party),
pmp AS (
  SELECT o.paper, a.party, CAST(count(*) FILTER (WHERE o.score > 0) AS BIGINT) AS party_mentions
  FROM obs2 o JOIN party_alias a ON o.topic = a.topic
  GROUP BY o.paper, a.party),
grid AS (SELECT pp.paper, pa.party FROM (SELECT DISTINCT paper FROM obs2) pp
         CROSS JOIN (SELECT DISTINCT party FROM prog) pa),
byp AS (
  SELECT g.paper, g.party,
         coalesce(t.topic_votes, 0) AS topic_votes, coalesce(m.party_mentions, 0) AS party_mentions
  FROM grid g LEFT JOIN tvp t ON t.paper = g.paper AND t.party = g.party
  LEFT JOIN pmp m ON m.paper = g.paper AND m.party = g.party),
predp AS (
  SELECT paper, party, topic_votes, party_mentions, topic_votes + party_mentions AS total_votes,
         round(CAST(topic_votes + party_mentions AS DOUBLE) * 100.0
               / nullif(sum(CAST(topic_votes + party_mentions AS DOUBLE)) OVER (PARTITION BY paper), 0), 2) AS pct
  FROM byp)"""


def _by_paper(spark, sf):
    return V.voting_by_paper(S.obs(spark, sf), S.prog(spark, sf), S.party_alias(spark))


@register("voting_by_paper", with_(OBS, PROG, PARTY_ALIAS, _BY_PAPER) + "SELECT * FROM predp")
def q_voting_by_paper(spark, sf):
    """Predictions for every paper and overall in one grouping-sets pass."""
    return _by_paper(spark, sf)


_PIVOT_COLS = ", ".join(f"max(pct) FILTER (WHERE paper = '{p}') AS {p}" for p in S.PAPERS)


@register("outcome_matrix", with_(OBS, PROG, PARTY_ALIAS, _BY_PAPER) + f"""
SELECT party, {_PIVOT_COLS}, max(pct) FILTER (WHERE paper = 'total') AS total
FROM predp GROUP BY party""")
def q_outcome_matrix(spark, sf):
    """Party x paper share matrix with a total column."""
    return V.outcome_matrix(_by_paper(spark, sf), S.PAPERS)


@register("compare_actual", with_(OBS, PROG, PARTY_ALIAS, _TV, _PM, _PRED, ACTUAL) + """
SELECT p.party, p.pct AS pred_pct, a.pct AS actual_pct
FROM pred p LEFT JOIN actual_alias x ON x.party = p.party
JOIN actual a ON a.party = coalesce(x.actual_party, p.party)""")
def q_compare_actual(spark, sf):
    """Predicted vs actual shares aligned through a party alias."""
    return V.compare_actual(_pred(spark, sf), S.actual(spark), S.actual_alias(spark))


@register("prediction_mae", with_(OBS, PROG, PARTY_ALIAS, _TV, _PM, _PRED, ACTUAL) + """
SELECT round(avg(abs(p.pct - a.pct)), 6) AS mae, CAST(count(*) AS BIGINT) AS n_parties
FROM pred p LEFT JOIN actual_alias x ON x.party = p.party
JOIN actual a ON a.party = coalesce(x.actual_party, p.party)""")
def q_prediction_mae(spark, sf):
    """Mean absolute error of the overall prediction."""
    r = V.prediction_mae(_pred(spark, sf), S.actual(spark), S.actual_alias(spark))
    return r.select(F.round("mae", 6).alias("mae"), "n_parties")


@register("mae_by_paper", with_(OBS, PROG, PARTY_ALIAS, _BY_PAPER, ACTUAL) + """
SELECT p.paper, round(avg(abs(p.pct - a.pct)), 6) AS mae, CAST(count(*) AS BIGINT) AS n_parties
FROM predp p LEFT JOIN actual_alias x ON x.party = p.party
JOIN actual a ON a.party = coalesce(x.actual_party, p.party)
GROUP BY p.paper""")
def q_mae_by_paper(spark, sf):
    """MAE per paper and for the total."""
    r = V.mae_by_paper(_by_paper(spark, sf), S.actual(spark), S.actual_alias(spark))
    return r.select("paper", F.round("mae", 6).alias("mae"), "n_parties")


@register("mention_share", with_(OBS, PARTY_ALIAS, ACTUAL) + """,
cnt AS (
  SELECT a.party, CAST(count(o.obs_id) AS BIGINT) AS count
  FROM party_alias a LEFT JOIN obs o ON o.topic = a.topic AND o.score IS NOT NULL
  GROUP BY a.party),
sh AS (SELECT party, count, CAST(count AS DOUBLE) * 100.0 / nullif(sum(CAST(count AS DOUBLE)) OVER (), 0) AS pct FROM cnt),
j AS (
  SELECT s.party, s.count, s.pct, a.pct AS actual_pct
  FROM sh s LEFT JOIN actual_alias x ON x.party = s.party
  JOIN actual a ON a.party = coalesce(x.actual_party, s.party))
SELECT party, count, round(pct, 6) AS pct, actual_pct, round(avg(abs(pct - actual_pct)) OVER (), 6) AS mae FROM j""")
def q_mention_share(spark, sf):
    """Share of raw mention counts per party and its MAE against the outcome."""
    by_topic = S.obs(spark, sf).where(F.col("score").isNotNull()).groupBy("topic").agg(F.count("obs_id").alias("n"))
    counts = (S.party_alias(spark).join(by_topic, "topic", "left")
              .groupBy("party").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")))
    r = V.mention_share(counts, S.actual(spark), S.actual_alias(spark))
    return r.select("party", "count", F.round("pct", 6).alias("pct"), "actual_pct",
                    F.round("mae", 6).alias("mae"))


@register("sign_agree", with_(OBS, PROG) + """
SELECT o.paper, p.party, CAST(count(*) FILTER (WHERE (o.score > 0 AND p.score > 0) OR (o.score < 0 AND p.score < 0)) AS BIGINT) AS agree,
       CAST(count(*) AS BIGINT) AS pairs
FROM obs o JOIN prog p ON o.topic = p.topic
GROUP BY o.paper, p.party""")
def q_sign_agree(spark, sf):
    """F7 applied to sign classes: per (paper, party), score/position pairs on
    one topic and how many agree in sign.

    Scores are first reduced to counts per (paper, topic, sign), so the join
    with positions and the predicate run on (#papers x #topics x 3) rows.
    """
    o = S.obs(spark, sf)
    cls = o.groupBy("paper", "topic", F.signum("score").alias("sign")).agg(F.count(F.lit(1)).alias("n"))
    p = S.prog(spark, sf).withColumnRenamed("score", "p_score")
    j = cls.join(p, "topic")
    return j.groupBy("paper", "party").agg(
        F.sum(F.when(sign_agree("sign", "p_score"), F.col("n")).otherwise(0)).cast("long").alias("agree"),
        F.sum("n").cast("long").alias("pairs"))
