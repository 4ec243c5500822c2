"""Vote prediction: match coverage scores against party positions.

Inputs use the long model:

* ``scores(paper, topic, score, ...)`` - one row per scored (text, topic);
* ``party_scores(party, topic, score)`` - one row per party position;
* ``alias(party, topic)`` - the topic that *names* a party (for mentions);
* ``actual(party, pct)`` - observed outcome.

Scale design: the score table is the only large input.  Every operator first
reduces it to sign counts per (paper, topic) with a map-side partial
aggregate, so the join against party positions happens on a table whose size
is (#papers x #topics), whatever the corpus volume.  A hot paper or topic is
absorbed by the partial aggregate; nothing is keyed by headline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuspulse.functions.scores import nan_to_null, share_pct, sign_agree
from corpuspulse.functions.util import dense_cells, distinct_array

TOTAL = "total"


def for_paper(scores: DataFrame, paper: str | None = None) -> DataFrame:
    """restrict to one paper (the predicate reaches the Parquet scan)."""
    return scores if paper is None else scores.where(F.col("paper") == F.lit(paper))


def sign_counts(scores: DataFrame, by=("topic",)) -> DataFrame:
    """Positive / negative counts per key, the sufficient statistic for voting."""
    s = nan_to_null("score")
    return scores.groupBy(*by).agg(F.count_if(s > 0).alias("n_pos"),
                                   F.count_if(s < 0).alias("n_neg"))


def sign_counts_by_paper(scores: DataFrame, total_label: str = TOTAL) -> DataFrame:
    """Sign counts per (paper, topic) and per topic over all papers, one pass.

    ``GROUPING SETS ((paper, topic), (topic))``; the overall rows carry
    ``total_label`` as paper (distinguished with ``grouping()`` so that a real
    NULL paper is not confused with the margin).
    """
    s = nan_to_null("score")
    g = scores.groupingSets([["paper", "topic"], ["topic"]], "paper", "topic").agg(
        F.count_if(s > 0).alias("n_pos"),
        F.count_if(s < 0).alias("n_neg"),
        F.grouping("paper").alias("_gp"))
    return g.select(
        F.when(F.col("_gp") == 1, F.lit(total_label)).otherwise(F.col("paper")).alias("paper"),
        "topic", "n_pos", "n_neg")


def _votes(counts: DataFrame, party_scores: DataFrame, keep_zero: bool, by=()) -> DataFrame:
    ps = party_scores.select("party", "topic", nan_to_null("score").alias("p_score"))
    how = "left" if keep_zero and not by else "inner"
    if by:
        j = counts.join(ps, "topic", "inner")
    else:
        j = ps.join(counts, "topic", how)
    votes = (F.when(F.col("p_score") > 0, F.col("n_pos"))
             .when(F.col("p_score") < 0, F.col("n_neg")).otherwise(F.lit(0)))
    return j.select(*by, "party", "topic", F.coalesce(votes, F.lit(0)).cast("long").alias("votes"))


def match_votes(scores: DataFrame, party_scores: DataFrame, paper: str | None = None) -> DataFrame:
    """(party, topic, votes) for pairs with at least one agreeing score.

    Equivalent to joining every score to every party position on topic and
    counting rows where ``sign_agree`` holds, but the join sees sign counts.
    """
    counts = sign_counts(for_paper(scores, paper))
    return _votes(counts, party_scores, keep_zero=False).where(F.col("votes") > 0)


def match_votes_rowwise(scores: DataFrame, party_scores: DataFrame) -> DataFrame:
    """J4 literal form (join then count); kept for tests and plan comparison."""
    ps = party_scores.select("party", "topic", F.col("score").alias("p_score"))
    return (scores.join(ps, "topic").where(sign_agree(nan_to_null("score"), nan_to_null("p_score")))
            .groupBy("party", "topic").agg(F.count(F.lit(1)).alias("votes")))


def topic_votes(scores: DataFrame, party_scores: DataFrame, paper: str | None = None) -> DataFrame:
    """Dense (party, topic, votes); positions with no agreement give 0."""
    counts = sign_counts(for_paper(scores, paper))
    return _votes(counts, party_scores, keep_zero=True)


def party_mentions(scores: DataFrame, parties: DataFrame, alias: DataFrame | None = None,
                   paper: str | None = None) -> DataFrame:
    """Positive-score count of the topic that names each party.

    ``parties`` needs a ``party`` column; ``alias(party, topic)`` maps a party
    to its topic.  Without an alias the party name itself is the topic (the
    literal rule).  Parties with no such topic get 0.
    """
    counts = sign_counts(for_paper(scores, paper))
    p = parties.select("party").distinct()
    if alias is None:
        p = p.withColumn("topic", F.col("party"))
    else:
        p = p.join(alias.select("party", "topic"), "party", "left")
    return (p.join(counts, "topic", "left")
            .groupBy("party").agg(F.coalesce(F.sum("n_pos"), F.lit(0)).cast("long").alias("party_mentions")))


def _party_topics(party_scores: DataFrame, alias: DataFrame | None) -> DataFrame:
    """Positions and mention topics of every party as one small table.

    ``(party, topic, p_score, _mention)``: position rows carry the party's
    score; mention rows (the topic naming the party; the party name itself
    without an alias) carry NULL.  Mention rows are kept only for parties
    that have positions, as the prediction is indexed by the position table.
    """
    ps = party_scores.select("party", "topic", nan_to_null("score").alias("p_score"),
                             F.lit(False).alias("_mention"))
    if alias is None:
        men = ps.select("party").distinct().select("party", F.col("party").alias("topic"))
    else:
        # Mention rows of parties without positions are dropped later (``_has_position``
        # overall, the party list of the pivot per paper) - no extra pass here.
        men = alias.select("party", "topic")
    men = men.select("party", "topic", F.lit(None).cast("double").alias("p_score"), F.lit(True).alias("_mention"))
    return ps.unionByName(men)


def _tally(j: DataFrame, by) -> DataFrame:
    """Topic votes and party mentions per key from (party topic rows x sign counts)."""
    p = F.col("p_score")
    vote = (F.when(p > 0, F.col("n_pos")).when(p < 0, F.col("n_neg")).otherwise(F.lit(0)))
    g = j.groupBy(*by).agg(
        F.sum(F.when(~F.col("_mention"), F.coalesce(vote, F.lit(0)))).alias("topic_votes"),
        F.sum(F.when(F.col("_mention"), F.coalesce(F.col("n_pos"), F.lit(0)))).alias("party_mentions"),
        F.max(~F.col("_mention")).alias("_has_position"))
    return g.select(*by, F.coalesce("topic_votes", F.lit(0)).cast("long").alias("topic_votes"),
                    F.coalesce("party_mentions", F.lit(0)).cast("long").alias("party_mentions"), "_has_position")


def voting_prediction(scores: DataFrame, party_scores: DataFrame, alias: DataFrame | None = None,
                      paper: str | None = None, places: int | None = 2) -> DataFrame:
    """Topic votes + party mentions per party, and their share in percent.

    Output ``(party, topic_votes, party_mentions, total_votes, pct)``.  One
    scan of the scores feeds one sign-count aggregate per topic, which is
    joined once with the party topic table (positions and mention topics).
    """
    counts = sign_counts(for_paper(scores, paper))
    j = _party_topics(party_scores, alias).join(counts, "topic", "left")
    out = _tally(j, ["party"]).where("_has_position").drop("_has_position")
    out = out.withColumn("total_votes", F.col("topic_votes") + F.col("party_mentions"))
    return out.withColumn("pct", share_pct("total_votes", places=places))


def voting_by_paper(scores: DataFrame, party_scores: DataFrame, alias: DataFrame | None = None,
                    total_label: str = TOTAL, places: int | None = 2) -> DataFrame:
    """A15 for every paper and overall (paper = ``total_label``) in one pass.

    Output ``(paper, party, topic_votes, party_mentions, total_votes, pct)``;
    the share is taken within each paper; a paper whose total is 0 gets NULL.
    Every party of the position table appears for every paper with scored
    rows (zero votes included), as in the per-paper prediction.
    """
    counts = sign_counts_by_paper(scores, total_label)
    # Left join: a paper whose topics meet no party still forms a (paper, NULL) group.
    j = counts.join(_party_topics(party_scores, alias), "topic", "left")
    tallied = _tally(j, ["paper", "party"]).drop("_has_position")
    # Dense paper x party grid: each aggregated paper explodes the array of parties of the (small) position
    # table - a scalar subquery, so nothing runs while the plan is built.
    zero = F.lit(0).cast("long")
    # (paper, NULL) only says that the paper exists; parties outside the position table are left out.
    named = party_scores.select("party").distinct().select("party", F.lit(True).alias("_known"))
    cells = tallied.join(named, "party", "left").select(
        "paper", F.when(F.col("_known"), F.col("party")).alias("party"), F.when(F.col("_known"), F.col("topic_votes")).alias("topic_votes"),
        F.when(F.col("_known"), F.col("party_mentions")).alias("party_mentions"))
    out = dense_cells(cells, "paper", "party", distinct_array(party_scores, "party"),
                      {"topic_votes": zero, "party_mentions": zero}).where("party is not null")
    out = out.withColumn("total_votes", F.col("topic_votes") + F.col("party_mentions"))
    return out.withColumn("pct", share_pct("total_votes", by=("paper",), places=places))


def outcome_matrix(pred_by_paper: DataFrame, papers: list[str], total_label: str = TOTAL,
                   value: str = "pct") -> DataFrame:
    """Predicted share per party, one column per paper plus ``total``.

    Pivot values are passed explicitly so Spark does not run a distinct job.
    """
    cols = list(papers) + ([total_label] if total_label not in papers else [])
    return (pred_by_paper.groupBy("party").pivot("paper", cols).agg(F.first(value))
            .orderBy("party"))


def _aliased(pred: DataFrame, alias: DataFrame | None) -> DataFrame:
    if alias is None:
        return pred.withColumn("actual_party", F.col("party"))
    a = alias.select(F.col("party").alias("_p"), F.col("actual_party"))
    return (pred.join(a, pred["party"] == a["_p"], "left")
            .withColumn("actual_party", F.coalesce("actual_party", "party")).drop("_p"))


def compare_actual(pred: DataFrame, actual: DataFrame, alias: DataFrame | None = None,
                   keys=()) -> DataFrame:
    """Align predicted and actual shares by party name (through an alias).

    ``alias(party, actual_party)`` renames predicted parties; unmapped names
    are used as they are.  Output ``(*keys, party, pred_pct, actual_pct)``.
    """
    p = _aliased(pred.select(*keys, "party", F.col("pct").alias("pred_pct")), alias)
    act = actual.select(F.col("party").alias("actual_party"), F.col("pct").alias("actual_pct"))
    return p.join(act, "actual_party", "inner").select(*keys, "party", "pred_pct", "actual_pct")


def prediction_mae(pred: DataFrame, actual: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Mean absolute error between aligned predicted and actual shares."""
    j = compare_actual(pred, actual, alias)
    return j.agg(F.avg(F.abs(F.col("pred_pct") - F.col("actual_pct"))).alias("mae"),
                 F.count(F.lit(1)).alias("n_parties"))


def mae_by_paper(pred_by_paper: DataFrame, actual: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """A17 per paper (the ``total`` paper included when present)."""
    j = compare_actual(pred_by_paper, actual, alias, keys=("paper",))
    return j.groupBy("paper").agg(F.avg(F.abs(F.col("pred_pct") - F.col("actual_pct"))).alias("mae"),
                                  F.count(F.lit(1)).alias("n_parties"))


def mention_share(counts: DataFrame, actual: DataFrame | None = None,
                  alias: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """Share of raw mention counts per party (and MAE when ``actual`` given).

    ``counts(party, count)``.  Returns ``(party, count, pct)`` or, with
    ``actual``, ``(party, count, pct, actual_pct, mae)`` where ``mae`` is the
    mean absolute error over all aligned parties (repeated on each row).
    """
    shares = counts.select("party", F.col("count").cast("long").alias("count")).withColumn(
        "pct", share_pct("count", places=places))
    if actual is None:
        return shares
    j = compare_actual(shares, actual, alias)
    j = j.join(shares.select("party", "count"), "party")
    err = F.abs(F.col("pred_pct") - F.col("actual_pct"))
    return j.select("party", "count", F.col("pred_pct").alias("pct"), "actual_pct",
                    F.avg(err).over(Window.partitionBy()).alias("mae"))
