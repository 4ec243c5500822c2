"""Scoring: lexicon polarity (M7), targeted scores (M9), pipelines (M10, M11),
programme means (A12, A13) and the caller-model hook (M8).

The lexicon scorer is one narrow pass: the hashes of a text's tokens meet the
lexicon inside the task (numpy over Arrow batches), hits are adjusted for
boosters and negators and summed per text.  A lexicon too large to travel with
the tasks is joined to the exploded tokens instead.  ``compound = s / sqrt(s^2 + alpha)`` is the published VADER
normalisation; booster and negation scalars are its published constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.functions.scores import label_score
from corpuspulse.functions.text import clean_en, paragraphs, tokens
from corpuspulse.functions.util import distinct_array, json_literal, let, let2
from corpuspulse.operators.topics import prepare_keywords, segments_array, small_keywords, topic_segments
from corpuspulse.session import broadcast_if_small, ship_package

# Fixed values of the VADER-style scorer.
ALPHA = 15.0
NEGATION_SCALAR = -0.74
BOOST_DECAY = [1.0, 0.95, 0.9]
LABEL_THRESHOLD = 0.05
SHIPPED_TOKENS = 500_000   # lexicon tokens that travel to the tasks; more are joined


def _boost_map(boosters) -> Column | None:
    if boosters is None:
        return None
    if isinstance(boosters, DataFrame):
        raise TypeError("boosters: pass a list of (token, boost) pairs")
    items = list(boosters)
    if not items:
        return None
    return json_literal({k: float(v) for k, v in items}, "map<string,double>")


def _lexicon_rows(lexicon: DataFrame) -> DataFrame:
    """One valence per token (duplicates -> their mean; a NULL token is left out)."""
    return (lexicon.where(F.col("token").isNotNull())
            .groupBy("token").agg(F.avg(F.col("valence").cast("double")).alias("valence")))


def _adjusted(v: Column, p1: Column, p2: Column, p3: Column, boosters, negators) -> Column:
    """Booster and negation rules on one lexicon hit ``v`` given its three preceding tokens."""
    bm = _boost_map(boosters)
    if bm is not None:
        adj = v
        for j, p in enumerate([p1, p2, p3]):
            b = F.coalesce(F.try_element_at(bm, p), F.lit(0.0))
            adj = adj + b * F.signum(v) * F.lit(BOOST_DECAY[j])
        v = adj
    if negators:
        words = list(negators)
        negated = F.coalesce(p1.isin(words), F.lit(False)) | F.coalesce(p2.isin(words), F.lit(False)) \
            | F.coalesce(p3.isin(words), F.lit(False))
        v = F.when(negated, v * F.lit(NEGATION_SCALAR)).otherwise(v)
    return v


def _normalise(s: Column) -> Column:
    s = F.coalesce(s, F.lit(0.0))
    return s / F.sqrt(s * s + F.lit(ALPHA))


def _compound_rows(rows: DataFrame, text_col: str, lexicon: DataFrame, boosters, negators, keep, out: str) -> DataFrame:
    """``(*keep, out)``: the compound of ``text_col`` for every row (repeated and NULL keys stay rows of their own).

    A lexicon of at most ``SHIPPED_TOKENS`` tokens travels with the tasks: each row's token hashes meet it there, so a row
    gives its own sum and nothing is exploded or shuffled.  A larger one is met in a join.
    """
    if isinstance(boosters, DataFrame):
        raise TypeError("boosters: pass a list of (token, boost) pairs")
    lex = _lexicon_rows(lexicon)
    table = lex.where("valence is not null").select(F.xxhash64("token").alias("h"), "valence").limit(SHIPPED_TOKENS + 1).toArrow()
    if table.num_rows > SHIPPED_TOKENS:
        return _joined_compound(rows, text_col, lex, boosters, negators, keep, out)
    ship_package(rows.sparkSession)
    table = table.sort_by("h")
    hashes, valence = table.column("h").to_numpy(), table.column("valence").to_numpy()
    given = rows.sparkSession.createDataFrame([(k, float(b)) for k, b in dict(boosters or ()).items()], "t string, b double")
    boosts = {r["h"]: r["b"] for r in given.select(F.xxhash64("t").alias("h"), "b").collect()} if boosters else {}
    nots = rows.sparkSession.createDataFrame([(k,) for k in negators or ()], "t string")
    negating = sorted(r["h"] for r in nots.select(F.xxhash64("t").alias("h")).collect()) if negators else []

    def run(batches):
        import numpy as np
        import pyarrow as pa
        boosting = np.array(sorted(boosts), dtype=np.int64)
        amount = np.array([boosts[h] for h in sorted(boosts)], dtype=float)
        negator = np.array(negating, dtype=np.int64)

        def found(keys, h):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return at, keys[at] == h

        for batch in batches:
            column = batch.column("_toks")
            h, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            s = np.zeros(batch.num_rows)
            if len(h) and len(hashes):
                at, known = found(hashes, h)
                hit = np.flatnonzero(known)
                v = valence[at[hit]]
                row = np.searchsorted(ends, hit, side="right")
                place = hit - np.append(0, ends)[row]
                sign, negated = np.sign(v), np.zeros(len(hit), dtype=bool)
                for j, decay in enumerate(BOOST_DECAY):
                    here = place > j
                    before = h[np.maximum(hit - j - 1, 0)]
                    if len(boosting):
                        b, ok = found(boosting, before)
                        v = v + np.where(here & ok, amount[b], 0.0) * sign * decay
                    if len(negator):
                        negated |= here & found(negator, before)[1]
                s = np.bincount(row, np.where(negated, v * NEGATION_SCALAR, v), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(s)], names=[*keep, "_s"])

    kinds = dict(rows.dtypes)
    hashed = F.transform(tokens(F.col(text_col)), lambda t: F.xxhash64(t))
    sums = rows.select(*keep, hashed.alias("_toks")).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "_s double"]))
    return sums.select(*keep, _normalise(F.col("_s")).alias(out))


def _joined_compound(rows: DataFrame, text_col: str, lex: DataFrame, boosters, negators, keep, out: str) -> DataFrame:
    """The same for a lexicon of any size: tokens are exploded with their three predecessors, met with it in a hash join
    and summed per row; the shuffle carries one row per text where the lexicon's measured bytes allow a broadcast."""
    staged = rows.select(*keep, F.monotonically_increasing_id().alias("_row"), tokens(F.col(text_col)).alias("_toks"))
    entries = let(F.col("_toks"), lambda tv: F.transform(tv, lambda t, i: F.struct(
        t.alias("token"), F.get(tv, i - 1).alias("p1"), F.get(tv, i - 2).alias("p2"),
        F.get(tv, i - 3).alias("p3"))))
    exploded = staged.select(*keep, "_row", F.explode_outer(entries).alias("e")).select(*keep, "_row", "e.*")
    hit = exploded.join(broadcast_if_small(lex), "token", "left")
    v = F.when(F.col("valence").isNotNull(),
               _adjusted(F.col("valence"), F.col("p1"), F.col("p2"), F.col("p3"), boosters, negators))
    return (hit.groupBy("_row", *keep).agg(F.sum(v).alias("_s"))
            .select(*keep, _normalise(F.col("_s")).alias(out)))


def lexicon_compound(texts: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     boosters=(), negators=(), out: str = "compound") -> DataFrame:
    """M7: whole-text polarity in [-1, 1] for every text (NULL or empty text -> 0).

    ``lexicon(token, valence)`` is an input table of any size; ``boosters`` a list of
    ``(token, boost)``; ``negators`` a list of tokens.  Returns ``(id, out)``, one row per input row.
    """
    return _compound_rows(texts, text_col, lexicon, boosters, negators, [id_col], out)


def compound_label(c) -> tuple[Column, Column]:
    """Three-way label and probability from a compound score."""
    c = F.col(c) if isinstance(c, str) else c
    label = (F.when(c > LABEL_THRESHOLD, F.lit("positive"))
             .when(c < -LABEL_THRESHOLD, F.lit("negative")).otherwise(F.lit("neutral")))
    return label, F.abs(c)


def _context(window: int, left: Column | None = None, right: Column | None = None) -> Column:
    left = tokens(F.col("left") if left is None else left)
    right = tokens(F.col("right") if right is None else right)
    return let2(left, right, lambda lt, rt: F.array_join(
        F.concat(F.slice(lt, F.greatest(F.size(lt) - window + 1, F.lit(1)), window), F.slice(rt, 1, window)), " "))


def target_sentiment(segments: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", window: int = 3,
                     boosters=(), negators=(), keep=()) -> DataFrame:
    """M9 (+P9, A13): score of each (left, target, right) triple.

    Default scorer: lexicon compound over the ``window`` tokens on each side
    of the target, turned into (label, p) and then into +p / 0 / -p.  One
    triple per (text, topic), so the target mean (A13) is the score itself.
    Output ``(id, *keep, topic, score)``.
    """
    cols = [id_col, *keep, "topic"]
    comp = _compound_rows(segments.select(*cols, _context(window).alias("_ctx")), "_ctx", lexicon, boosters, negators, cols, "_c")
    label, p = compound_label("_c")
    return comp.select(*cols, label_score(label, p).alias("score"))


def target_mean(label_scores: DataFrame, keys=("doc_id", "topic")) -> DataFrame:
    """Mean of the target scores of one text and topic (several targets -> their mean)."""
    return label_scores.groupBy(*keys).agg(F.avg("score").alias("score"))


def infer_targets(segments: DataFrame, scorer: Callable, id_col: str = "doc_id") -> DataFrame:
    """M9 with a caller's classifier: ``scorer(pandas DataFrame[left,target,right]) ->
    DataFrame[label, prob]``, run once per Arrow batch (see ``batch_infer``)."""
    lab = batch_infer(segments, ["left", "target", "right"], scorer, "label string, prob double")
    return lab.select(id_col, "topic", label_score("label", "prob").alias("score"))


_MODELS: dict = {}


def _worker_model(key: str, factory: Callable):
    """One model per Python worker process (workers are reused across tasks)."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


MODEL_ROWS, MODEL_CHARS = 1_000, 1_000_000   # a model meets at most so many rows, and about so many characters, at a time


def _model_parts(pdf, cols):
    """Consecutive pieces of a batch for the model; a single longer row is one piece."""
    import numpy as np
    import pandas as pd
    size = np.full(len(pdf), MODEL_CHARS / MODEL_ROWS)
    for c in cols:
        if not pd.api.types.is_numeric_dtype(pdf[c]):
            size += [len(v) if hasattr(v, "__len__") else 0 for v in pdf[c]]
    part = np.cumsum(size) // MODEL_CHARS
    at = [0, *(np.flatnonzero(np.diff(part)) + 1), len(pdf)]
    return [pdf.iloc[a:b] for a, b in zip(at, at[1:])]


def batch_infer(df: DataFrame, cols, factory: Callable, schema: str) -> DataFrame:
    """M8: apply a caller's model to columns, in pieces of Arrow batches (``MODEL_ROWS``, ``MODEL_CHARS``).

    ``factory()`` is called once per Python worker and must return a function
    ``pandas.DataFrame -> pandas.DataFrame`` with the columns of ``schema``;
    the input columns are appended back to the output rows (same order).
    """
    keep = df.columns
    out_schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + [schema])
    # Cache key: a digest of the pickled factory (code and captured values), so two
    # different factories - e.g. lambdas over different model paths - never share a model.
    import hashlib

    from pyspark import cloudpickle
    key = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()

    def run(batches):
        import pandas as pd
        model = _worker_model(key, factory)
        for batch in batches:
            for pdf in _model_parts(batch, cols):
                res = model(pdf[list(cols)].reset_index(drop=True)).reset_index(drop=True)
                yield pd.concat([pdf[keep].reset_index(drop=True), res], axis=1)

    ship_package(df.sparkSession)
    return df.mapInPandas(run, out_schema)


def _topic_texts(clean: DataFrame, kw: DataFrame, cols, mode: str, whole: bool) -> DataFrame:
    """``(*cols, topic, _txt, _whole)``: the context of every topic hit, and (``whole``) the text itself.

    One projection and one explode per text while the phrase list is small enough to travel in the plan; larger
    lists come from the gram join.  Without ``whole`` a text without hits gives one row with a NULL topic.
    """
    kw_rows = small_keywords(kw)
    entry = "array<struct<topic:string,_txt:string,_whole:boolean>>"
    if kw_rows is not None:
        def per_text(h: Column) -> Column:
            hits = F.transform(segments_array(h, kw_rows, mode), lambda x: F.struct(
                x["topic"].alias("topic"), _context(3, x["s"]["left"], x["s"]["right"]).alias("_txt"), F.lit(False).alias("_whole")))
            return F.concat(hits, F.array(F.struct(F.lit("whole").alias("topic"), h.alias("_txt"), F.lit(True).alias("_whole")))) \
                if whole else hits.cast(entry)
        return clean.select(*cols, F.explode_outer(let(F.col("_txt"), per_text)).alias("_r")).select(*cols, "_r.*")
    # Keyed by the row's content: a text row's hits come back to that row only, also for repeated or NULL ids.
    t = clean.withColumn("_key", F.xxhash64(*cols, "_txt"))
    segs = topic_segments(t.select("_key", "_txt").dropDuplicates(["_key"]), kw, "_key", "_txt", mode)
    hits = t.select(*cols, "_key").join(segs, "_key", "inner" if whole else "left").select(
        *cols, "topic", _context(3).alias("_txt"), F.lit(False).alias("_whole"))
    return hits.unionByName(t.select(*cols, F.lit("whole").alias("topic"), "_txt", F.lit(True).alias("_whole"))) if whole else hits


def _scored(rows: DataFrame, lexicon: DataFrame, boosters, negators, cols) -> DataFrame:
    """``(*cols, topic, score)``: signed label score of a context, plain compound of a whole text."""
    keep = [*cols, "topic", "_whole"]
    comp = _compound_rows(rows, "_txt", lexicon, boosters, negators, keep, "_c")
    label, p = compound_label("_c")
    return comp.select(*cols, "topic", F.when(F.col("_whole"), F.col("_c")).otherwise(label_score(label, p)).alias("score"))


def score_headlines(heads: DataFrame, keywords: DataFrame, lexicon: DataFrame, id_col: str = "doc_id",
                    text_col: str = "headline", keys=("paper",), stop_words=(), lemmas=None,
                    translate: Callable | None = None, boosters=(), negators=(), mode: str = "fixed") -> DataFrame:
    """Long scores ``(id, *keys, topic, score)`` including ``topic='whole'``.

    Steps: optional translation hook (M8) -> English cleaner (P3) -> topic
    match (J3) -> segmentation (P8) -> targeted score (M9); ``whole`` is the
    lexicon compound of the whole cleaned text (M7).  One scan, one explode
    into scored texts, one lexicon join.
    """
    cols = [id_col, *keys]
    src = heads.select(*cols, F.col(text_col).alias("_raw"))
    if translate is not None:
        src = batch_infer(src, ["_raw"], translate, "_en string").drop("_raw").withColumnRenamed("_en", "_raw")
    clean = src.select(*cols, clean_en(F.col("_raw"), stop_words, lemmas).alias("_txt"))
    rows = _topic_texts(clean, prepare_keywords(keywords, mode, stop_words, lemmas), cols, mode, whole=True)
    return _scored(rows, lexicon, boosters, negators, cols)


def programme_scores(par_scores: DataFrame, topics: DataFrame, party_col: str = "party") -> DataFrame:
    """Mean paragraph score per party x topic; topics without a hit -> 0.

    Parties are those of ``par_scores`` (a row with a NULL topic only names a party), topics those of the
    taxonomy table ``topics(topic)``.  The dense grid lives on the aggregated rows: each party explodes the
    topic array, no scored row is touched again.
    """
    means = par_scores.groupBy(party_col, "topic").agg(F.avg("score").alias("score"))
    grid = means.select(party_col).distinct().select(
        party_col, F.explode(distinct_array(topics.where("topic is not null"), "topic")).alias("topic"))
    m = means.select(F.col(party_col).alias("_p"), F.col("topic").alias("_t"), F.col("score").alias("_s"))
    return (grid.join(m, F.col(party_col).eqNullSafe(F.col("_p")) & (F.col("topic") == F.col("_t")), "left")
            .select(party_col, "topic", F.coalesce("_s", F.lit(0.0)).alias("score")))


def score_documents(docs: DataFrame, keywords: DataFrame, lexicon: DataFrame, id_col: str = "doc_id",
                    party_col: str = "party", stop_words=(), lemmas=None, translate: Callable | None = None,
                    boosters=(), negators=(), mode: str = "fixed") -> DataFrame:
    """Programme documents -> paragraphs (P11) -> cleaned -> J3/P8 -> M9 -> A12.

    Output ``party_score(party, topic, score)``; the documents are read once.
    """
    par = paragraphs(docs.select(id_col, party_col, "text"), "text", keep=(party_col,), outer=True)
    if translate is not None:
        par = batch_infer(par, ["paragraph"], translate, "_en string").drop("paragraph") \
            .withColumnRenamed("_en", "paragraph")
    clean = par.select(party_col, clean_en(F.col("paragraph"), stop_words, lemmas).alias("_txt"))
    rows = _topic_texts(clean, prepare_keywords(keywords, mode, stop_words, lemmas), [party_col], mode, whole=False)
    return programme_scores(_scored(rows, lexicon, boosters, negators, [party_col]), keywords, party_col)
