"""Lemmas by morphology: detachment rules, an exception table and a vocabulary, in place of a word-by-word map.

A word's candidates are the word itself, the words its exceptions name, or, without an exception, every word that a rule
makes of it by replacing an ending; only vocabulary words count.  The shortest candidate is the lemma (ties: the word
itself, then the order of the rules); a word without candidates stays.  The rules are run backwards over the vocabulary,
which gives all inflected forms at once: a table of at most (rules + 1) times the vocabulary plus the exceptions, whatever
the size of the corpus.  Texts meet it as a dictionary in their own tasks: all of it while it is small, else what a part's words need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.session import checkpoint_dir, ship_package

# Detachment rules of the public WordNet morphology (ending, replacement), nouns and verbs.
NOUN_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]
VERB_RULES = [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")]
SHIPPED_FORMS = 500_000   # forms that travel to the tasks as a dictionary; more are joined


def lemma_forms(vocabulary: DataFrame, rules=NOUN_RULES, exceptions: DataFrame | None = None) -> DataFrame:
    """``(form, lemma)`` of every form that is not its own lemma, from ``vocabulary(word)`` and ``exceptions(form, lemma)``.

    NULL and empty words are ignored, repeated ones count once; a form with several exceptions takes the shortest (ties:
    the smaller word).
    """
    words = vocabulary.select("word").where(F.length("word") > 0).distinct()
    rule = F.explode(F.array(*[F.struct(F.lit(s).alias("ending"), F.lit(r).alias("to"), F.lit(i + 1).alias("rank")) for i, (s, r) in enumerate(rules)]))
    inflected = words.select("word", rule.alias("r")).where(F.endswith("word", F.col("r.to"))).select(
        F.concat(F.expr("left(word, length(word) - length(r.to))"), F.col("r.ending")).alias("form"), F.col("word").alias("lemma"), F.col("r.rank").alias("rank"))
    own = words.select(F.col("word").alias("form"), F.col("word").alias("lemma"), F.lit(0).alias("rank"))
    if exceptions is not None:
        known = exceptions.select("form", "lemma").where("form is not null and lemma is not null").distinct()
        inflected = inflected.join(known.select("form").distinct(), "form", "left_anti").unionByName(
            known.join(words.select(F.col("word").alias("lemma")), "lemma", "left_semi").select("form", "lemma", F.lit(1).alias("rank")))
    best = own.unionByName(inflected).groupBy("form").agg(F.min(F.struct(F.length("lemma"), "rank", "lemma")).alias("b"))
    return best.select("form", F.col("b.lemma").alias("lemma")).where("form <> lemma")


def lemmatize(df: DataFrame, col: str, forms: DataFrame, out: str | None = None, shipped: int = SHIPPED_FORMS) -> DataFrame:
    """``df`` with the token array ``col`` lemmatised into ``out`` (default: in place); other words, NULL arrays and NULL tokens stay.

    Up to ``shipped`` forms travel as a dictionary and no row is shuffled; beyond that every part of the rows gets the forms it needs.
    """
    name = out or col
    ship_package(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    forms = forms.checkpoint()   # read twice, and dear to derive from a corpus
    tagged = df.withColumn(name, F.col(col).cast("array<string>"))
    table = forms.limit(shipped + 1).toArrow()
    if table.num_rows > shipped:
        return _by_parts(tagged, name, forms)
    of = dict(zip(table.column("form").to_pylist(), table.column("lemma").to_pylist()))

    def run(batches):
        for batch in batches:
            yield _mapped(batch, name, of)
    return tagged.mapInArrow(run, tagged.schema)


def _mapped(batch, name: str, of: dict):
    """An Arrow batch with the tokens of its list column ``name`` replaced through ``of``."""
    import pyarrow as pa
    at = batch.schema.get_field_index(name)
    column = batch.column(at)
    # Each distinct token of a batch is looked up once.
    tokens = column.values.dictionary_encode()
    lemmas = pa.array([t if t is None else of.get(t, t) for t in tokens.dictionary.to_pylist()], pa.string())
    offsets = column.offsets
    if column.null_count:
        import numpy as np
        offsets = pa.array(column.offsets.to_numpy(), pa.int32(), mask=np.append(~column.is_valid().to_numpy(zero_copy_only=False), False))
    new = pa.ListArray.from_arrays(offsets, lemmas.take(tokens.indices))
    return pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1:]], names=batch.schema.names)


def _by_parts(df: DataFrame, name: str, forms: DataFrame) -> DataFrame:
    """The same for any number of forms: each part of the rows gets the forms that its own words need.

    A part is a partition of ``df``, kept with its number.  Its distinct words meet the forms in a join, and what they need
    precedes the part's rows in one stream; a task holds the forms of one part, and tokens stay in their rows.
    """
    kept = df.withColumn("_part", F.spark_partition_id()).checkpoint()
    words = kept.select("_part", F.explode(name).alias("form")).distinct()
    needed = words.join(forms, "form").select("_part", F.col("form").alias("_form"), F.col("lemma").alias("_lemma"))
    both = needed.unionByName(kept, allowMissingColumns=True)
    parts = max(1, kept.rdd.getNumPartitions())
    stream = both.repartition(parts, "_part").sortWithinPartitions("_part", F.col("_form").isNull())
    cols = df.columns

    def run(batches):
        import numpy as np
        at, of = None, {}
        for batch in batches:
            part, row = batch.column("_part").to_numpy(), batch.column("_form").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (row[1:] != row[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)]):
                if a == b:
                    continue
                if part[a] != at:
                    at, of = part[a], {}
                piece = batch.slice(a, b - a)
                if row[a]:
                    yield _mapped(piece.select(cols), name, of)
                else:
                    of.update(zip(piece.column("_form").to_pylist(), piece.column("_lemma").to_pylist()))
    return stream.mapInArrow(run, df.schema)


def frequent_words(df: DataFrame, col: str, least: int) -> DataFrame:
    """``(word)``: words (tokens of the array ``col``) that occur at least ``least`` times: a vocabulary where none is given."""
    return df.select(F.explode(col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def lemma_families(df: DataFrame, col: str, forms: DataFrame) -> DataFrame:
    """``(lemma, n, forms)``: uses of each lemma in the token arrays, and how many different forms they take."""
    counts = df.select(F.explode(col).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(forms, "form", "left").withColumn("lemma", F.coalesce("lemma", "form"))
    return met.groupBy("lemma").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
