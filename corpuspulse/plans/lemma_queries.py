"""Registered queries: lemmas by morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.operators import lemmas as L
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import register

RULES = [*L.NOUN_RULES, *L.VERB_RULES[2:]]
EXCEPTIONS = [("whing", "the"), ("edly", "and"), ("tioned", "of"), ("thes", "this")]   # parameter table, as a caller would pass it
LEAST = 3

FORMS = f"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zäöüß]+') AS t FROM documents),
uses AS (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM tok) GROUP BY word),
vocab AS (SELECT word FROM uses WHERE n >= {LEAST}),
rules AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{r}', {i + 1})" for i, (s, r) in enumerate(RULES))}) AS t(ending, repl, rank)),
exc AS (SELECT * FROM (VALUES {', '.join(str(e) for e in EXCEPTIONS)}) AS t(form, lemma)),
cand AS (
  SELECT word AS form, word AS lemma, 0 AS rank FROM vocab
  UNION ALL SELECT left(word, length(word) - length(repl)) || ending, word, rank FROM vocab, rules
            WHERE ends_with(word, repl) AND left(word, length(word) - length(repl)) || ending NOT IN (SELECT form FROM exc)
  UNION ALL SELECT form, lemma, 1 FROM exc WHERE lemma IN (SELECT word FROM vocab)),
forms AS (
  SELECT form, lemma FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY length(lemma), rank, lemma) AS k FROM cand)
  WHERE k = 1 AND form <> lemma)"""


def _tokens(spark, sf):
    d = S.text_table(spark, sf, "documents")
    return d.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüß]+"), F.lit(0)).alias("t"))


def _forms(spark, tokens):
    exceptions = spark.createDataFrame(EXCEPTIONS, "form string, lemma string")
    return L.lemma_forms(L.frequent_words(tokens, "t", LEAST), RULES, exceptions)


@register("lemma_texts", f"""WITH {FORMS},
x AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM tok)
SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(s, '') END AS lemmas FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY p) AS s FROM x LEFT JOIN forms ON form = w GROUP BY doc_id) USING (doc_id)""")
def q_lemma_texts(spark, sf):
    """Whole texts lemmatised by rules, exceptions and a vocabulary from the documents."""
    tokens = _tokens(spark, sf)
    out = L.lemmatize(tokens, "t", _forms(spark, tokens))
    return out.select("doc_id", F.array_join("t", " ").alias("lemmas"))


@register("lemma_families", f"""WITH {FORMS}
SELECT coalesce(lemma, word) AS lemma, CAST(sum(n) AS BIGINT) AS n, count(*) AS forms FROM uses LEFT JOIN forms ON form = word GROUP BY 1""")
def q_lemma_families(spark, sf):
    """Uses per lemma over all documents, and the number of forms met."""
    tokens = _tokens(spark, sf)
    return L.lemma_families(tokens, "t", _forms(spark, tokens))
