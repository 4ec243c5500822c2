"""Registered queries: the learned text encoder (M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuspulse.operators import embedding as E
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import register

SIZE = 20_000

WORDS = f"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{E.TOKEN}') AS t FROM documents),
words AS (
  SELECT row_number() OVER (ORDER BY n DESC, word) - 1 AS idx, word, n FROM (
    SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM tok) GROUP BY word HAVING count(*) >= 2)
  ORDER BY n DESC, word LIMIT {SIZE})"""

COUNTS = WORDS + f""",
pair AS (
  SELECT t[p] AS a, t[p + o] AS b FROM (SELECT t, unnest(generate_series(1, len(t))) AS p FROM tok), range(1, {E.WINDOW} + 1) AS r(o)
  WHERE p + o <= len(t)),
one AS (SELECT x.idx AS i, y.idx AS j, count(*) AS n FROM pair JOIN words x ON x.word = a JOIN words y ON y.word = b GROUP BY 1, 2),
counts AS (SELECT i, j, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM one UNION ALL SELECT j, i, n FROM one) GROUP BY 1, 2)"""

PPMI = COUNTS + """,
side AS (SELECT i, sum(n) AS s FROM counts GROUP BY i),
cells AS (
  SELECT counts.i, counts.j, ln(CAST(n AS DOUBLE) * (SELECT sum(n) FROM counts) / (CAST(x.s AS DOUBLE) * y.s)) AS v
  FROM counts JOIN side x ON x.i = counts.i JOIN side y ON y.i = counts.j)"""


def _docs(spark, sf):
    return S.text_table(spark, sf, "documents").select("doc_id", "text")


def _words(spark, sf):
    return E.vocabulary(_docs(spark, sf), size=SIZE).persist()


@register("word_cooccurrence", f"WITH {COUNTS}\nSELECT x.word, y.word AS context, counts.n FROM counts JOIN words x ON x.idx = i JOIN words y ON y.idx = j")
def q_word_cooccurrence(spark, sf):
    """M1: co-occurrence counts of vocabulary words over whole texts."""
    words = _words(spark, sf)
    named = words.select(F.col("idx").alias("i"), "word"), words.select(F.col("idx").alias("j"), F.col("word").alias("context"))
    return E.cooccurrence(_docs(spark, sf), words).join(named[0], "i").join(named[1], "j").select("word", "context", "n")


@register("word_ppmi", f"WITH {PPMI}\nSELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v, 6) AS v FROM cells WHERE v > 0 AND round(v, 6) > 0")
def q_word_ppmi(spark, sf):
    """M1: positive pointwise mutual information of vocabulary words (cells that do not round to 0)."""
    out = E.ppmi(E.cooccurrence(_docs(spark, sf), _words(spark, sf)).persist())
    return out.select("i", "j", F.round("v", 6).alias("v")).where("v > 0")


def _pattern(words: int):
    """Fixed thin matrix of the checks: two columns of small numbers by word number."""
    import numpy as np
    at = np.arange(words)
    return np.stack([at % 7 - 3.0, at % 5 - 2.0], axis=1)


@register("ppmi_product", f"""WITH {PPMI}
SELECT word, round(sum(v * (j % 7 - 3)), 4) + 0.0 AS y1, round(sum(v * (j % 5 - 2)), 4) + 0.0 AS y2
FROM cells JOIN words ON words.idx = i WHERE v > 0 GROUP BY word""")
def q_ppmi_product(spark, sf):
    """M1: the distributed product of the randomised SVD, here with a fixed thin matrix."""
    words = _words(spark, sf)
    rows = E.sparse_rows(E.ppmi(E.cooccurrence(_docs(spark, sf), words).persist()))
    out = E.times(rows, _pattern(words.count())).join(words.select(F.col("idx").alias("i"), "word"), "i")
    return out.select("word", *[(F.round(F.col("y")[k], 4) + 0.0).alias(f"y{k + 1}") for k in range(2)])


@register("text_vectors_given_words", f"""WITH {WORDS},
w AS (SELECT word, {E.RARE} / ({E.RARE} + n / (SELECT sum(n) FROM words)) AS w, idx % 7 - 3 AS a, idx % 5 - 2 AS b FROM words),
hit AS (SELECT doc_id, w, a, b FROM (SELECT doc_id, unnest(t) AS word FROM tok) JOIN w USING (word)),
m AS (SELECT doc_id, sum(w * a) / count(*) AS x1, sum(w * b) / count(*) AS x2 FROM hit GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN round(coalesce(x1, 0), 6) + 0.0 END AS x1,
       CASE WHEN text IS NOT NULL THEN round(coalesce(x2, 0), 6) + 0.0 END AS x2
FROM documents d LEFT JOIN m USING (doc_id)""")
def q_text_vectors(spark, sf):
    """M1: frequency-weighted text vectors from given word vectors (the encoder's last step)."""
    words = _words(spark, sf)
    out = E.encode(_docs(spark, sf), E.encoder(words, _pattern(words.count())), unit=False)
    return out.select("doc_id", *[(F.round(F.col("embedding")[k], 6) + 0.0).alias(f"x{k + 1}") for k in range(2)])


@register("embed_text_learned")
def q_embed_text_learned(spark, sf):
    """M1: text vectors by an encoder learned from all documents (tests: singular values, neighbours)."""
    return E.embed_learned(_docs(spark, sf), "text", 64)
