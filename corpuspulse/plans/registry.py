"""Registry of named report queries and their SQL oracles.

Each query is a function ``(spark, sf_dir) -> DataFrame``; its oracle is an
ANSI SQL text over the benchmark tables (as DuckDB views).  Floating results
are rounded to a fixed number of places on both sides so that summation
order does not change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# Shared SQL building blocks (the stand-in relations of plans.standins).
OBS = """obs AS (
  SELECT event_id AS obs_id, 'p' || CAST(user_id % 8 AS VARCHAR) AS paper, event_type AS topic,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value - 34 END AS score, ts AS event_ts
  FROM events)"""

PROG = """prog AS (
  SELECT 'q' || CAST(user_id % 7 AS VARCHAR) AS party, event_type AS topic,
         round(avg(value) - 49.63, 4) AS score
  FROM events GROUP BY 1, 2)"""

PARTY_ALIAS = """party_alias AS (
  SELECT * FROM (VALUES ('q0', 'view'), ('q1', 'click'), ('q2', 'error')) AS t(party, topic))"""

ACTUAL = """actual AS (
  SELECT party, CAST(pct AS DOUBLE) AS pct
  FROM (VALUES ('q0', 37.0), ('q1', 14.4), ('q2', 15.8), ('q3', 14.6), ('q4', 8.4),
               ('q5', 3.0), ('Q6', 1.5)) AS t(party, pct)),
actual_alias AS (SELECT * FROM (VALUES ('q6', 'Q6')) AS t(party, actual_party))"""

HEADS = """heads AS (
  SELECT doc_id, source AS paper, lang, replace(text, chr(10), ' ') AS headline FROM documents)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


KW = """kw AS (
  SELECT * FROM (VALUES ('conj', 0, 'and of'), ('conj', 1, 'that'), ('conj', 2, 'the'),
                        ('article', 0, 'the'), ('article', 1, 'an'),
                        ('pron', 0, 'this'), ('pron', 1, 'it is'), ('pron', 2, 'with')) AS t(topic, pos, keyword))"""


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(x) for x in items) + "]"


def sql_tokens(expr: str) -> str:
    """Whitespace tokens without empty strings (as ``functions.text.tokens``)."""
    return f"list_filter(regexp_split_to_array(trim({expr}), '\\s+'), lambda t: length(t) > 0)"


def sql_clean_en(col: str, stop=()) -> str:
    """SQL form of ``functions.text.clean_en`` (no lemma table)."""
    from corpuspulse.functions.text import ASCII_PUNCTUATION
    s = f"regexp_replace(translate(lower({col}), {sql_str(ASCII_PUNCTUATION)}, ''), '[^a-zA-Z\\s]', '', 'g')"
    toks = sql_tokens(s)
    if stop:
        toks = f"list_filter({toks}, lambda t: NOT list_contains({sql_list(stop)}, t))"
    return f"array_to_string({toks}, ' ')"
