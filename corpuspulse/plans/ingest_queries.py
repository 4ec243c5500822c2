"""Registered queries: ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuspulse.functions.text import GERMAN_MONTHS, decode_obfuscated, parse_event_time
from corpuspulse.operators import reports as R
from corpuspulse.operators import scans as SCN
from corpuspulse.plans import standins as S
from corpuspulse.plans.registry import HEADS, register, with_
from corpuspulse.plans.registry import OBS as OBS_SQL
from corpuspulse.session import scratch_table_path
from corpuspulse.sources import headlines as H
from corpuspulse.sources.keywords import keywords_from_text
from corpuspulse.sources.repair import repair_csv
from corpuspulse.sources.tables import driver_table

def _spellings(spark, sf):
    """Date strings in six source spellings derived from event times."""
    e = driver_table(spark, sf, "events").select("event_id", "ts")
    ts = F.col("ts")
    month_de = F.element_at(F.array(*[F.lit(m) for m in GERMAN_MONTHS]), F.month(ts))
    kind = (F.col("event_id") % 6).cast("int")
    long_de = F.concat(F.date_format(ts, "dd"), F.lit(". "), month_de, F.lit(" "), F.date_format(ts, "yyyy"))
    spelled = (F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
               .when(kind == 1, F.concat(F.date_format(ts, "d"), F.lit(". "), month_de, F.lit(" "),
                                         F.date_format(ts, "yyyy"), F.lit(", "), F.date_format(ts, "H.mm"), F.lit(" Uhr")))
               .when(kind == 2, long_de)
               .when(kind == 3, F.concat(F.lit("Aktualisiert am "), F.date_format(ts, "dd.MM.yyyy"),
                                         F.lit(" - "), F.date_format(ts, "HH:mm")))
               .when(kind == 4, F.base64(F.concat(long_de, F.lit(", "), F.date_format(ts, "HH:mm"), F.lit(" Uhr"))))
               .otherwise(F.concat(F.lit("2"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))))
    return e.select("event_id", kind.alias("kind"), spelled.alias("date_raw"))


@register("parse_event_time", """
SELECT event_id, CAST(event_id % 6 AS INT) AS kind,
       CASE event_id % 6
         WHEN 0 THEN date_trunc('second', ts)
         WHEN 1 THEN date_trunc('minute', ts)
         WHEN 2 THEN date_trunc('day', ts)
         WHEN 3 THEN date_trunc('day', ts)
         WHEN 4 THEN date_trunc('minute', ts)
         ELSE NULL END AS event_ts
FROM events""")
def q_parse_event_time(spark, sf):
    """Parse six spellings (ISO, German long with/without time, numeric with prefix and
    tail, base64-obfuscated, corrupt year) back to timestamps."""
    s = _spellings(spark, sf)
    raw = F.when(F.col("kind") == 4, decode_obfuscated("date_raw")).otherwise(F.col("date_raw"))
    return s.select("event_id", "kind", parse_event_time(raw).alias("event_ts"))


def _roundtrip(spark, sf):
    """Write headlines as dated text files per paper (two date spellings, or none), read them back."""
    path = scratch_table_path(spark, f"headline-files-{uuid.uuid4().hex}")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    h = S.heads(spark, sf).withColumn("date_raw", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2024-01-"), day))
                                      .when(F.col("doc_id") % 3 == 1, F.concat(day, F.lit(". Januar 2024"))).otherwise("-"))
    H.write_headlines(h, path, paper_col="paper")
    return H.read_written_headlines(spark, path)


@register("headline_files_roundtrip", with_(HEADS) + """
SELECT paper, CASE doc_id % 3 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d') || '. Januar 2024' ELSE '-' END AS date_raw,
       CASE WHEN doc_id % 3 < 2 THEN CAST(d AS TIMESTAMP) END AS event_ts, headline
FROM (SELECT *, DATE '2024-01-01' + CAST(doc_id % 28 AS INT) AS d FROM heads)""")
def q_headline_files_roundtrip(spark, sf):
    """S6 then S1: ``date - headline`` text files partitioned by paper, read back."""
    return _roundtrip(spark, sf)


@register("source_tag", """
SELECT page_id,
       replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.', ' ') || ' ' AS paper_compat,
       replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.', ' ') AS paper
FROM pages""")
def q_source_tag(spark, sf):
    """Newspaper tag from a (URL-encoded) file name ``headlines_<a>_<b> .txt``."""
    p = S.pages(spark, sf)
    host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    fname = F.concat(F.lit("headlines_"), F.regexp_replace(host, r"\.", "_"), F.lit("%20.txt"))
    return p.select("page_id", H.paper_from_file_name(fname, "compat").alias("paper_compat"),
                    H.paper_from_file_name(fname).alias("paper"))


@register("union_sources", with_(HEADS) + """
SELECT paper, lang, CAST(count(*) AS BIGINT) AS n, CAST(count(origin) AS BIGINT) AS n_with_origin
FROM (SELECT paper, lang, headline, 'de-file' AS origin FROM heads WHERE lang = 'de'
      UNION ALL SELECT paper, lang, headline, NULL AS origin FROM heads WHERE lang <> 'de') u
GROUP BY paper, lang""")
def q_union_sources(spark, sf):
    """S3/O2: append per-source frames by name; a column missing on one side becomes NULL."""
    h = S.heads(spark, sf).select("paper", "lang", "headline")
    u = R.union_all(h.where(F.col("lang") == "de").withColumn("origin", F.lit("de-file")),
                    h.where(F.col("lang") != "de"))
    return u.groupBy("paper", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("origin").alias("n_with_origin"))


_DEDUP_SQL = with_(HEADS) + """
SELECT doc_id, paper, headline FROM (
  SELECT doc_id, paper, headline, row_number() OVER (PARTITION BY headline ORDER BY paper, doc_id) AS rn
  FROM heads) t WHERE rn = 1"""


@register("dedup_first", _DEDUP_SQL)
def q_dedup_first(spark, sf):
    """First row per headline under (paper, doc_id)."""
    h = S.heads(spark, sf).select("doc_id", "paper", "headline")
    return R.dedup_first(h, "headline", ("paper", "doc_id"))


@register("dedup_first_salted", _DEDUP_SQL)
def q_dedup_first_salted(spark, sf):
    """W1, skew-safe form: salted two-level min, same survivors."""
    h = S.heads(spark, sf).select("doc_id", "paper", "headline")
    return R.dedup_first_salted(h, "headline", ("paper", "doc_id"))


def _collapsed(spark, sf):
    """Heads written as CSV by a naive writer: rows with a comma collapse into ``date``."""
    h = S.heads(spark, sf).select(F.col("doc_id").alias("row_id"), "paper", "headline")
    quoted = F.concat(F.lit('"'), F.regexp_replace("headline", '"', '""'), F.lit('"'))
    has_comma = F.col("headline").contains(",")
    return h.select(
        "row_id",
        F.when(has_comma, F.concat_ws(",", F.lit("2024-01-01"), quoted, F.col("paper")))
         .otherwise(F.lit("2024-01-01")).alias("date"),
        F.when(has_comma, F.lit(None).cast("string")).otherwise(F.col("headline")).alias("headline"),
        F.when(has_comma, F.lit(None).cast("string")).otherwise(F.col("paper")).alias("paper"))


@register("repair_csv", with_(HEADS) + """
SELECT doc_id AS row_id, '2024-01-01' AS date,
       headline, paper FROM heads""")
def q_repair_csv(spark, sf):
    """Split collapsed CSV rows back into date / headline / paper."""
    c = _collapsed(spark, sf)
    papers = S.heads(spark, sf).select("paper")
    fixed, _quarantine = repair_csv(c, papers)
    return fixed


@register("repair_csv_quarantine", with_(HEADS) + """
SELECT doc_id AS row_id, '2024-01-01,no paper,' || doc_id AS date FROM heads WHERE doc_id % 3 = 0""")
def q_repair_csv_quarantine(spark, sf):
    """Collapsed rows without any known paper go to quarantine, unchanged."""
    c = _collapsed(spark, sf)
    broken = c.where("row_id % 3 = 0").withColumns({
        "date": F.concat(F.lit("2024-01-01,no paper,"), F.col("row_id").cast("string")),
        "headline": F.lit(None).cast("string")})
    _fixed, quarantine = repair_csv(broken, S.heads(spark, sf).select("paper"))
    return quarantine.select("row_id", "date")


@register("keywords_from_text", """
SELECT CAST(doc_id AS VARCHAR) AS topic, CAST(generate_subscripts(phs, 1) - 1 AS INT) AS pos, unnest(phs) AS keyword
FROM (SELECT doc_id,
             list_filter(list_transform(
               flatten(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda l: string_split(trim(l), ', '))),
               lambda p: trim(regexp_replace(p, '^[\\s,]+|[\\s,]+$', '', 'g'))), lambda p: length(p) > 0) AS phs
      FROM documents) t""")
def q_keywords_from_text(spark, sf):
    """comma/line separated phrase files -> ordered (topic, pos, keyword)."""
    d = S.text_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("topic"), "text")
    return keywords_from_text(d)


_H1_SQL = """
SELECT page_id, CAST(0 AS INT) AS pos,
       trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         regexp_extract(html, '<article[^>]*>\\s*<h1[^>]*>([^<]*)</h1>', 1),
         '&#(39|x27);?', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'),
         '&nbsp;?', chr(160), 'g'), '&amp;?', '&', 'g')) AS headline
FROM pages"""


@register("extract_tag_text", _H1_SQL)
def q_extract_tag_text(spark, sf):
    """S8 JVM path: ``article > h1`` text by regular expression (no Python)."""
    from corpuspulse.sources.pages import extract_tag_text
    return extract_tag_text(S.pages(spark, sf), "article", "h1")


@register("extract_headlines", _H1_SQL)
def q_extract_headlines(spark, sf):
    """S8 rule path: pages parsed once per row in Arrow batches, one rule for all sites."""
    from corpuspulse.sources.pages import Rule, extract_headlines
    rules = [Rule(site="", record="article", headline="h1", date="const:-")]
    return extract_headlines(S.pages(spark, sf), rules).select("page_id", "pos", "headline")


# Site rules as data, one per rule kind, shaped to what ``pages`` holds (a caller lists one rule per site).
RULE_KINDS = {
    "attribute_stride": dict(site="", record="nav li", headline="a", topline="a@href", date="const:-", stride=2, offset=1),
    "url_date": dict(site="", record="article", headline="h1", date=r"url:/(\d+)"),
    "section": dict(site="", record="html", headline="title", section="@lang", allowed=("en", "fr"), date="const:-"),
    "fallback": dict(site=r"example\.(?:com|net)", record="article", headline="h2 || header || h1", date="const:-"),
    "previous": dict(site="", record="article", headline="h1", prev="a", prev_nth=2, date="const:-"),
}


def _site_rule(spark, sf, kind):
    from corpuspulse.sources.pages import Rule, extract_headlines
    return extract_headlines(S.pages(spark, sf), [Rule(**RULE_KINDS[kind])], parse_dates=False)


def _sql_text(expr: str) -> str:
    """Trimmed text with the references decoded that the invented pages hold."""
    for name, ch in (("#(39|x27)", "chr(39)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("nbsp", "chr(160)"), ("amp", "'&'")):
        expr = f"regexp_replace({expr}, '&{name};?', {ch}, 'g')"
    return f"trim({expr})"


@register("site_rule_attribute_stride", f"""
SELECT page_id, CAST((i - 2) / 2 AS INT) AS pos, links[i][1] || ': ' || {_sql_text('links[i][2]')} AS headline
FROM (SELECT page_id, list_zip(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1),
                               regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) AS links FROM pages) p,
     range(2, 1000, 2) AS r(i) WHERE i <= len(links)""")
def q_site_rule_attribute_stride(spark, sf):
    """Nested record selector, attribute value as topline, every second record."""
    return _site_rule(spark, sf, "attribute_stride").select("page_id", "pos", "headline")


@register("site_rule_url_date", f"""
SELECT page_id, {_sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS headline,
       nullif(regexp_extract(url, '/(\\d+)', 1), '') AS date_raw FROM pages""")
def q_site_rule_url_date(spark, sf):
    """The date comes from the page's address."""
    return _site_rule(spark, sf, "url_date").select("page_id", "headline", "date_raw")


@register("site_rule_section", f"""
SELECT page_id, {_sql_text("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS headline,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS section FROM pages
WHERE regexp_extract(html, '<html lang="([^"]*)"', 1) IN ('en', 'fr')""")
def q_site_rule_section(spark, sf):
    """Only records of allowed sections."""
    return _site_rule(spark, sf, "section").select("page_id", "headline", "section")


@register("site_rule_fallback", f"""
SELECT page_id, {_sql_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS headline FROM pages
WHERE regexp_matches(url, 'example\\.(com|net)')""")
def q_site_rule_fallback(spark, sf):
    """First value of several selectors that is present, for pages of some sites only."""
    return _site_rule(spark, sf, "fallback").select("page_id", "headline")


@register("site_rule_previous", f"""
SELECT page_id, {_sql_text('names[len(names) - 1]')} AS headline
FROM (SELECT page_id, regexp_extract_all(split_part(html, '<article>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS names FROM pages) p
WHERE len(names) >= 2""")
def q_site_rule_previous(spark, sf):
    """The headline is the second element before the record that matches a selector."""
    return _site_rule(spark, sf, "previous").select("page_id", "headline")


@register("carry_forward", """
SELECT conv_id, turn, role,
       last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn
FROM conversations""")
def q_carry_forward(spark, sf):
    """Last non-NULL value so far within a group (NULL before the first one)."""
    t = S.turns(spark, sf).select("conv_id", "turn", "role",
                                  F.when(F.col("role") == "user", F.col("turn")).alias("last_user_turn"))
    return SCN.carry_forward(t, "last_user_turn", ["conv_id"], ["turn"])


@register("carry_forward_one_group", """
SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS)
         OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_error
FROM events""")
def q_carry_forward_one_group(spark, sf):
    """W4 where one group holds all rows: the last error event so far, over all events in time order."""
    e = driver_table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_type") == "error", F.col("event_id")).alias("last_error"))
    return SCN.carry_forward(e, "last_error", [], ["ts", "event_id"]).select("event_id", "last_error")


@register("running_sum", """
SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
FROM events""")
def q_running_sum(spark, sf):
    """W4's scan as a sum: running total per event type, few groups over all rows."""
    e = driver_table(spark, sf, "events").select("event_id", "event_type", "ts", F.col("user_id").cast("long").alias("user_id"))
    return SCN.running_sum(e, "user_id", ["event_type"], ["ts", "event_id"]).select("event_id", "running")


@register("csv_roundtrip", with_(OBS_SQL) + """
SELECT obs_id, paper, topic, score FROM obs""")
def q_csv_roundtrip(spark, sf):
    """Write a stage table as CSV with a header, read it back with an explicit schema."""
    from corpuspulse.sources.tables import read_table, write_table
    path = scratch_table_path(spark, f"csv-{uuid.uuid4().hex}")
    o = S.obs(spark, sf).select("obs_id", "paper", "topic", "score")
    write_table(o, path, fmt="csv")
    return read_table(spark, path, fmt="csv", schema="obs_id long, paper string, topic string, score double")


@register("curated_partition_pruning", with_(HEADS) + """
SELECT doc_id, headline, paper FROM heads WHERE paper = 'src3'""")
def q_curated_partition_pruning(spark, sf):
    """S5 + F3: curated Parquet partitioned by paper; a paper filter prunes to one folder."""
    from corpuspulse.sources.tables import read_table, write_table
    path = scratch_table_path(spark, f"curated-{uuid.uuid4().hex}")
    write_table(S.heads(spark, sf).select("doc_id", "headline", "paper"), path, partition_by="paper")
    return read_table(spark, path).where(F.col("paper") == "src3").select("doc_id", "headline", "paper")


@register("in_section", """
SELECT source AS paper, lang AS section, CAST(count(*) AS BIGINT) AS n
FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1, 2""")
def q_in_section(spark, sf):
    """section membership filter (language as the section)."""
    from corpuspulse.operators.filters import in_section
    d = driver_table(spark, sf, "documents").select(F.col("source").alias("paper"), F.col("lang").alias("section"))
    return in_section(d, ["de", "fr"]).groupBy("paper", "section").agg(F.count(F.lit(1)).alias("n"))
