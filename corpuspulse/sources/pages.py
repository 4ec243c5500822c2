"""Headline extraction from a ``pages(page_id, url, html)`` table.

Two paths:

* ``extract_tag_text`` - a single ``<record> <field>`` rule as JVM regular
  expressions (``regexp_extract_all`` + ``explode``) for simple layouts; the
  short captured texts are then cleaned (inner tags, entities) batch by batch;
* ``extract_headlines`` - a rule table evaluated by ``mapInPandas`` over
  Arrow batches.  Each page is parsed once with the standard library's
  ``html.parser`` into a flat element list; a rule picks record elements and
  reads headline / topline / section / date from them.  Dates parsed and
  carried forward afterwards with Spark functions (P1, W4).

Rule vocabulary (``Rule`` fields): record selector, attribute or text values
with ``||`` fallbacks, section membership filter, stride, previous-element
hop, stop-at, positional zip with page-level elements, composed text, URL
dates, constants.  Selectors: ``tag``, ``.class``, ``tag.class``,
``tag[attr]``, ``tag[attr=value]``, joined by blanks for descendants.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuspulse.functions.scores import compose
from corpuspulse.functions.text import parse_event_time
from corpuspulse.session import ship_package

VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "wbr"}


@dataclasses.dataclass(frozen=True)
class Rule:
    """One site's extraction rule (all selectors are relative to the record unless noted)."""
    site: str                        # regular expression searched in the URL (selects the rule)
    record: str                      # record selector (page level)
    headline: str                    # value spec: 'text' | '@attr' | 'sel' | 'sel@attr'; '||' fallbacks
    topline: str | None = None       # value spec, composed as 'topline: headline'
    section: str | None = None       # value spec whose text must be in ``allowed``
    allowed: tuple = ()
    date: str | None = None          # value spec | 'url:<regex with one group>' | 'const:<text>'
    date_zip: str | None = None      # page-level selector; i-th match dates the i-th record
    stride: int = 1                  # keep every ``stride``-th record ...
    offset: int = 0                  # ... starting at this index
    prev: str | None = None          # headline from the nearest previous element matching this selector
    prev_skip_class: str | None = None
    prev_nth: int = 1                # ... the n-th such element going backwards
    stop_at: str | None = None       # ignore records after the first element matching this selector
    start_at: str | None = None      # ignore records before the first element matching this selector
    record_has: str | None = None    # keep records containing an element matching this selector
    date_scope: str = "record"       # 'record' or 'page': where the date spec is evaluated
    date_after: str | None = None    # keep the text after this marker (only when it splits in two)
    date_regex: str | None = None    # keep the first match of this pattern (group 1 if any)
    date_b64: bool = False           # the date value is base64 text
    carry_date: bool = False         # records without a date reuse the last dated record's date


def rules_frame(spark, rules) -> DataFrame:
    """Rules as a DataFrame (for inspection / storage); the extractor takes the list."""
    rows = [dataclasses.asdict(r) | {"allowed": list(r.allowed)} for r in rules]
    return spark.createDataFrame(rows)


# --- small DOM over html.parser --------------------------------------------------------------

def _parse(doc: str):
    from html.parser import HTMLParser

    elems: list[dict] = []   # each: tag, attrs, parent, text parts, children
    stack: list[int] = []

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            e = {"tag": tag, "attrs": dict((k, v if v is not None else "") for k, v in attrs),
                 "parent": stack[-1] if stack else -1, "parts": [], "idx": len(elems)}
            elems.append(e)
            if stack:
                elems[stack[-1]]["parts"].append(e["idx"])
            if tag not in VOID:
                stack.append(e["idx"])

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in VOID and stack and elems[stack[-1]]["tag"] == tag:
                stack.pop()

        def handle_endtag(self, tag):
            for i in range(len(stack) - 1, -1, -1):
                if elems[stack[i]]["tag"] == tag:
                    del stack[i:]
                    return

        def handle_data(self, data):
            if stack:
                elems[stack[-1]]["parts"].append(data)

    p = P(convert_charrefs=True)
    p.feed(doc or "")
    p.close()
    return elems


def _text(elems, i: int, sep: str = "") -> str:
    out, todo = [], [i]
    while todo:  # depth first without recursion: pages may leave any number of tags open
        part = todo.pop()
        if isinstance(part, int):
            todo.extend(reversed(elems[part]["parts"]))
        else:
            out.append(part)
    if sep:
        return sep.join(s.strip() for s in out if s.strip())
    return "".join(out).strip()


_SIMPLE = re.compile(r"^(?P<tag>[a-zA-Z0-9]*)(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)(?:=(?P<val>[^\]]*))?\])?$")


def _match_simple(e, sel: str) -> bool:
    m = _SIMPLE.match(sel)
    if not m:
        return False
    if m["tag"] and e["tag"] != m["tag"].lower():
        return False
    if m["cls"] and m["cls"] not in e["attrs"].get("class", "").split():
        return False
    if m["attr"]:
        if m["attr"] not in e["attrs"]:
            return False
        if m["val"] is not None and e["attrs"][m["attr"]] != m["val"].strip("'\""):
            return False
    return True


def _descendants(elems, root: int):
    if root < 0:
        return [e["idx"] for e in elems]
    out, todo = [], [root]
    while todo:
        j = todo.pop()
        if j != root:
            out.append(j)
        todo.extend(part for part in reversed(elems[j]["parts"]) if isinstance(part, int))
    return out


def _select(elems, sel: str, root: int = -1):
    """Elements under ``root`` (document when -1) matching a descendant selector, in document order."""
    parts = sel.split()
    cur = [root]
    for k, simple in enumerate(parts):
        nxt = []
        seen = set()
        for r in cur:
            for j in _descendants(elems, r):
                if j not in seen and _match_simple(elems[j], simple):
                    seen.add(j)
                    nxt.append(j)
        cur = sorted(nxt)
    return cur


def _value(elems, spec: str | None, rec: int, url: str):
    if spec is None:
        return None
    for alt in spec.split("||"):
        alt = alt.strip()
        v = None
        if alt == "text":
            v = _text(elems, rec, " ") if rec >= 0 else None
        elif alt.startswith("const:"):
            v = alt[len("const:"):]
        elif alt.startswith("url:"):
            m = re.search(alt[len("url:"):], url or "")
            v = (m.group(1) if m.groups() else m.group(0)) if m else None
        elif alt.startswith("@"):
            v = elems[rec]["attrs"].get(alt[1:]) if rec >= 0 else None
        else:
            sel, _, attr = alt.partition("@")
            hits = _select(elems, sel, rec)
            if hits:
                v = elems[hits[0]]["attrs"].get(attr) if attr else _text(elems, hits[0], " ")
        if v is not None and v != "":
            return v
    return None


def _date_text(rule: Rule, raw):
    if raw is None:
        return None
    if rule.date_b64:
        import base64
        import binascii
        try:
            raw = base64.b64decode(raw).decode("utf-8")
        except (binascii.Error, ValueError):
            return None
    if rule.date_after is not None:
        parts = raw.split(rule.date_after)
        raw = parts[1].strip() if len(parts) == 2 else None
    if raw is not None and rule.date_regex:
        m = re.search(rule.date_regex, raw)
        raw = (m.group(1) if m.groups() else m.group(0)) if m else None
    return raw


def extract_page(rule: Rule, url: str, doc: str):
    """All (pos, headline, topline, section, date_raw) of one page under one rule."""
    elems = _parse(doc)
    recs = _select(elems, rule.record)
    if rule.start_at:
        first = _select(elems, rule.start_at)
        recs = [r for r in recs if first and r > first[0]]
    if rule.stop_at:
        stops = [s for s in _select(elems, rule.stop_at) if not recs or s > recs[0]]
        if stops:
            recs = [r for r in recs if r < stops[0]]
    if rule.record_has:
        recs = [r for r in recs if _select(elems, rule.record_has, r)]
    recs = recs[rule.offset::max(rule.stride, 1)]
    zipped = _select(elems, rule.date_zip) if rule.date_zip else None
    page_date = _date_text(rule, _value(elems, rule.date, -1, url) if rule.date and rule.date_scope == "page"
                           and not rule.date.startswith(("const:", "url:")) else None)
    prev_all = _select(elems, rule.prev) if rule.prev else []
    out = []
    for pos, r in enumerate(recs):
        if rule.prev:
            cands = [j for j in prev_all if j < r and not (
                rule.prev_skip_class and rule.prev_skip_class in elems[j]["attrs"].get("class", "").split())]
            head = _text(elems, cands[-rule.prev_nth], " ") if len(cands) >= rule.prev_nth else None
        else:
            head = _value(elems, rule.headline, r, url)
        top = _value(elems, rule.topline, r, url)
        sec = _value(elems, rule.section, r, url)
        if rule.section and sec not in rule.allowed:
            continue
        if rule.date_scope == "page" and rule.date and not rule.date.startswith(("const:", "url:")):
            date = page_date
        elif zipped is not None:
            date = _date_text(rule, _value(elems, rule.date, zipped[pos], url)) if pos < len(zipped) else None
        else:
            date = _date_text(rule, _value(elems, rule.date, r, url))
        if head is None:
            continue
        out.append((pos, head, top, sec, date))
    return out


def extract_headlines(pages: DataFrame, rules, parse_dates: bool = True) -> DataFrame:
    """``(page_id, url, site, pos, headline, section, date_raw, event_ts)`` for every record.

    The rule list is small configuration and travels in the task closure;
    pages are processed in Arrow batches, one parse per page.
    """
    rules = list(rules)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for pid, url, doc in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                for rule in rules:
                    if rule.site and not re.search(rule.site, url or ""):
                        continue
                    for pos, head, top, sec, date in extract_page(rule, url, doc):
                        rows.append((pid, url, rule.site, pos, head, top, sec, date, rule.carry_date))
                    break
            yield pd.DataFrame(rows, columns=["page_id", "url", "site", "pos", "headline", "topline",
                                              "section", "date_raw", "_carry"])

    schema = ("page_id long, url string, site string, pos int, headline string, topline string, "
              "section string, date_raw string, _carry boolean")
    ship_package(pages.sparkSession)
    out = pages.select("page_id", "url", "html").mapInPandas(run, schema)
    out = out.withColumn("headline", compose("topline", "headline")).drop("topline")
    if parse_dates:
        out = out.withColumn("event_ts", parse_event_time("date_raw"))
    if parse_dates and any(r.carry_date for r in rules):
        # Records without a date reuse the last date on the page when the rule says so.
        w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        carried = F.last("event_ts", ignorenulls=True).over(w)
        out = out.withColumn("event_ts", F.when(F.col("_carry") & F.col("event_ts").isNull(), carried)
                             .otherwise(F.col("event_ts")))
    return out.drop("_carry")


def inner_text(content: str | None) -> str | None:
    """Text of a captured element: inner tags cut out, references decoded (all names, as HTML parsers do)."""
    import html
    if content is None:
        return None
    if "<" not in content and "&" not in content:
        return content.strip()
    parts = (html.unescape(x).strip() for x in re.split(r"<!--.*?-->|<[^>]*>", content, flags=re.S))
    return " ".join(x for x in parts if x)


def extract_tag_text(pages: DataFrame, record: str = "article", field: str = "h1") -> DataFrame:
    """S8, JVM path: text of every ``<field>`` directly opening a ``<record>`` element.

    Output ``(page_id, pos, headline)``.  Tag names match in any case, inline markup inside the field is cut
    out, and entity references are decoded.
    """
    pat = rf"(?is)<{record}\b[^>]*>\s*<{field}\b[^>]*>(.*?)</{field}\s*>"
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(pat), 1)).alias("pos", "_c"))
    state = T.StructType([found.schema["page_id"], T.StructField("pos", T.IntegerType()), T.StructField("headline", T.StringType())])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            text = pa.array([inner_text(c) for c in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=state.names)

    ship_package(pages.sparkSession)
    return found.mapInArrow(run, state)
