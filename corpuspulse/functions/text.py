"""Text and date column functions (P1-P5, P11, P15), built from Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuspulse.functions.util import json_literal, let

# German month names in calendar order (1..12).
GERMAN_MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni",
                 "Juli", "August", "September", "Oktober", "November", "Dezember"]

# Fixed value: the ASCII punctuation set removed by the English cleaner.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _month_map() -> Column:
    pairs = []
    for i, m in enumerate(GERMAN_MONTHS, start=1):
        pairs += [F.lit(m), F.lit(i)]
    return F.create_map(*pairs)


def _ts(y: Column, mo: Column, d: Column, h: Column | None = None, mi: Column | None = None,
        s: Column | None = None) -> Column:
    """Strictly validated timestamp from parts (NULL for impossible dates)."""
    h = F.coalesce(h, F.lit("0")) if h is not None else F.lit("0")
    mi = F.coalesce(mi, F.lit("0")) if mi is not None else F.lit("0")
    s = F.coalesce(s, F.lit("0")) if s is not None else F.lit("0")
    txt = F.concat_ws(" ", F.concat_ws("-", y, mo.cast("string"), d), F.concat_ws(":", h, mi, s))
    return F.try_to_timestamp(txt, F.lit("y-M-d H:m:s"))


def parse_event_time(c) -> Column:
    """One timestamp (``timestamp_ntz``) from the spellings seen in headline sources.

    * ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss`` (a 5-digit year is rejected);
    * ``d. Monat yyyy, H.mm Uhr`` and ``dd. Monat yyyy, HH:mm Uhr``;
    * ``dd. Monat yyyy``;
    * ``dd.MM.yyyy``, optional ``Aktualisiert am `` prefix, optional `` - ...`` tail;
    * anything else (``-``, unknown month, corrupt year) -> NULL.
    """
    def parts(x: Column, pattern: str) -> Column:
        """All groups of the pattern by one replace of the whole text, '' where it does not match."""
        groups = pattern.count("(") - pattern.count("(?")
        whole = F.regexp_replace(x, f"^(?:{pattern})$", "\u0001".join(f"${i}" for i in range(1, groups + 1)))
        return F.split(whole, "\u0001")

    def build(x: Column) -> Column:
        # One cheap test picks the spelling; only that spelling's pattern then runs, once.
        iso = r"(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2}):(\d{2}))?"
        named = r"(?s:.*?)(\d{1,2})\. (\p{L}+) (\d{4})(?:, (\d{1,2})[.:](\d{2}) Uhr)?(?s:.*)"
        number = r"(?:Aktualisiert am )?(\d{2})\.(\d{2})\.(\d{4})(?: - .*)?"
        part = lambda p, i: F.nullif(F.get(p, i), F.lit(""))
        iso_ts = let(parts(x, iso), lambda p: F.when(F.size(p) == 6, _ts(
            part(p, 0), part(p, 1).cast("int"), part(p, 2), part(p, 3), part(p, 4), part(p, 5))))
        named_ts = let(parts(x, named), lambda p: F.when((F.size(p) == 5) & F.element_at(_month_map(), F.get(p, 1)).isNotNull(), _ts(
            part(p, 2), F.element_at(_month_map(), F.get(p, 1)), part(p, 0), part(p, 3), part(p, 4))))
        number_ts = let(parts(x, number), lambda p: F.when(F.size(p) == 3, _ts(part(p, 2), part(p, 1).cast("int"), part(p, 0))))
        return (F.when(F.substring(x, 5, 1) == "-", iso_ts)
                .when(x.contains(". "), F.coalesce(named_ts, number_ts)).otherwise(number_ts))

    return let(F.trim(_c(c)), build).cast("timestamp_ntz")


def decode_obfuscated(c) -> Column:
    """Base64 text (a date hidden in a page attribute) -> string; invalid input -> NULL."""
    return F.try_to_binary(_c(c), F.lit("base64")).cast("string")


def text_after(c, marker: str = "vom") -> Column:
    """The text after ``marker`` only when the text has exactly two parts."""
    parts = F.split(_c(c), "\\Q" + marker.replace("\\E", "\\E\\\\E\\Q") + "\\E")  # literal marker
    return F.when(F.size(parts) == 2, F.regexp_replace(F.element_at(parts, 2), r"^\s+|\s+$", ""))


def is_shouting(c) -> Column:
    """P5 predicate: whole text upper-case and containing a cased letter (``'123'`` is not)."""
    c = _c(c)
    return (F.upper(c) == c) & (F.lower(c) != c)


def tokens(c, pattern: str = r"\s+") -> Column:
    """Whitespace tokens without empty strings."""
    return F.filter(F.split(F.trim(_c(c)), pattern), lambda t: F.length(t) > 0)


def without(arr, stop_words, case_insensitive: bool = False) -> Column:
    """Drop stop words from a token array (duplicates of other words kept).

    ``stop_words`` is a Python list (a parameter, a hashed set in the plan) or an array Column.
    """
    low = F.lower if case_insensitive else (lambda t: t)
    if isinstance(stop_words, Column):
        return F.filter(arr, lambda t: ~F.array_contains(stop_words, low(t)))
    words = list(stop_words)  # a literal set: hashed lookup per token
    return F.filter(arr, lambda t: ~low(t).isin(words)) if words else arr


def lemma(arr, lemmas: dict[str, str] | Column | None) -> Column:
    """Map each token through a lemma table (unmapped tokens stay)."""
    if lemmas is None:
        return arr
    m = lemmas if isinstance(lemmas, Column) else (
        json_literal(dict(lemmas), "map<string,string>") if lemmas else None)
    if m is None:
        return arr
    return F.transform(arr, lambda t: F.coalesce(F.try_element_at(m, t), t))


def clean_en(c, stop_words=(), lemmas=None) -> Column:
    """Lower, strip ASCII punctuation (joins ``don't`` -> ``dont``), keep ``[a-zA-Z\\s]``,
    drop stop words, lemmatise, re-join with single spaces."""
    s = F.lower(_c(c))
    # ASCII punctuation and digits go with one cheap translate; the regex then
    # only meets the rare non-ASCII runs (10x faster than a per-character class
    # replace on raw text, same result).
    s = F.translate(s, ASCII_PUNCTUATION + DIGITS, "")
    s = F.regexp_replace(s, r"[^a-z\s]+", "")
    toks = tokens(s)
    if stop_words:
        toks = without(toks, list(stop_words))
    return F.array_join(lemma(toks, lemmas), " ")


def clean_de(c, stop_words=(), lemmas=None) -> Column:
    """NULL when shouting; ``-`` -> space; keep letters incl. umlauts (case kept);
    drop stop words case-insensitively; lemmatise; re-join."""
    c = _c(c)
    s = F.translate(c, "-", " ")
    s = F.translate(s, ASCII_PUNCTUATION.replace("-", "") + DIGITS, "")
    s = F.regexp_replace(s, r"[^a-zA-ZäöüÄÖÜß\s]+", "")
    toks = tokens(s)
    if stop_words:
        toks = without(toks, [w.lower() for w in stop_words], case_insensitive=True)
    out = F.array_join(lemma(toks, lemmas), " ")
    return F.when(is_shouting(c), F.lit(None).cast("string")).otherwise(out)


def paragraphs(docs: DataFrame, text: str = "text", keep=("doc_id",), outer: bool = False) -> DataFrame:
    """Document -> (``*keep``, pos, paragraph).

    Split on blank lines, then on ``. ``, then on ``<digits> \\n`` (the number is
    digits only and so would be dropped anyway); drop blank and all-digit
    pieces; delete newlines and hyphens.  Positions are 0-based after
    filtering.  ``outer`` keeps a document without paragraphs as one row
    with a NULL paragraph.
    """
    pieces = F.flatten(F.transform(
        F.split(F.col(text), "\n\n"),
        lambda p: F.flatten(F.transform(F.split(p, r"\. "), lambda q: F.split(q, r"\d+ \n")))))
    def stripped(p):
        return F.regexp_replace(p, r"^\s+|\s+$", "")
    kept = F.filter(pieces, lambda p: (F.length(stripped(p)) > 0)
                    & ~F.regexp_like(F.regexp_replace(stripped(p), " ", ""), F.lit(r"\A\d+\z")))
    cleaned = F.transform(kept, lambda p: F.regexp_replace(p, r"[\n-]", ""))
    explode = F.posexplode_outer if outer else F.posexplode
    return docs.select(*keep, explode(cleaned).alias("pos", "paragraph"))


WORD_LIST_LIMIT = 1_000_000


def word_list(table: DataFrame, col: str = "word", limit: int = WORD_LIST_LIMIT) -> list[str]:
    """A stop-word table as a list for the cleaners (bounded read; order kept by value)."""
    rows = table.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} words")
    return sorted(r[0] for r in rows)


def lemma_table(table: DataFrame, word: str = "word", lemma_col: str = "lemma",
                limit: int = WORD_LIST_LIMIT) -> dict[str, str]:
    """A (word, lemma) table as a mapping for ``lemma`` (bounded read; one lemma per word)."""
    rows = (table.where(F.col(word).isNotNull()).groupBy(word).agg(F.min(lemma_col).alias("_l"))
            .limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"more than {limit} lemma entries")
    return {r[0]: r[1] for r in rows}
