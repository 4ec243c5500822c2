"""Licence scans: exact phrases, and an exact containment join of text blocks with licence templates.

A block is a line of a document; a template is a short set of words.  A block matches a template when at least
``threshold`` of the template's distinct words occur in it.  The join follows the classic filters:

* template words are ordered by their document frequency over all documents, rarest first (one counting job whose
  map side keeps only template words, so its shuffle is bounded by the templates);
* prefix: a template of n words that must share c of them can only match a block that holds one of its first
  n - c + 1 words;
* length: a block needs at least c distinct words;
* position: a first match at place i of the ordered template leaves at most n - i words to share;
* verification: the overlap itself.

Templates are a small parameter, so the prefix index travels with the task and documents are read once, without
a shuffle; no block is compared with a template that shares no prefix word.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm.common import prepare, with_rec

# Phrases that name a licence (fixed by the query's contract), and templates of usual notices.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the Apache License version 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4.0 international license"),
    ("cc-by", "creative commons attribution 4.0 international license"),
    ("gpl-3", "this work is licensed under the GNU General Public License version 3"),
    ("gpl-3", "free software redistribute modify under the terms of the GNU General Public License version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("all-rights-reserved", "copyright all rights reserved"),
]
THRESHOLD = 0.8
# Byte table: A-Z to lower case, every other ASCII non-alphanumeric to a blank (non-ASCII bytes are word bytes).
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_set(text: str) -> list[bytes]:
    return sorted(set(text.encode().translate(FOLD).split()))


def word_counts(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of the given words occurs, over all documents (native, bounded result)."""
    folded = F.regexp_replace(F.translate(F.col(f"`{text_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                          "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    # Only the given words leave the array, before anything is exploded.
    held = F.array_intersect(F.split(folded, " "), F.array(*[F.lit(w) for w in words]))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # at most len(words) rows
    return {w: 0 for w in words} | {r["w"]: r["count"] for r in rows}


class Index:
    """Prefix index over the templates in global frequency order."""

    def __init__(self, templates, counts: dict[str, int], threshold: float):
        rank = {w.encode(): k for k, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}
        self.items, self.prefix = [], {}
        for label, text in templates:
            ordered = sorted(word_set(text), key=rank.__getitem__)
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            for i, w in enumerate(ordered[:len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.items), i))
            self.items.append((label, frozenset(ordered), need))

    def match(self, words: set[bytes]):
        """``(template number, containment)`` of every template the word set contains well enough."""
        seen = set()
        for w in words & self.prefix.keys():
            for t, i in self.prefix[w]:
                label, held, need = self.items[t]
                if t in seen or len(words) < need or len(held) - i < need:
                    continue
                seen.add(t)
                both = len(held & words)
                if both >= need:
                    yield t, both / len(held)


def _scan(index: Index, phrases):
    phrases = [(f" {p} ".encode(), label) for p, label in phrases]
    keys = set(index.prefix)
    rare = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(map(re.escape, sorted(keys))) + rb")(?![0-9a-z\x80-\xff])")

    def scan(text: str):
        raw = text.encode()
        lower = raw.translate(FOLD)
        starts, base, labels, score, blocks = [], set(), set(), 0.0, []
        if any(all(w in lower for w in p.split()) for p, _ in phrases):
            flat = b" " + b" ".join(lower.split()) + b" "
            for p, label in phrases:
                at = flat.find(p)
                while at >= 0:
                    starts.append(flat.count(b" ", 0, at))
                    base.add(label)
                    at = flat.find(p, at + 1)
        hit = rare.search(lower)
        if hit:
            at = 0
            for number, line in enumerate(raw.split(b"\n")):
                low = lower[at:at + len(line)]
                at += len(line) + 1
                if rare.search(low):
                    for t, share in index.match(set(low.split())):
                        labels.add(index.items[t][0])
                        score = max(score, share)
                        blocks.append((number, index.items[t][0], t, share))
        if base:
            score = 1.0
        return len(lower.split()), starts, base, labels | base, score, blocks

    def run(batches):
        import pyarrow as pa
        block = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("template", pa.int32()), ("containment", pa.float64())]))
        for batch in batches:
            got = [scan(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([len(g[1]) for g in got], pa.int64()),
                 pa.array([min(g[1], default=None) for g in got], pa.int64()), pa.array([max(g[1], default=None) for g in got], pa.int64()),
                 pa.array([",".join(sorted(g[2])) for g in got]), pa.array([",".join(sorted(g[3])) for g in got]),
                 pa.array([g[4] for g in got], pa.float64()),
                 pa.array([[dict(zip(("line", "label", "template", "containment"), b)) for b in g[5]] for g in got], block),
                 batch.column("rec")],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks", "rec"])
    return run


def scan_licences(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks, rec)`` per row.

    ``blocks`` lists every (line, template) with containment of at least ``threshold``; ``labels`` adds their
    labels to those of the phrases; ``score`` is the best containment (1 where a phrase stands).  A NULL or
    empty text has no words and no labels (empty strings, NULL positions, score 0); rows with NULL or repeated
    ids are rows of their own; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    vocabulary = sorted({w.decode() for _, t in templates for w in word_set(t)})
    index = Index(templates, word_counts(docs, vocabulary, text_col), threshold)
    more = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       (F.struct(*[F.col(f"`{c}`") for c in more]) if more
                        else F.struct(F.lit(None).cast("int").alias("none"))).alias("rec"))
    return rows.mapInArrow(_scan(index, phrases), with_rec(
        "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<line:int,label:string,template:int,containment:double>>", rows))
