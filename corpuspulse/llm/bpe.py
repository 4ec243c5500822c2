"""Byte-level BPE encoding and decoding by speculation: greedy longest match proposes, pair checks verify.

A token sequence is the BPE result of a word exactly when each token is the BPE result of its own bytes and no
merge could ever cross any boundary between neighbours.  So a word is first cut greedily into longest matches,
then all adjacent pairs of all new words of a batch are tested at once (numpy, undoing merges backwards in rank
order on both sides of the boundary).  Only words with a failing pair run the exact merges.

Each Python worker keeps one bounded cache of word results; a task streams its Arrow batches, so memory does not
depend on the input.  No shuffle is needed in either direction.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm.common import prepare, with_rec

# The published pre-tokenisation pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 500_000
CHECKED_PAIRS = 250_000   # pair checks that a worker keeps; vectorised, hence cheap to repeat
NONE = np.int64(2**40)
NO_RANK = 2**40


def byte_symbols() -> dict[str, int]:
    """Printable stand-in character of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and pair checks of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_symbols()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_bytes = lambda s: bytes(byte[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items() if s not in added}
        size = max([*self.ids.values(), *added.values()]) + 1
        self.token = [b""] * size
        for b, i in self.ids.items():
            self.token[i] = b
        self.special = added
        for s, i in added.items():
            self.token[i] = s.encode()
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pattern = regex.compile(PATTERN)
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for r, m in enumerate(model["merges"]):
            a, b = (to_bytes(s) for s in (m.split(" ") if isinstance(m, str) else m))
            made = self.ids[a + b]
            self.pair[self.ids[a], self.ids[b]] = (r, made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, self.ids[a], self.ids[b]
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.pair_rank = {p: r for p, (r, _) in self.pair.items()}.get
        self.made = [self.ids[b"".join(self.token[i] for i in p)] for p in self.pair]
        keys = np.array([a * size + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.pair.values()], np.int64)[order]
        self.size = size
        # Longest match may only use tokens that are the BPE result of their own bytes.
        self.own = {b: i for b, i in self.ids.items() if self.merge(b) == [i]}
        self.longest: dict[bytes, int] = {}  # by the next four bytes (fewer at a word's end)
        for b in self.own:
            for k in range(1, 5):
                self.longest[b[:k]] = max(self.longest.get(b[:k], 0), len(b))
        self.cache: dict[str, bytes] = {}
        self.checked: dict[int, bool] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: repeatedly merge the lowest-ranked pair, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n > 40:
            return self._merge_long(ids)
        rank = self.pair_rank
        while n > 1:
            found = [rank(p, NO_RANK) for p in zip(ids, ids[1:])]
            r = min(found)
            if r == NO_RANK:
                break
            i = found.index(r)
            ids[i:i + 2] = (self.made[r],)
            n -= 1
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words: a heap over a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.pair[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pair[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                p = (ids[i], ids[after[i]])
                if p in self.pair:
                    heapq.heappush(heap, (self.pair[p][0], i, *p))
            if before[i] >= 0:
                p = (ids[before[i]], ids[i])
                if p in self.pair:
                    heapq.heappush(heap, (self.pair[p][0], before[i], *p))
        return [t for t in ids if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match over self-consistent tokens."""
        out, i, n, own, longest = [], 0, len(word), self.own.get, self.longest.get
        whole = own(word)
        if whole is not None:
            return [whole]
        while i < n:
            size = longest(word[i:i + 4]) or longest(word[i:i + 3]) or longest(word[i:i + 2]) or 1
            while (t := own(word[i:i + size])) is None:
                size -= 1
            out.append(t)
            i += size
        return out

    def crosses(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does some merge cross its boundary in the BPE of the two tokens' joined bytes?

        Undo the younger of the two tokens at the boundary step by step.  A merge of the pair at hand with rank
        r wins if r is below the rank that consumes the left token, and not above the one that consumes the
        right token (equal ranks merge leftmost first).
        """
        a, b = a.copy(), b.copy()
        end_a, end_b = np.full(len(a), NONE), np.full(len(a), NONE)
        bad, open_ = np.zeros(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            r = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)
            hit = (r < end_a[open_]) & (r <= end_b[open_]) & (r < NONE)
            bad[open_[hit]] = True
            ra, rb = self.rank[x], self.rank[y]
            go = ~hit & ((ra >= 0) | (rb >= 0))
            undo_a = go & (ra > rb)
            undo_b = go & ~undo_a
            end_a[open_[undo_a]], a[open_[undo_a]] = ra[undo_a], self.right[x[undo_a]]
            end_b[open_[undo_b]], b[open_[undo_b]] = rb[undo_b], self.left[y[undo_b]]
            open_ = open_[go]
        return bad

    def learn(self, fresh: list[str]) -> None:
        """Encode new words into the cache: propose, verify all adjacent pairs together, merge the failing ones."""
        raw = [w.encode() for w in fresh]
        got = [self.propose(w) for w in raw]
        count = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((t for g in got for t in g), np.int64, int(count.sum()))
        word = np.repeat(np.arange(len(got)), count)
        inner = np.flatnonzero(word[:-1] == word[1:])
        if len(inner):
            key, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            known = np.array([self.checked.get(k, -1) for k in key.tolist()], np.int64)
            new = np.flatnonzero(known < 0)
            if len(new):
                known[new] = self.crosses(key[new] // self.size, key[new] % self.size)
                if len(self.checked) > CHECKED_PAIRS:
                    self.checked.clear()
                self.checked.update(zip(key[new].tolist(), known[new].tolist()))
            for i in np.unique(word[inner][known[back] == 1]).tolist():
                got[i] = self.merge(raw[i])
        for w, g in zip(fresh, got):
            self.cache[w] = np.array(g, "<i4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out, block, held = [], [], 0
        for t in texts:
            block.append(t)
            held += len(t)
            if held > 1_000_000:
                out += self._encode(block)
                block, held = [], 0
        return out + (self._encode(block) if block else [])

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            parts = self.split_special.split(t) if self.split_special and any(s in t for s in self.special) else (t,)
            cut.append([self.pattern.findall(p) if k % 2 == 0 else p for k, p in enumerate(parts)])
        fresh = {w for parts in cut for p in parts if not isinstance(p, str) for w in p} - self.cache.keys()
        if fresh:
            room = CACHE_WORDS // 2
            if len(fresh) > room and len(texts) > 1:  # keep the cache bounded: fewer texts at a time
                half = len(texts) // 2
                return self._encode(texts[:half]) + self._encode(texts[half:])
            self._fill(fresh, cut)
        get = self.cache.__getitem__
        return [b"".join([np.array([self.special[p]], "<i4").tobytes() if isinstance(p, str) else b"".join(map(get, p))
                          for p in parts]) for parts in cut]

    def _fill(self, fresh: set[str], cut) -> None:
        """Learn ``fresh``; where the cache would grow too large, start it anew with the words of these texts."""
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
            fresh = {w for parts in cut for p in parts if not isinstance(p, str) for w in p}
        self.learn(sorted(fresh))



_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a path, once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def token_bytes(path: str) -> list[bytes]:
    """Bytes of every id (all that decoding needs)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = byte_symbols()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    by_id = {i: bytes(byte[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in added}
    by_id |= {i: s.encode() for s, i in added.items()}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def _encode(path: str):
    def run(batches):
        import pyarrow as pa
        v = vocabulary(path)
        for batch in batches:
            ids = v.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, flat), batch.column("rec")],
                                             names=["id", "ids", "rec"])
    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa
        get = token_bytes(path).__getitem__
        for batch in batches:
            ids = batch.column("ids")
            flat, off = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            text = [b"".join(map(get, flat[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])
    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, rec)`` for every row; ``rec`` holds the further columns of ``docs``.

    Ids equal those of the tokenizers library for the vocabulary file at ``path`` (no special tokens added;
    the strings of special tokens inside a text become their ids).  A NULL or empty text has no ids; repeated
    rows and NULL ids stay as rows of their own; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    more = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       (F.struct(*[F.col(f"`{c}`") for c in more]) if more
                        else F.struct(F.lit(None).cast("int").alias("none"))).alias("rec"))
    return rows.mapInArrow(_encode(path), with_rec("id long, ids array<int>", rows))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the text of each row's ``ids`` (special tokens kept)."""
    prepare(encoded.sparkSession)
    from pyspark.sql import types as T
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(_decode(path), schema)
