"""Substring dedup (words and bytes) and near-dedup against brute force, with all awkward cases."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from .cases import WORD, frame, texts
from pyspark.sql import functions as F

from corpuspulse.llm import near_dedup, substring_dedup, suffix_dedup
from corpuspulse.llm.components import connected_components

BIG = 2**63 - 1


def rows_of(df, *cols):
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))


def expect_windows(rows, size):
    first = {}
    split = [(BIG if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for k, w in split:
        for j in range(len(w) - size + 1):
            g = tuple(w[j:j + size])
            first[g] = min(first.get(g, BIG), k)
    out = []
    for (i, _), (k, w) in zip(rows, split):
        gone = {j + d for j in range(len(w) - size + 1) if first[tuple(w[j:j + size])] < k for d in range(size)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(map(str, out))


@pytest.mark.parametrize("flush", [10**6, 500])
def test_word_windows(spark, monkeypatch, flush):
    monkeypatch.setattr(substring_dedup, "FLUSH_WORDS", flush)
    rows = texts()
    got = substring_dedup.dedup_windows(frame(spark, rows).repartition(3))
    assert rows_of(got, "id", "n_words", "n_removed", "kept_text") == expect_windows(rows, 13)
    assert got.first().rec.id == 7 and got.first().rec.bucket == 9


def test_word_windows_around_a_frequent_phrase(spark, monkeypatch):
    """One minimizer in every document: its bucket is divided, the result stays."""
    monkeypatch.setattr(substring_dedup, "FLUSH_WORDS", 500)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 200)
    rows = [(i, " ".join(f"w{i}x{j} home about contact" for j in range(20))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 60, 7)]
    docs = frame(spark, rows).repartition(3)
    bounded = (substring_dedup.packed_windows(docs, 13, "doc_id", "text").groupBy("bucket")
               .agg((F.sum(F.length("hashes")) / substring_dedup.HASH_BYTES).alias("n")))
    assert bounded.agg(F.max("n")).first()[0] <= 2 * 200
    got = substring_dedup.dedup_windows(docs)
    assert rows_of(got, "id", "n_words", "n_removed", "kept_text") == expect_windows(rows, 13)


def test_word_windows_empty_table(spark):
    assert substring_dedup.dedup_windows(frame(spark, [])).count() == 0


def expect_bytes(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[j:j + size] for _, b in raw for j in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - size + 1):
            if count[b[j:j + size]] > 1:
                gone[j:j + size] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [2000, 1])
def test_byte_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1: every repeated minimizer is divided further
    rows = texts(2)
    got = suffix_dedup.dedup_bytes(frame(spark, rows).repartition(3)).select(
        "id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("h"))
    assert rows_of(got, "id", "n_bytes", "n_removed", "n", "h") == expect_bytes(rows, 200)


def test_byte_strings_empty_table(spark):
    assert suffix_dedup.dedup_bytes(frame(spark, [])).count() == 0


def test_transform_is_the_sorted_suffix_order():
    rng = random.Random(4)
    for _ in range(40):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 8))]
        bwt, lcp, _ = suffix_dedup.transform(strings, 9)
        order = sorted(((s[j:], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)), key=lambda x: (x[0] + b"\0", x[1]))
        used = sorted(set(b"".join(strings)))
        assert bwt.tolist() == [0 if j == 0 else used.index(strings[i][j - 1]) + 1 for _, i, j in order]
        for x, (a, b) in enumerate(zip(order, order[1:]), 1):
            same = next((k for k, (p, q) in enumerate(zip(a[0], b[0])) if p != q), min(len(a[0]), len(b[0])))
            assert min(same, 9) == lcp[x]


def test_repeated_starts_by_brute_force():
    rng = random.Random(5)
    for trial in range(100):
        size, letters = rng.choice([3, 4, 8]), b"ab" if trial % 2 else b"abcd"
        strings = list({bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(8)})
        count = Counter(s[i:i + size] for s in strings for i in range(len(s) - size + 1))
        assert [x.tolist() for x in suffix_dedup.repeated_starts(strings, size)] == [
            [i for i in range(len(s) - size + 1) if count[s[i:i + size]] > 1] for s in strings]


def expect_components(rows, size, percent):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(table))
        s = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append((i, s))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(map(str, ((i, len(s) if i is not None else None, None if i is None else root(i), i is None or root(i) == i) for i, s in sets)))


@pytest.mark.parametrize("region", [64, 2])
def test_near_components(spark, monkeypatch, region):
    monkeypatch.setattr(near_dedup, "REGION", region)
    rows = texts(3) + [(90, "A b c"), (91, "a B c"), (92, "a b")]
    got = near_dedup.near_components(frame(spark, rows).repartition(2))
    assert rows_of(got, "id", "n_shingles", "component_id", "kept") == expect_components(rows, 4, 80)


def test_near_components_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_components(frame(spark, rows))
    assert rows_of(got, "id", "n_shingles", "component_id", "kept") == expect_components(rows, 4, 80)


def test_near_components_with_shared_boilerplate(spark):
    """Every two documents are almost linked (0.797) by their shared text; a few pairs just are (0.815)."""
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(300):
        pair = i % 150
        shared = [f"p{pair}x{j}" for j in range(5)] if pair % 3 == 0 else []
        rows.append((i, " ".join(base + shared + [f"u{i}x{j}" for j in range(51 - len(shared))])))
    got = near_dedup.near_components(frame(spark, rows), size=1)
    assert rows_of(got, "id", "n_shingles", "component_id", "kept") == expect_components(rows, 1, 80)


@pytest.mark.parametrize("posting", [2000, 3])
def test_large_regions_are_joined_exactly(spark, monkeypatch, posting):
    """Nothing but the join of large regions finds links when their order is not looked at."""
    monkeypatch.setattr(near_dedup, "POSTING", posting)
    monkeypatch.setattr(near_dedup, "REGION", 1)
    monkeypatch.setattr(near_dedup, "REACH", 1)
    rows = texts(3)
    got = near_dedup.near_components(frame(spark, rows))
    assert rows_of(got, "id", "n_shingles", "component_id", "kept") == expect_components(rows, 4, 80)


def test_near_components_empty_table(spark):
    assert near_dedup.near_components(frame(spark, [])).count() == 0


def _signed(rows, size=5):
    ids = pa.array(range(len(rows)), pa.int64())
    return near_dedup._sign(size)(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(rows, pa.string())], names=["key", "th", "text"])]))


def test_signing_a_batch_needs_little_memory(monkeypatch):
    """A worker cuts a batch into pieces; what it needs at once does not grow with the batch, and rows do not depend on pieces."""
    rng = random.Random(7)
    rows = [None, "", "one"] + [" ".join(rng.choices("abcdefghij", k=3_000)) for _ in range(400)]  # 2.4 MB
    want = pa.Table.from_batches(_signed(rows)).to_pylist()
    tracemalloc.start()
    for _ in _signed(rows):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15_000_000
    monkeypatch.setattr(near_dedup, "PIECE_BYTES", 1)
    assert pa.Table.from_batches(_signed(rows)).to_pylist() == want


def test_connected_components_of_long_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 150), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 150, 150: 150}
