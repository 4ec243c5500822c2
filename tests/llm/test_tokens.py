"""BPE coding, packing and toxicity."""

import random
import zlib
from collections import defaultdict

import numpy as np
from .cases import frame, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuspulse.llm import bpe, packing, toxicity


def some_texts():
    rng = random.Random(6)
    letters = "aabb e é中'st <|end|>\n0"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [
        "a" * 500, "ab" * 300, "<|end|>", "x<|end|><|end|>ab", "  ab\t\n ab  ", "don't we'll"]


def test_encode_equals_the_library(tiny_vocabulary):
    v, t = bpe.Vocabulary(tiny_vocabulary), Tokenizer.from_file(tiny_vocabulary)
    for text, raw in zip(some_texts(), v.encode_batch(some_texts())):
        assert np.frombuffer(raw, "<i4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pair_check_equals_exact_merging(tiny_vocabulary):
    v = bpe.Vocabulary(tiny_vocabulary)
    ids = sorted(v.own.values())
    ids = [i for i in ids if i > 255 or chr(i) in "ab e"]
    a, b = (np.array(x) for x in zip(*[(x, y) for x in ids for y in ids]))
    want = [v.merge(v.token[x] + v.token[y]) != [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert v.crosses(a, b).tolist() == want


def test_small_cache_gives_the_same_ids(tiny_vocabulary, monkeypatch):
    want = bpe.Vocabulary(tiny_vocabulary).encode_batch(some_texts())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    assert bpe.Vocabulary(tiny_vocabulary).encode_batch(some_texts()) == want


def test_round_trip_of_awkward_rows(spark, tiny_vocabulary):
    rows = texts(4) + [(200 + i, t) for i, t in enumerate(some_texts()[:50])]
    out = bpe.decode(bpe.encode(frame(spark, rows), tiny_vocabulary), tiny_vocabulary).collect()
    assert sorted((str(r.id), r.decoded) for r in out) == sorted((str(i), t or "") for i, t in rows)
    t = Tokenizer.from_file(tiny_vocabulary)
    assert all(r.ids == t.encode(r.decoded, add_special_tokens=False).ids for r in out)
    assert bpe.encode(frame(spark, []), tiny_vocabulary).count() == 0


def test_packing(spark, tiny_vocabulary):
    rows = texts(5) + [(300 + i, "ab " * (i % 60)) for i in range(400)]
    out = packing.pack_documents(frame(spark, rows), tiny_vocabulary, size=64).collect()
    t = Tokenizer.from_file(tiny_vocabulary)
    docs = defaultdict(list)
    for i, x in rows:
        docs[i].append(t.encode(x or "", add_special_tokens=False).ids + [2])
    pieces = defaultdict(list)
    for r in out:
        pieces[r.id].append(r)
    for i, all_ids in docs.items():
        want = []
        for ids in all_ids:
            cut = [ids] if len(ids) <= 64 else [x for x in [ids[:len(ids) % 64], *(ids[k:k + 64] for k in range(len(ids) % 64, len(ids), 64))] if x]
            at = 0
            for p, x in enumerate(cut):
                want.append((p, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
                at += len(x)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == sorted(want)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in out) // 64)
    assert len(bins) <= least * 1.02 + 1
    assert packing.pack_documents(frame(spark, []), tiny_vocabulary).count() == 0


def test_genetic_steps_keep_every_item():
    rng = np.random.default_rng(1)
    sizes = {i: int(s) for i, s in enumerate(rng.integers(1, 100, 300))}
    a = packing.best_fit(sizes, sizes, [], 128)
    b = packing.best_fit(sizes, [i for i in sizes if i % 2], packing.best_fit(sizes, [i for i in sizes if not i % 2], [], 128), 128)
    for bins in (a, b, packing.cross(a, b, sizes, 128, rng), packing.mutate(a, sizes, 128, rng), packing.evolve(sizes, [b], 128, 5)):
        assert sorted(i for x in bins for i in x) == sorted(sizes)
        assert all(sum(sizes[i] for i in x) <= 128 for x in bins)
    assert len(packing.evolve(sizes, [b], 128, 5)) <= len(b)


def brute_kernel(s, t, n, decay):
    from itertools import combinations
    total = 0.0
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_subsequence_kernel_by_brute_force():
    rng = random.Random(8)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 8))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))) for _ in range(60)]
    s, t = (toxicity._table([p[k] for p in pairs], 9) for k in (0, 1))
    got = toxicity.subsequence_kernel(s, t, 3, 0.7)
    for x, (a, b) in zip(got, pairs):
        assert abs(x - brute_kernel(a, b, 3, 0.7)) < 1e-4
    for x, (a, b) in zip(toxicity.common_length(s, [p[1] for p in pairs]).diagonal(), pairs):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        assert x == row[-1]


def toxic_samples(n=300):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            w[rng.randrange(60)] = rng.choice(["bumbletwit", "clodpole", "muckwump"])
        out.append((i, " ".join(w) + ".", int(i % 5 == 0)))
    return out


def test_toxicity_on_held_out_and_gapped_words(spark):
    rows = toxic_samples()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    sample = toxicity.training_sample(docs, labels)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(sample) == len(rows) - len(held)
    model = toxicity.fit(sample)
    got = {r.id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if i in held]) >= 0.95
    plain = " ".join(rows[1][1].split()[:40])
    for word in ("bumbletwit", "b u m b l e t w i t", "bum.ble.twit", "bumblxetwit", "c-l-o-d-p-o-l-e", "cloddpole"):
        assert model.scores([f"{plain} {word} {plain}"])[0] >= 0.5, word
    assert model.scores([plain])[0] < 0.5


def test_full_cache_does_not_change_scores(monkeypatch):
    texts = ["a bumbletwit here. c l. o d p o l e", "c l\no d p o l e there", "so bumbletwit again"]
    model = lambda: toxicity.Model(["^bumblet", "odpole"], np.array([3.0, 3.0]), -1.0, np.ones(3))
    want = model().scores(texts)
    for most in range(1, 20):
        monkeypatch.setattr(toxicity, "CACHE_WORDS", most)
        assert model().scores(texts) == want


def test_toxicity_awkward_rows(spark):
    model = toxicity.fit([(t, y) for _, t, y in toxic_samples(100)])
    rows = texts(7)
    out = toxicity.score_toxicity(frame(spark, rows), model)
    got = out.collect()
    assert sorted((str(r.id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0
    nothing = toxicity.fit([("some clean text", 0)])
    assert nothing.scores(["bumbletwit", ""]) == [nothing.scores([""])[0]] * 2
    assert toxicity.fit([]).scores(["x"])[0] < 0.5


def test_pair_checks_of_a_worker_are_bounded(tiny_vocabulary, monkeypatch):
    want = bpe.Vocabulary(tiny_vocabulary).encode_batch(some_texts())
    monkeypatch.setattr(bpe, "CHECKED_PAIRS", 1)
    v = bpe.Vocabulary(tiny_vocabulary)
    got = []
    for t in some_texts():
        got += v.encode_batch([t])
    assert got == want
