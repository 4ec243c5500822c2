"""Documents with the awkward cases every operator must take, and plain reference computations."""

import random
import re

SCHEMA = "doc_id long, text string, n_words string, kept boolean, id int, key int, rec string, spans string, bucket int, found int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int = 1) -> list[tuple]:
    """``(doc_id, text)``: NULL ids and texts, empties, repeats, ties, near copies, periodic and very long texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(12)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [(0, base[0]), (1, base[1]), (2, None), (3, ""), (4, "  \n\t "), (5, "one two"), (5, "other text with this id " + passage),
           (None, base[0]), (None, None), (None, "null id " + passage), (6, base[0]), (6, base[0])]
    out += [(10 + i, b) for i, b in enumerate(base)]
    out += [(40 + i, b.replace(b.split()[7], "changed", 1)) for i, b in enumerate(base)]
    out += [(60 + i, f"start {i} {passage}\nend {i} of it {rng.choice(base)}") for i in range(8)]
    out += [(80, "ab " * 400), (81, "é中 " * 300 + "x"), (82, "a" * 3000), (83, " ".join(rng.choice(words) for _ in range(20_000)))]
    return out


def frame(spark, rows):
    """The rows with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", True, 7, 8, "r", "s", 9, 10) for i, t in rows], SCHEMA)
