"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel.  ``k(s, t)`` sums ``DECAY ** (span in s + span in t)`` over all common subsequences of ``ORDER`` letters
and is normalised, so an insult keeps most of its value when letters are inserted or blanks and dots stand
between them.  It is evaluated between landmarks and the units of a text: words without their non-alphanumeric
characters, runs of single characters joined to one unit, and overlapping windows of units over ``WINDOW``
characters.  Values under ``FLOOR`` count as 0.  A bit-parallel longest-common-subsequence test first rules out
all pairs whose kernel is exactly 0.

Model.  A sentence is the vector of its largest kernel value per landmark, mapped by ``K_LL ** -0.5`` (Nystroem);
a linear SVM (squared hinge) is trained on labelled sentences: a toxic document lends its most suspicious one, a
clean document its most suspicious ones.  A document's score is a logistic
calibration of its worst sentence, its number of suspicious words and its length.

Fitting uses a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN`` documents of at most
``MAX_BYTES``, smallest id hash first), so it costs the same at every size.  Scoring is one pass over every whole
text without a shuffle; each worker evaluates the kernel once per distinct word (bounded cache).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspulse.llm import rolling as R
from corpuspulse.llm.common import prepare, with_rec

ORDER = 4
DECAY = 0.7
WINDOW = 11
FLOOR = 0.4
LANDMARKS = 48
MAX_TOXIC = 1_500
MAX_CLEAN = 3_000
MAX_BYTES = 20_000
CACHE_WORDS = 400_000
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SINGLES = re.compile(r"(?<!\w)\w(?:[\W_]{1,3}\w(?!\w)){3,}")


def units(word: str) -> list[str]:
    """The strings of a lower-case word that are compared with landmarks (``^`` marks the word's start)."""
    w = "^" + (word if word.isalnum() else "".join(filter(str.isalnum, word)))
    if len(w) <= ORDER:
        return []
    if len(w) <= WINDOW:
        return [w]
    step = WINDOW // 2
    starts = [*range(0, len(w) - WINDOW, step), len(w) - WINDOW]
    return [w[i:i + WINDOW] for i in starts]


def sentence_words(text: str) -> list[list[str]]:
    """Lower-case words of each sentence; spelled-out runs of single characters are added as one word."""
    out = []
    for s in SENTENCE.split(text.lower()):
        words = s.split()
        if words:
            out.append(words + ["".join(filter(str.isalnum, m)) for m in SINGLES.findall(s)])
    return out


def _table(strings: list[str], width: int) -> np.ndarray:
    """Code points, padded with 0."""
    raw = "".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le")
    return np.frombuffer(raw, "<u4").reshape(len(strings), width)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of row pairs of two padded code tables (Lodhi et al.'s recursion)."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    l1, l2 = np.float32(decay), np.float32(decay * decay)
    same = [[(s[:, i] == t[:, j]) & (s[:, i] != 0) for j in range(b)] for i in range(a)]
    prev = np.ones((a + 1, b + 1, n), np.float32)  # K'_0 of all prefixes
    for level in range(1, order):
        cur = np.zeros((a + 1, b + 1, n), np.float32)
        for i in range(level, a + 1):
            run = np.zeros(n, np.float32)
            for j in range(level, b + 1):
                run = l1 * run + np.where(same[i - 1][j - 1], l2 * prev[i - 1, j - 1], 0)
                cur[i, j] = l1 * cur[i - 1, j] + run
        prev = cur
    total = np.zeros(n, np.float32)
    for i in range(order, a + 1):
        for j in range(order, b + 1):
            total += np.where(same[i - 1][j - 1], l2 * prev[i - 1, j - 1], 0)
    return total


def common_length(s: np.ndarray, marks: list[str]) -> np.ndarray:
    """Longest common subsequence of every row with every landmark (bit-parallel; landmarks up to 16 letters)."""
    letters = sorted({c for m in marks for c in m})
    lookup = np.zeros((len(letters) + 1, len(marks)), np.uint16)
    for j, m in enumerate(marks):
        for i, c in enumerate(m):
            lookup[letters.index(c) + 1, j] |= np.uint16(1 << i)
    points = np.array([ord(c) for c in letters], np.uint32)
    at = np.minimum(np.searchsorted(points, s), len(points) - 1)
    code = np.where(points[at] == s, at + 1, 0)
    v = np.full((len(s), len(marks)), 0xFFFF, np.uint16)
    for i in range(s.shape[1]):
        m = lookup[code[:, i]]
        u = v & m
        v = (v + u) | (v & ~m)
    width = np.array([(1 << len(m)) - 1 for m in marks], np.uint16)
    return np.bitwise_count(~v & width[None, :])


@dataclass
class Model:
    marks: list[str]
    weights: np.ndarray  # on kernel values (Nystroem map folded in)
    bias: float
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(3))  # calibration on a text's evidence
    offset: float = -2.0
    known: dict = field(default_factory=dict)  # word -> ((landmark, value), ...)
    seen: set = field(default_factory=set)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "seen": set()}

    def learn(self, words: set[str]) -> None:
        """Kernel values of words not met before."""
        fresh = words - self.seen
        if len(self.seen) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            self.seen.clear()
            fresh = words
        fresh = sorted(fresh)
        for a in range(0, len(fresh), 50_000):
            self._learn(fresh[a:a + 50_000])
        self.seen.update(fresh)

    def _learn(self, words: list[str]) -> None:
        if not self.marks:
            return
        owners: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            for u in units(w):
                owners.setdefault(u, []).append(k)
        if not owners:
            return
        owner = list(owners.values())
        s = _table(list(owners), WINDOW)
        long = common_length(s, self.marks) >= ORDER
        row, mark = np.nonzero(long)
        if not len(row):
            return
        t = _table(self.marks, max(map(len, self.marks)))
        own = subsequence_kernel(t, t)
        value = np.zeros(len(row), np.float32)
        need, back = np.unique(row, return_inverse=True)
        self_s = np.concatenate([subsequence_kernel(s[need[i:i + 4096]], s[need[i:i + 4096]]) for i in range(0, len(need), 4096)])
        for i in range(0, len(row), 4096):
            r, m = row[i:i + 4096], mark[i:i + 4096]
            value[i:i + 4096] = subsequence_kernel(s[r], t[m]) / np.sqrt(self_s[back[i:i + 4096]] * own[m])
        hit = np.flatnonzero(value >= FLOOR)
        best: dict[int, dict[int, float]] = {}
        for u, m, x in zip(row[hit].tolist(), mark[hit].tolist(), value[hit].tolist()):
            for w in owner[u]:
                at = best.setdefault(w, {})
                at[m] = max(at.get(m, 0.0), x)
        for w, at in best.items():
            self.known[words[w]] = tuple(sorted(at.items()))

    def vector(self, words: list[str]) -> dict[int, float]:
        out: dict[int, float] = {}
        for w in words:
            for m, x in self.known.get(w, ()):
                if x > out.get(m, 0.0):
                    out[m] = x
        return out

    def decision(self, vec: dict[int, float]) -> float:
        return self.bias + sum(self.weights[m] * x for m, x in sorted(vec.items()))

    def suspicious(self, word: str) -> bool:
        return word in self.known and self.decision(dict(self.known[word])) > 0

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: decision of the worst sentence, and (log) counts of suspicious words and of words."""
        out, a = np.zeros((len(texts), 3)), 0
        while a < len(texts):  # a bounded amount of text at a time
            b, held = a, 0
            while b < len(texts) and (b == a or held + len(texts[b]) <= 1_000_000):
                held += len(texts[b])
                b += 1
            out[a:b] = self._evidence(texts[a:b])
            a = b
        return out

    def _evidence(self, texts: list[str]) -> np.ndarray:
        low = [t.lower() for t in texts]
        words = [t.split() for t in low]
        sets = [set(w) for w in words]
        spelled = [SINGLES.findall(t) for t in low]
        # All words of the batch are learnt in one call: the cache is never cleared between its texts.
        parts = [sentence_words(t) if x else None for t, x in zip(low, spelled)]
        self.learn(set().union(*sets, *({"".join(filter(str.isalnum, m)) for m in x} for x in spelled),
                               *({u for s in sents for u in s} for sents in parts if sents)))
        out, known = np.zeros((len(texts), 3)), self.known.keys()
        for k, (t, w, x) in enumerate(zip(low, words, spelled)):
            f, n = self.bias, 0
            if x or not known.isdisjoint(sets[k]):
                for s in parts[k] if x else sentence_words(t):
                    vec = self.vector(s)
                    if vec:
                        f = max(f, self.decision(vec))
                        n += sum(self.suspicious(u) for u in s)
            out[k] = f, np.log1p(n), np.log1p(len(w))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        """Calibrated probability of each text."""
        z = self.evidence(texts) @ self.slopes + self.offset
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def _part_hashes(words) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Hash, start and end of every candidate part (4 to 8 letters, and words up to 12) in the joined ``^word`` strings."""
    marked = ["^" + "".join(filter(str.isalnum, w)) for w in words]
    text = "\0".join(w for w in marked if len(w) > ORDER) + "\0"
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    gap = np.concatenate([[0], np.cumsum(code == 0)])
    pre = R.prefix(R.mix(code.astype(np.uint64) + np.uint64(1)), R.BASE)
    start, end = [], []
    for n in (4, 5, 6, 7, 8):
        s = np.arange(max(0, len(code) - n + 1))
        s = s[gap[s + n] == gap[s]]
        start.append(s)
        end.append(s + n)
    stop = np.flatnonzero(code == 0)
    first = np.concatenate([[0], stop[:-1] + 1])
    whole = (stop - first > 8) & (stop - first <= 12)
    start, end = np.concatenate([*start, first[whole]]), np.concatenate([*end, stop[whole]])
    return R.mix(R.spans(pre, start, end, R.BASE) + (end - start).astype(np.uint64)), start, end, text


def choose_landmarks(toxic: list, clean: list, most: int = LANDMARKS) -> list[str]:
    """Greedy cover: strings (words and 4- to 8-letter parts) that mark many toxic and hardly any clean documents."""
    least = max(3, len(toxic) // 300)
    seen = [np.unique(_part_hashes(w)[0]) for w in toxic]
    if not seen:
        return []
    hashes, count = np.unique(np.concatenate(seen), return_counts=True)
    hashes, count = hashes[count >= least], count[count >= least]
    if not len(hashes):
        return []

    def places(h):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return at[hashes[at] == h]

    against = np.zeros(len(hashes))
    for w in clean:
        against[np.unique(places(_part_hashes(w)[0]))] += 1
    gain = count - 4 * len(toxic) / max(1, len(clean)) * against
    good = np.flatnonzero(gain >= 0.7 * count)
    good = good[np.lexsort((hashes[good], -gain[good]))][:5_000]
    hashes = np.sort(hashes[good])
    found = [places(h) for h in seen]
    doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = np.concatenate(found) if found else np.zeros(0, int)
    order = np.argsort(flat, kind="stable")
    edge = np.searchsorted(flat[order], np.arange(len(hashes) + 1))
    names: dict[int, str] = {}
    for w in toxic:
        h, start, end, text = _part_hashes(w)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for i in np.flatnonzero(hashes[at] == h).tolist():
            if int(at[i]) not in names:
                names[int(at[i])] = text[start[i]:end[i]]
        if len(names) == len(hashes):
            break
    index = {names[k]: doc[order[edge[k]:edge[k + 1]]] for k in range(len(hashes)) if k in names}
    marks: list[str] = []
    covered = np.zeros(len(toxic), np.int32)
    pool = sorted(index)
    while pool and len(marks) < most:
        gains = [(float((0.6 ** covered[index[p]]).sum()), len(p), p) for p in pool]
        top = max(gains)[0]
        if top < least:
            break
        best = max((n, gain, p) for gain, n, p in gains if gain >= 0.9 * top)[2]  # the longest of about the same use
        marks.append(best)
        covered[index[best]] += 1
        pool = [p for p in pool if p not in best and best not in p]
    return marks


def train_svm(x: np.ndarray, y: np.ndarray, reg: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps over the current margin violators (classes balanced)."""
    z = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    w, ridge = np.zeros(z.shape[1]), reg * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        sv = y * (z @ w) < 1
        zs = z[sv] * cost[sv][:, None]
        new = np.linalg.solve(ridge + zs.T @ z[sv], zs.T @ y[sv])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(samples: list[tuple[str, int]]) -> Model:
    """Fit landmarks, SVM and calibration on ``(text, label)`` pairs."""
    pool: dict[str, str] = {}  # one object per distinct word
    words = [tuple({pool.setdefault(w, w) for s in sentence_words(t) for w in s}) for t, _ in samples]
    marks = choose_landmarks([w for w, (_, y) in zip(words, samples) if y], [w for w, (_, y) in zip(words, samples) if not y])
    model = Model(marks, np.zeros(len(marks)), -1.0)
    if not marks:
        return model
    t = _table(marks, max(map(len, marks)))
    m = len(marks)
    i, j = np.repeat(np.arange(m), m), np.tile(np.arange(m), m)
    gram = subsequence_kernel(t[i], t[j]).reshape(m, m).astype(float)
    gram /= np.sqrt(np.outer(np.diag(gram), np.diag(gram)))
    val, vec = np.linalg.eigh(gram)
    nystroem = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-3))) @ vec.T
    del words
    model.learn(set(pool))
    bags = []
    for text, y in samples:
        got = {tuple(sorted(model.vector(s).items())) for s in sentence_words(text)}
        x = np.zeros((len(got) or 1, m))
        for r, g in enumerate(sorted(got)):
            for k, v in g:
                x[r, k] = v
        bags.append((x, y))
    model.weights = np.ones(m)
    for _ in range(3):  # which sentence speaks for its document depends on the model: alternate
        rows, ys = [], []
        for x, y in bags:
            order = np.argsort(-(x @ model.weights), kind="stable")[:1 if y else 3]
            rows.append(x[order])
            ys += [1.0 if y else -1.0] * len(order)
        x, y = np.vstack(rows), np.array(ys)
        w, model.bias = train_svm(x @ nystroem, y)
        model.weights = nystroem @ w
    model.slopes, model.offset = calibrate(model.evidence([t for t, _ in samples]), np.array([float(y) for _, y in samples]))
    return model


def calibrate(x: np.ndarray, y: np.ndarray, reg: float = 0.01) -> tuple[np.ndarray, float]:
    """Logistic regression of labels on evidence (Newton steps, smoothed targets)."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + reg * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - target) + reg * w)
        w -= step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    folds: int = 5, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> list:
    """At most ``max_toxic + max_clean`` labelled texts whose id is not in the held-out fold."""
    y = (labels.select(F.col(id_col).cast("long").alias("tid"), F.col(label_col).cast("int").alias("y")).dropna()
         .groupBy("tid").agg(F.max("y").alias("y")).where(F.crc32(F.col("tid").cast("string")) % folds != 0))
    take = lambda v, n: y.where(F.col("y") == v).orderBy(F.xxhash64("tid"), "tid").limit(n)
    ids = take(1, max_toxic).unionByName(take(0, max_clean))  # a bounded number of rows
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = (d.where(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), d["id"] == ids["tid"])
            .dropDuplicates(["id"]).select("id", "text", "y").collect())
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["id"])]


def _score(model: Model):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = model.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(out, pa.float64()), batch.column("rec")],
                                             names=["id", "text", "score", "rec"])
    return run


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, score, predicted, rec)`` for every row; only the text decides.

    A NULL or empty text has no sentence and gets the score of one without any suspicious word, as does every
    text when the sample held no toxic document.  Rows with NULL or repeated ids are rows of their own; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    more = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       (F.struct(*[F.col(f"`{c}`") for c in more]) if more
                        else F.struct(F.lit(None).cast("int").alias("none"))).alias("rec"))
    scored = rows.mapInArrow(_score(model), with_rec("id long, text string, score double", rows))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
