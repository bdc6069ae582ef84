"""Quality by ordinal cumulative-link regression on graded ratings.

A text's words are hashed to features whose weights all grades share; ordered thresholds cut the weighted sum into
grades, P(grade > k) = logistic(w.x - t_k). The gaps of thresholds are exponentials, so their order holds throughout the
fit. The expected grade ranks texts, and the tail probability of a grade selects them.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import map_text, train_rows
from ionlake.llm.sampling import labelled

#: Labelled texts of each grade that the fit may use.
SAMPLE = 3000
BUCKETS = 1 << 14
STEPS, RATE, RIDGE = 150, 0.05, 1e-4
#: Words remembered with their bucket by a worker, emptied when full; longer ones are worked out each time.
MEMO, MEMO_CHARS = 300_000, 64
#: Texts are selected when a grade of SELECT_GRADE or more is at least so likely.
SELECT_GRADE, SELECT_TAIL = 1, 0.5
_bucket: dict[str, int] = {}


def _shape(word: str) -> str:
    """Capitals, letters, digits and signs of a whole word, runs as one."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _buckets_of(word: str) -> tuple[int, int]:
    return zlib.crc32(word.lower().encode()) % (BUCKETS - 64), BUCKETS - 64 + zlib.crc32(_shape(word).encode()) % 48


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: damped counts of hashed words and shapes, of unit length, and a few of the whole text."""
    words = Counter((text or "").split())
    n = sum(words.values())
    tot: dict[int, float] = {}
    memo = _bucket
    for w, k in words.items():
        b = memo.get(w)
        if b is None:
            a, s = _buckets_of(w)
            b = a << 16 | s
            if len(w) <= MEMO_CHARS:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = b
        tot[b >> 16] = tot.get(b >> 16, 0) + k
        tot[b & 0xFFFF] = tot.get(b & 0xFFFF, 0) + k
    if not tot:
        return np.array([BUCKETS - 1]), np.array([1.0])
    at, v = np.fromiter(tot.keys(), np.int64), np.fromiter(tot.values(), np.float64) / n
    word = at < BUCKETS - 64
    v[word] = np.sqrt(v[word])
    v[word] /= np.sqrt((v[word] ** 2).sum())
    top = max(words.values()) / n
    more = [len(words) / n, top, min(1.0, n / 50), np.log1p(n) / 10]
    return np.r_[at, np.arange(BUCKETS - 12, BUCKETS - 12 + len(more))], np.r_[v, more]


class Ordinal:
    """Cumulative-link model with logistic link."""

    def __init__(self, grades: list[int]):
        self.grades = grades
        self.w = np.zeros(BUCKETS)
        self.first, self.gaps = -1.0, np.zeros(max(0, len(grades) - 2))

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.r_[0.0, np.cumsum(np.exp(self.gaps))]

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(-(z[:, None] - self.thresholds[None])))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Ordinal:
        """Adam on the mean log likelihood; ``y`` are places among the grades, each of which weighs alike."""
        size = np.array([len(a) for a, _ in rows])
        at, v = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
        who = np.repeat(np.arange(len(rows)), size)
        k = len(self.grades) - 1
        weight = (1 / np.bincount(y, minlength=k + 1).clip(1))[y]
        weight /= weight.sum()
        p = np.r_[self.w, self.first, self.gaps]
        m, s = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, STEPS + 1):
            self.w, self.first, self.gaps = p[:BUCKETS], p[BUCKETS], p[BUCKETS + 1 :]
            z = np.bincount(who, self.w[at] * v, len(rows))
            t = np.c_[np.ones(len(z)), self.tails(z), np.zeros(len(z))]  # P(grade >= k)
            i = np.arange(len(z))
            like = np.maximum(t[i, y] - t[i, y + 1], 1e-9)
            slope = t * (1 - t)
            dz = -weight * (slope[i, y] - slope[i, y + 1]) / like
            dt = np.zeros(k)  # by each threshold
            np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, weight * slope[i, y] / like, 0))
            np.add.at(dt, np.minimum(y, k - 1), np.where(y < k, -weight * slope[i, y + 1] / like, 0))
            g = np.r_[np.bincount(at, dz[who] * v, BUCKETS) + RIDGE * self.w, dt.sum(), [dt[j + 1 :].sum() * np.exp(self.gaps[j]) for j in range(k - 1)]]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
        self.w, self.first, self.gaps = p[:BUCKETS], p[BUCKETS], p[BUCKETS + 1 :]
        return self

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and tails P(grade > k) of texts."""
        if len(self.grades) < 2:
            return np.full(len(texts), float(self.grades[0] if self.grades else 0)), np.zeros((len(texts), 0))
        z = np.array([(self.w[a] * v).sum() for a, v in map(features, texts)])
        t = self.tails(z)
        return self.grades[0] + (t * np.diff(self.grades)).sum(axis=1), t


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """A model of ``ratings`` (``doc_id``, integer ``grade``) from about ``sample`` texts of each grade at most."""
    found = labelled(docs, ratings.select("doc_id", F.col("grade").cast("int").alias("grade")), "grade", sample)

    def measure(texts):
        both = [features(t) for t in texts]
        return {"i": pa.array([a for a, _ in both], pa.list_(pa.int64())), "v": pa.array([b for _, b in both], pa.list_(pa.float64()))}

    rows = sorted((r.y, r.i, r.v) for r in map_text(found, measure, "i array<long>, v array<double>", "y").toLocalIterator())
    grades = sorted({r[0] for r in rows})
    model = Ordinal(grades)
    if len(grades) > 1:
        model.fit([(np.array(i), np.array(v)) for _, i, v in rows], np.array([grades.index(g) for g, _, _ in rows]))
    return model


def rate(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, grade: int = SELECT_GRADE, tail: float = SELECT_TAIL) -> DataFrame:
    """``doc_id``, ``held_out``, ``expected_grade``, ``tail_probability`` and ``kept`` of every row.

    ``tail_probability`` is that of ``grade`` or more; a row is kept where it is ``tail`` or more. The model learns only
    from rated rows whose crc32 of the id as text is not 1 modulo 3. Null and empty texts are rated as texts without
    words. With one grade, or none, every text has that grade (or 0) and its tail is 1 or 0. Repeated rows each get a
    row; other columns are not read; whole texts count; an empty table gives an empty one.
    """
    model = fit(docs, ratings, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    above = [k for k, g in enumerate(model.grades) if g >= grade]

    def run(texts):
        mean, tails = sent.value.score(texts)
        if not above or not tails.size or above[0] == 0:
            part = np.full(len(texts), 1.0 if above else 0.0)
        else:
            part = tails[:, above[0] - 1]
        return {"expected_grade": pa.array(mean, pa.float64()), "tail_probability": pa.array(part, pa.float64()), "kept": pa.array(part >= tail, pa.bool_())}

    out = map_text(docs, run, "expected_grade double, tail_probability double, kept boolean", "doc_id")
    return out.select("doc_id", F.coalesce(~train_rows(), F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", "kept")
