"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from a bounded sample of labelled texts: words whose log odds of standing in toxic texts are large
and beyond chance. Each text of the sample is measured against a lexicon learned from the other folds, so that words
which stand in toxic texts by chance earn no trust; copies are one text of one fold. Every whole text then
gives densities of the lexicon, in plain and obfuscated spelling, its nearness to words of the second person, rates of
capitals, punctuation, repetition and obfuscation. Boosted trees on these are fitted in numpy; scores of folds that a
tree has not seen are made monotone probabilities by pooling adjacent violators.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Written, map_text, sliced, train_rows, trimmed
from ionlake.llm.sampling import labelled

#: Labelled texts of each class that the fit may use.
SAMPLE = 4000
#: What a word of the lexicon needs: toxic texts that hold it, log odds, and log odds in standard errors.
MIN_DOCS, MIN_ODDS, MIN_Z = 3, 1.5, 3.5
THRESHOLD = 0.7
ROUNDS, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 3, 0.2, 32, 5, 1.0
FOLDS = 4
#: Words of the second person in the languages at hand.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton tes vous votre vos usted ustedes vosotros tus"
_YOU = re.compile(r"\b(?:" + "|".join(SECOND_PERSON.split()) + r")\b")
_NEAR = 40
#: Signs that stand for letters in obfuscated spelling.
_LEET = str.maketrans("013457@$!|*", "oieastasii*")
_MIXED = re.compile(r"[^\W\d_](?:[0-9@$!|*]+|(?:[.\-_][^\W\d_])+(?=[.\-_]))[^\s]*")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_REPEAT = re.compile(r"([^\W\d_])\1\1+|([!?])\2+")
_WORD = re.compile(r"[^\W\d_]+")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGIT, _PUNCT = b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAMES = ["hits", "density", "weight", "weight_density", "distinct", "near_you", "near_share", "hidden", "hidden_density", "you", "capitals", "shouts", "exclaims", "punctuation", "digits", "repeats", "mixed", "length"]


def words_of(text: str) -> set[str]:
    """Distinct lower-case letter runs of a text."""
    return set(_WORD.findall(text.lower()))


class Features:
    """Dense features of a text against a lexicon of word weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for w, x in lexicon.items():
            self.automaton.add_word(w, (len(w), w, x))
        if lexicon:
            self.automaton.make_automaton()

    def row(self, text: str | None) -> list[float]:
        text = text or ""
        low, raw = text.lower(), text.encode()
        size = max(1, len(raw))
        n = raw.count(b" ") + raw.count(b"\n") + 1
        hits, weight, near, seen = 0, 0.0, 0, set()
        if self.lexicon and low:
            for end, (k, w, x) in self.automaton.iter(low):
                a, b = end + 1 - k, end + 1
                if (a and low[a - 1].isalpha()) or (b < len(low) and low[b].isalpha()):
                    continue
                hits += 1
                weight += x
                seen.add(w)
                near += _YOU.search(low, max(0, a - _NEAR), b + _NEAR) is not None
        hidden = mixed = 0
        if len(raw) != len(raw.translate(None, b"0134579@$!|*.-_")):
            for m in _MIXED.finditer(low):
                mixed += 1
                plain = m.group().translate(_LEET)
                hidden += _squeeze(plain) in self.lexicon or re.sub(r"[.\-_*]", "", plain) in self.lexicon
        gone = lambda signs: len(raw) - len(raw.translate(None, signs))
        upper = gone(_UPPER)
        return [
            math.log1p(hits), 100 * hits / n, weight, 100 * weight / n, len(seen), math.log1p(near), near / max(1, hits), math.log1p(hidden), 100 * hidden / n,
            100 * len(_YOU.findall(low)) / n, upper / max(1, upper + gone(_LOWER)), 100 * len(_SHOUT.findall(text)) / n if upper else 0.0, 100 * raw.count(b"!") / n, gone(_PUNCT) / size, gone(_DIGIT) / size,
            100 * sum(1 for _ in _REPEAT.finditer(text)) / n, 100 * mixed / n, math.log1p(n),
        ]

    def matrix(self, texts) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float64).reshape(-1, len(NAMES))


def _squeeze(word: str) -> str:
    """Letters of a word without signs, runs of a letter as one or two left to the lexicon's spelling."""
    return re.sub(r"[^a-zà-ÿ]", "", word)


class Trees:
    """Boosted regression trees on binned features with logistic loss."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        # Rare values above many equal ones get edges of their own.
        edges = [np.unique(np.r_[e, np.quantile(c[c > e[0]], np.linspace(0, 1, 9))[:-1] - 1e-9 if (c > e[0]).any() else e]) for e, c in zip(edges, x.T)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(binned, edges, q - y, np.maximum(q * (1 - q), 1e-6))
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, binned, edges, g, h) -> list:
        """Nodes as (feature, threshold, left, right, value); a leaf has feature -1."""
        nodes: list = []

        def grow(rows, depth):
            me = len(nodes)
            nodes.append(None)
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if depth < DEPTH and len(rows) >= 2 * LEAF:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    cg, ch, cn = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = cg**2 / (ch + RIDGE) + (sg - cg) ** 2 / (sh - ch + RIDGE) - sg**2 / (sh + RIDGE)
                    gain[(cn < LEAF) | (len(rows) - cn < LEAF)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] is None:
                nodes[me] = (-1, 0.0, 0, 0, float(-RATE * sg / (sh + RIDGE)))
            else:
                _, j, k = best
                go = binned[rows, j] <= k
                left = grow(rows[go], depth + 1)
                right = grow(rows[~go], depth + 1)
                nodes[me] = (j, float(edges[j][k]), left, right, 0.0)
            return me

        grow(np.arange(len(g)), 0)
        return nodes

    @staticmethod
    def _apply(tree: list, x: np.ndarray) -> np.ndarray:
        j, t, left, right, v = (np.array(c) for c in zip(*tree))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            f = j[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= t[at], left[at], right[at])
            at = np.where(f >= 0, down, at)
        return v[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Upper ends and values of the increasing step function nearest to ``y``; ties of a score are one point."""
    s, inv = np.unique(score, return_inverse=True)
    w, m = np.bincount(inv, weight), np.bincount(inv, weight * y)
    ends, sums, weights = [], [], []
    for a, b, c in zip(s, m, w):
        ends.append(float(a))
        sums.append(float(b))
        weights.append(float(c))
        while len(sums) > 1 and sums[-2] * weights[-1] >= sums[-1] * weights[-2]:
            ends.pop(-2)
            sums[-2:] = [sums[-2] + sums[-1]]
            weights[-2:] = [weights[-2] + weights[-1]]
    return ends, [a / b for a, b in zip(sums, weights)]


class Model:
    """Lexicon, trees and calibration; without examples of both classes, a constant."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray, share: float):
        self.lexicon, self.features, self.trees = lexicon, None, None
        self.constant = float(share)
        if min(np.sum(y == 1), np.sum(y == 0)) < 2 * FOLDS:
            return
        out = np.zeros(len(y))
        for k in np.unique(fold):
            out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        # Both classes are sampled to a bound; weights bring their true shares back.
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        self.ends, self.values = isotonic(out, y, weight)
        self.trees = Trees().fit(x, y)

    def __getstate__(self):
        return self.__dict__ | {"features": None}

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        if self.features is None:
            self.features = Features(self.lexicon)
        raw = self.trees.raw(self.features.matrix(texts))
        step = np.array([self.values[min(bisect_right(self.ends, r - 1e-12), len(self.values) - 1)] for r in raw])
        # Within a step the raw score still orders texts, by less than any step.
        return np.clip(step + 1e-3 * (1 / (1 + np.exp(-raw)) - 0.5), 0.0, 1.0)


def lexicon_of(a: np.ndarray, b: np.ndarray, n1: int, n0: int, words: list[str]) -> dict[str, float]:
    """Words with their log odds, from the toxic and other texts that hold them out of ``n1`` and ``n0``."""
    odds = np.log((a + 0.5) / (n1 + 1.0)) - np.log((b + 0.5) / (n0 + 1.0))
    error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    fine = (a >= MIN_DOCS) & (odds >= MIN_ODDS) & (odds >= MIN_Z * error)
    return {words[i]: float(odds[i]) for i in np.flatnonzero(fine)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled texts of each class.

    Texts that differ in case and white space only are one, toxic if one of them is. What comes to the driver is bounded
    by the sample: its words that may be in a lexicon, and a row of features for each text.
    """
    tables = Written(docs.sparkSession, "toxicity")
    texts = labelled(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "toxic", sample)
    whole = F.xxhash64(F.regexp_replace(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"\s+", " "))
    texts = tables.put(texts.groupBy(whole.alias("whole")).agg(F.max("y").alias("y"), F.min("text").alias("text")))
    texts = texts.withColumn("fold", F.pmod("whole", F.lit(FOLDS)).cast("int"))
    total = {r[0]: r[1] for r in labels.where(train_rows() & F.col("toxic").isNotNull()).groupBy(F.col("toxic").cast("int")).count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    size = np.zeros((2, FOLDS), np.int64)
    for r in texts.where("y in (0, 1)").groupBy("y", "fold").count().collect():
        size[r.y, r.fold] = r["count"]

    def split(batch):
        return {"w": pa.array([list(words_of(t)) if t else [] for t in batch], pa.list_(pa.string()))}

    words = map_text(texts, split, "w array<string>", "y", "fold").select("y", "fold", F.explode("w").alias("w"))
    each = [F.count(F.when((F.col("y") == y) & (F.col("fold") == k), 1)).alias(f"n{y}_{k}") for y in (0, 1) for k in range(FOLDS)]
    counts = words.groupBy("w").agg(*each).where(F.greatest(*[F.col(f"n1_{k}") for k in range(FOLDS)]) > 0)
    counts = counts.where(sum(F.col(f"n1_{k}") for k in range(FOLDS)) >= MIN_DOCS).orderBy("w").collect()
    names = [r.w for r in counts]
    seen = np.array([[[r[f"n{y}_{k}"] for k in range(FOLDS)] for y in (0, 1)] for r in counts], np.int64).reshape(-1, 2, FOLDS)

    def learned(fold: int | None) -> dict[str, float]:
        rest = np.array([k != fold for k in range(FOLDS)])
        n = seen[:, :, rest].sum(axis=2)
        return lexicon_of(n[:, 1], n[:, 0], size[1, rest].sum(), size[0, rest].sum(), names)

    rows = []
    for k in range(FOLDS):

        def measure(batch, lexicon=learned(k)):  # noqa: B008
            return {"x": pa.array(Features(lexicon).matrix(batch).tolist(), pa.list_(pa.float64()))}

        rows += map_text(texts.where(F.col("fold") == k), measure, "x array<double>", "y", "fold").collect()
    rows.sort(key=lambda r: (r.x, r.y, r.fold))
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(NAMES))
    y, fold = np.array([r.y for r in rows], np.float64), np.array([r.fold for r in rows])
    tables.only()
    return Model(learned(None), x, y, fold, share)


def score(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """``carry`` columns with ``score`` and ``predicted`` of every whole text; null counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        p = sent.value.score(texts)
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())}

    return map_text(docs, run, "score double, predicted int", *carry)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    The model learns only from labelled rows whose crc32 of the id as text is not 1 modulo 3. Null and empty texts get
    a score as texts without words. A null doc_id is not learned from and not held out. Repeated rows each get a row.
    Without labels of both classes the score is the share of toxic ones. Other columns are not read.
    """
    out = score(docs, fit(docs, labels, sample), "doc_id")
    return out.select("doc_id", F.coalesce(~train_rows(), F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in one pass.

    Rows are judged by their text alone: null and empty texts score as texts without words, repeated rows alike, and
    all columns pass unchanged whatever their names. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            p = sent.value.score(b.column("text").to_pylist()) if b.num_rows else np.zeros(0)
            yield b.filter(pa.array(p < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
