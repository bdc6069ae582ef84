"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter's maximum goes through
a softmax layer. Training follows gradients through the place of each maximum. For scoring, the embedding and each
filter are multiplied out into tables by pairs of bytes, so a filter's response is a sum of two looked-up rows.
A whole text is cut into windows that overlap by the widest filter; its prediction is their mean weighted by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import map_text, sliced, train_rows
from ionlake.llm.sampling import _SCALE, with_share

#: Windows of each language that the fit may use, drawn from all windows of all texts, and of all languages together.
SAMPLE, TOTAL = 3200, 200_000
LENGTH, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
EPOCHS, BATCH, RATE = 8, 64, 4e-3
NONE = "und"
_LETTER = re.compile(r"[^\W\d_]")
_STRIDE = LENGTH - max(WIDTHS) + 1


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text padded with zeros, and the bytes that each is the first to cover."""
    n = max(1, -(-max(1, len(raw) - LENGTH + _STRIDE) // _STRIDE))
    flat = np.zeros((n - 1) * _STRIDE + LENGTH, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)[: len(flat)]
    out = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[::_STRIDE]
    size = np.full(n, _STRIDE, np.int64)
    size[-1] = max(1, len(raw) - (n - 1) * _STRIDE)
    return out, size


class ByteCNN:
    """Multi-width byte filters, max pooling and softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": r.normal(0, 0.3, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)
        self.tables = None

    def _loss_gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        pooled, where = [], []
        for w in WIDTHS:
            seen = p["e"][np.lib.stride_tricks.sliding_window_view(x, w, axis=1)].reshape(n, -1, w * EMBED)
            act = seen @ p[f"w{w}"]
            at = act.argmax(axis=1)
            top = np.take_along_axis(act, at[:, None], 1)[:, 0] + p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            where.append((at, np.take_along_axis(seen, at[:, :, None], 1), top > 0))
        h = np.concatenate(pooled, axis=1)
        d = _softmax(h @ p["o"] + p["c"])
        d[np.arange(n), y] -= 1
        d /= n
        g["o"], g["c"] = h.T @ d, d.sum(axis=0)
        back = d @ p["o"].T
        for k, w in enumerate(WIDTHS):
            at, seen, on = where[k]
            b = back[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"w{w}"], g[f"b{w}"] = np.einsum("nfe,nf->ef", seen, b), b.sum(axis=0)
            de = (b[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["e"], np.take_along_axis(x, at + j, 1), de[:, :, j])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteCNN:
        """Adam steps over shuffled batches; classes come in equal parts from the sample."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            order = r.permutation(len(x))
            for k in range(0, len(x), BATCH):
                step += 1
                g = self._loss_gradient(x[order[k : k + BATCH]], y[order[k : k + BATCH]])
                for a in self.p:
                    m[a] += 0.1 * (g[a] - m[a])
                    v[a] += 0.001 * (g[a] ** 2 - v[a])
                    self.p[a] -= rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.999**step)) + 1e-8)
        return self

    def _tabulate(self) -> None:
        """Filter responses by single bytes and by pairs of bytes."""
        self.tables = {}
        for w in WIDTHS:
            parts = self.p[f"w{w}"].reshape(w, EMBED, FILTERS)
            single = [self.p["e"] @ parts[j] for j in range(w)]
            self.tables[w] = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                self.tables[w].append((w - 1, single[w - 1]))

    def log_probabilities(self, x: np.ndarray, step: int = 32) -> np.ndarray:
        """Of each class for each window."""
        if self.tables is None:
            self._tabulate()
        out = np.zeros((len(x), len(self.classes)), np.float32)
        for k in range(0, len(x), step):
            part = x[k : k + step]
            one = part.astype(np.int32)
            pair = one[:, :-1] << 8 | one[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = LENGTH - w + 1
                act = None
                for j, t in self.tables[w]:
                    rows = t.take(pair[:, j : j + n] if len(t) == 65536 else one[:, j : j + n], axis=0)
                    act = rows if act is None else np.add(act, rows, out=act)
                pooled.append(np.maximum(act.max(axis=1) + self.p[f"b{w}"], 0))
            out[k : k + step] = np.log(_softmax(np.concatenate(pooled, axis=1) @ self.p["o"] + self.p["c"]) + 1e-9)
        return out

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def predict(self, texts) -> tuple[list[str], list[float]]:
        lang, score = [NONE] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not which or not self.classes:
            return lang, score
        at = 0
        while at < len(which):  # windows of several texts at once, in bounded memory
            xs, sizes, owner = [], [], []
            while at < len(which) and sum(map(len, sizes)) < 2048:
                a, b = windows(texts[which[at]].encode())
                xs.append(a)
                sizes.append(b)
                owner.append(which[at])
                at += 1
            logs = self.log_probabilities(np.concatenate(xs))
            k = 0
            for i, b in zip(owner, sizes):
                mean = (logs[k : k + len(b)] * b[:, None]).sum(axis=0) / b.sum()
                q = _softmax(mean[None].astype(np.float64))[0]
                j = int(q.argmax())
                lang[i], score[i] = self.classes[j], float(min(1.0, q[j]))
                k += len(b)
        return lang, score


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _drawn(text: str, share: int) -> list[bytes]:
    """Of a text's windows those whose hash falls in the share; a quarter are cut short, so that short texts are known too."""
    raw = text.encode()
    if not _LETTER.search(text):
        return []
    n = -(-max(1, len(raw) - LENGTH + _STRIDE) // _STRIDE)
    out = []
    for i in range(n):
        h = xxhash.xxh64_intdigest(raw[i * _STRIDE : i * _STRIDE + LENGTH], i)
        if h % _SCALE < share:
            out.append(raw[i * _STRIDE : i * _STRIDE + (LENGTH if h >> 62 else 16 + (h >> 32) % 48)])
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> ByteCNN:
    """A network for the languages named in ``lang`` of rows that may be learned from.

    Every window of every such text may be drawn, with a chance that makes about ``sample`` windows of each language and
    ``total`` of all; equal windows count once.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & train_rows())
    windows_of = F.ceil(F.greatest(F.lit(1), F.octet_length("text") - (LENGTH - _STRIDE)) / F.lit(_STRIDE))
    rows = with_share(rows.select("lang", "text"), "lang", windows_of, sample, total)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = [_drawn(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("share").to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(m) for m in made]))
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang").take(at), "w": pa.array([w for m in made for w in m], pa.binary())})

    drawn = rows.select("lang", "text", "share").mapInArrow(cut, "lang string, w binary").distinct()
    rows = sorted((r.lang, bytes(r.w)) for r in drawn.toLocalIterator())
    classes = sorted({a for a, _ in rows})
    net = ByteCNN(classes)
    if len(classes) > 1:
        x = np.zeros((len(rows), LENGTH), np.uint8)
        for i, (_, w) in enumerate(rows):
            x[i, : len(w)] = np.frombuffer(w, np.uint8)
        net.fit(x, np.searchsorted(classes, [a for a, _ in rows]))
    return net


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row.

    Learned from ``text`` and non-null ``lang`` of rows whose crc32 of the id as text is not 1 modulo 3. A null text, or
    one without a letter, is ``und`` with score 0, and so is every text where there is nothing to learn from; with one
    language all others are that. A null doc_id is not learned from and not held out. Repeated rows each get a row;
    texts of any length are read to their end in windows; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(texts):
        lang, score = sent.value.predict(texts)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    out = map_text(docs, run, "lang_pred string, score double", "doc_id")
    return out.select("doc_id", F.coalesce(~train_rows(), F.lit(False)).alias("held_out"), "lang_pred", "score")
