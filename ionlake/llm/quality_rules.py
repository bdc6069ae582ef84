"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every document gets exact word statistics and a base verdict. The documents that pass the base rules give vectors of
transformed statistics. For each language and source, and as its parents for each language and for all, concentration
steps look for the share ALPHA of the vectors whose covariance has the least determinant: each step measures every
vector's Mahalanobis distance by the last estimate, takes the nearest share, and estimates anew from it. A step is one
aggregation: sums by group and distance bin, combined on the map side, so a hot source does no harm and no group meets
in one task. Several starts are followed, each until its determinant falls no more, and the smallest determinant wins:
a robust diagonal one, the classical one, and the estimates of small parts chosen by hash. In the end a group's estimate
is joined with its parent's, which counts as PRIOR vectors: a large group stands by itself, a small one leans on its
language, and there is no size at which the rule changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Written, at_most, sliced

WINDOW = 8
#: Share of a group's vectors that an estimate rests on.
ALPHA = 0.75
#: A document is rejected when its distance is beyond that of so small a share of normal vectors: of the powers of ten, the
#: one with the fewest wrong verdicts on the labels of sf0.1 that models may learn from (``train_rows``).
REJECT_SHARE = 1e-5
#: How many vectors the estimate of a parent counts as (four for each dimension).
PRIOR = 20
#: A start is followed until a step lowers the logarithm of its determinant by no more than this.
TOLERANCE = 1e-3
#: Starts from parts of a group, and the share of it that each part is.
PARTS, PART = 3, 8
#: Bins of log2(1 + squared distance) for each doubling; the nearest share is whole bins.
BINS = 24
#: Standard deviations that no estimate falls below, in units of the vectors below, as most documents share one value.
FLOORS = (0.25, 0.06, 0.25, 0.35, 0.35)
DIM = len(FLOORS)
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_NAMES = [c.split()[0] for c in _STATS.split(", ")]
_PAIRS = list(combinations_with_replacement(range(DIM), 2))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], np.uint64)
_BLANK, _SIGNS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text has twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += ids[k : k + n] * _POWERS[k]
    h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    maybe = np.sort(order[np.r_[same, False] | np.r_[False, same]])
    # Equal windows have equal sums; those few are told apart exactly.
    seen: dict[tuple, list[int]] = {}
    for i in maybe.tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    mark = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            a = np.array(at)
            np.add.at(mark, a, 1)
            np.add.at(mark, a + WINDOW, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def word_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes part at \\x20 and \\x09-\\x0D only
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    blanks = len(raw) - len(raw.translate(None, _BLANK))
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, _SIGNS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed():
    """The base rule: too few words, or too large a part of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list:
    """Transformed statistics: log length, log word length, and damped shares of symbols, repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.asinh(20 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.asinh(20 * F.col("n_repeat_words") / n),
    ]


def chi2_quantile(p: float, df: int, upper: bool = False) -> float:
    """Quantile of a chi-squared distribution; of the upper tail with ``upper``."""

    def tail(x: float) -> float:  # closed forms of the regularised gamma function at halves
        y = x / 2
        if df % 2 == 0:
            return math.exp(-y) * sum(y**k / math.factorial(k) for k in range(df // 2))
        s = math.erfc(math.sqrt(y))
        return s + math.exp(-y) * sum(y ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (df - 1) // 2 + 1))

    want = p if upper else 1 - p
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > want else (lo, mid)
    return (lo + hi) / 2


def _distance(x: list, mean: str = "mean", prec: str = "prec"):
    d = [x[i] - F.element_at(mean, i + 1) for i in range(DIM)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + (1 if i == j else 2) * F.element_at(prec, k + 1) * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _estimate(n: float, sums: np.ndarray, cross: np.ndarray, around: np.ndarray):
    """Mean, packed precision and log determinant from sums of differences to ``around``."""
    m = sums / n
    cov = np.zeros((DIM, DIM))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = cross[k] / n - m[i] * m[j]
    cov = (cov + cov.T) / 2 + np.diag(np.square(FLOORS))
    prec = np.linalg.inv(cov)
    return (around + m).tolist(), [float(prec[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])


_STATE = "g string, parent string, start int, n long, mean array<double>, prec array<double>, logdet double, scale double"
_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]


def _concentrate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one group and start from its distance bins."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy(np.float64)
    cum = np.cumsum(n)
    last = int(np.searchsorted(cum, ALPHA * cum[-1]))  # whole bins, at least the share
    size = float(cum[last])
    sums, cross = (np.stack(pdf[c].iloc[: last + 1].to_numpy()).sum(axis=0) for c in ("s", "c"))
    around = np.asarray(pdf["around"].iloc[0])
    mean, prec, logdet = _estimate(size, sums, cross, around)
    # The distance that bounds the share, against what it is for normal vectors, scales later distances.
    edge = 2.0 ** ((pdf["bin"].iloc[last] + 1) / BINS) - 1
    scale = max(1.0, edge / chi2_quantile(min(size / cum[-1], 0.999), DIM))
    row = (key[0], pdf["parent"].iloc[0], key[1], int(cum[-1]), mean, prec, logdet, scale)
    return pd.DataFrame([row], columns=_COLUMNS)


def _with_state(vecs: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """Vectors with their group's estimate, broadcast only while groups are few."""
    return vecs.join(F.broadcast(state) if at_most(state, most) else state, "g")


def _bins(pairs: DataFrame) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(DIM)]
    d = [x[i] - F.element_at("mean", i + 1) for i in range(DIM)]
    binned = pairs.withColumn("bin", F.floor(BINS * F.log2(1 + _distance(x))).cast("int"))
    return binned.groupBy("g", "start", "bin").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(d[i]) for i in range(DIM)]).alias("s"),
        F.array(*[F.sum(d[i] * d[j]) for i, j in _PAIRS]).alias("c"),
        F.first("mean").alias("around"),
        F.first("parent").alias("parent"),
    )


def _starts(vecs: DataFrame) -> DataFrame:
    """Starts of each group: medians with scaled quartiles, mean with covariance, and those of parts chosen by hash."""
    x = [F.col(f"x{i}") for i in range(DIM)]
    part = F.pmod(F.xxhash64(*x), F.lit(PART))
    made = [F.count("*").alias("n"), F.first("parent").alias("parent")]
    made += [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(x)]
    for p in range(PARTS + 1):
        of = (lambda c: c) if p == 0 else (lambda c, p=p: F.when(part == p, c))
        made += [F.avg(of(c)).alias(f"a{p}_{i}") for i, c in enumerate(x)]
        made += [F.covar_pop(of(x[i]), of(x[j])).alias(f"c{p}_{k}") for k, (i, j) in enumerate(_PAIRS)]

    def make(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                sd = [max((float(r[f"q{i}"][2]) - float(r[f"q{i}"][0])) / 1.349, FLOORS[i]) for i in range(DIM)]
                prec = [1 / sd[i] ** 2 if i == j else 0.0 for i, j in _PAIRS]
                head = r["g"], r["parent"]
                rows.append((*head, 0, int(r["n"]), [float(r[f"q{i}"][1]) for i in range(DIM)], prec, math.inf, 1.0))
                for p in range(PARTS + 1):
                    if r[f"a{p}_0"] is not None and not math.isnan(r[f"a{p}_0"]):
                        cross = np.array([r[f"c{p}_{k}"] for k in range(len(_PAIRS))])
                        mean, prec, _ = _estimate(1.0, np.zeros(DIM), cross, np.array([r[f"a{p}_{i}"] for i in range(DIM)]))
                        rows.append((*head, p + 1, int(r["n"]), mean, prec, math.inf, 1.0))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return vecs.groupBy("g").agg(*made).mapInPandas(make, _STATE)


def _keys():
    """Groups of a row with their parents: its language and source, its language, all."""
    lang, source = (F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n")) for c in ("lang", "source"))
    both, one, all_ = F.to_json(F.array(lang, source)), F.to_json(F.array(lang)), F.lit("all")
    return F.array(*[F.struct(g.alias("g"), p.alias("parent")) for g, p in ((both, one), (one, all_), (all_, F.lit(None).cast("string")))])


def _unpacked(prec) -> np.ndarray:
    """Covariance of a packed precision."""
    out = np.zeros((DIM, DIM))
    for k, (i, j) in enumerate(_PAIRS):
        out[i, j] = out[j, i] = prec[k]
    return np.linalg.inv(out)


def _leaning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Estimates joined with their parents' (``p_`` columns)."""
    for pdf in batches:
        rows = []
        for r in pdf.to_dict("records"):
            own, prior = ALPHA * r["n"], PRIOR
            w = own / (own + prior)
            cov = w * _unpacked(r["prec"]) + (1 - w) * _unpacked(r["p_prec"])
            prec = np.linalg.inv((cov + cov.T) / 2)
            mean = w * np.asarray(r["mean"]) + (1 - w) * np.asarray(r["p_mean"])
            rows.append((r["g"], mean.tolist(), [float(prec[i, j]) for i, j in _PAIRS], float(r["scale"] ** w * r["p_scale"] ** (1 - w))))
        yield pd.DataFrame(rows, columns=["g", "mean", "prec", "scale"])


_FOUND = "g string, mean array<double>, prec array<double>, scale double"


def estimates(vecs: DataFrame, tables: Written, broadcast_groups: int = 20_000) -> DataFrame:
    """The estimate of each language and source ``g`` that has vectors ``x0``.., joined with those of its parents."""
    each = vecs.select(F.explode("keys").alias("k"), *[f"x{i}" for i in range(DIM)]).select("k.*", *[f"x{i}" for i in range(DIM)])
    state = tables.put(_starts(each).withColumn("moves", F.lit(True)))
    plain = each.drop("parent")
    # Each step that counts lowers a determinant by TOLERANCE, and floors bound it, so this ends.
    while state.where("moves").limit(1).count():
        moving = state.where("moves").drop("moves")
        new = _bins(_with_state(plain, moving, broadcast_groups)).groupBy("g", "start").applyInPandas(_concentrate, _STATE)
        new = new.select("g", "start", F.struct("mean", "prec", "logdet", "scale").alias("new"))
        both = state.join(new, ["g", "start"], "left")
        better = F.coalesce(F.col("new.logdet") < F.col("logdet") - TOLERANCE, F.lit(False))
        next_ = [F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "prec", "logdet", "scale")]
        after = tables.put(both.select("g", "parent", "start", "n", *next_, better.alias("moves")))
        tables.drop(state)
        state = after
    best = state.groupBy("g").agg(F.first("parent").alias("parent"), F.min_by(F.struct("n", "mean", "prec", "scale"), F.struct("logdet", "start")).alias("e"))
    best = tables.put(best.select("g", "parent", "e.*"))
    found, leaned = best.where("parent is null").select("g", "mean", "prec", "scale"), []
    for level in (F.col("parent") == "all", F.col("parent") != "all"):
        parents = found.select(F.col("g").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("mean", "prec", "scale")])
        # Written, as a task that leans on parents while it makes them would take two Python workers, which live on.
        found = tables.put(best.where(level).join(parents, "parent").mapInPandas(_leaning, _FOUND))
        leaned.append(found)
    tables.drop(state, best, *leaned[:-1])
    return found


def _packed(docs: DataFrame, carry: list[str], text: bool) -> DataFrame:
    """``row``, a struct of the carried columns, with ``keys``, the statistics and ``base_failed``.

    With ``text``, the carried text is the one that is measured, so that it is sent once.
    """
    group = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select(F.struct(*carry).alias("row"), *group, *([] if text else [F.col("text").cast("string").alias("text")]))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for b in sliced(batches):
            texts = (b.column("row").field("text") if text else b.column("text")).to_pylist()
            made = zip(*map(word_stats, texts), strict=True) if texts else [[]] * 5
            cols = {c: b.column(c) for c in ("row", "lang", "source")} | {k: pa.array(v, pa.int64()) for k, v in zip(_NAMES, made, strict=True)}
            yield pa.RecordBatch.from_pydict(cols)

    out = rows.mapInArrow(run, f"row {kinds['row']}, lang string, source string, {_STATS}")
    return out.withColumn("base_failed", base_failed()).withColumn("keys", _keys()).drop("lang", "source")


def _vectors(stats: DataFrame) -> DataFrame:
    return stats.where(~F.col("base_failed")).select("keys", *[x.alias(f"x{i}") for i, x in enumerate(vector())])


def _verdict(stats: DataFrame, found: DataFrame, broadcast_groups: int) -> DataFrame:
    """``distance`` and ``kept`` for rows with statistics."""
    e = found.select("g", "mean", "prec", "scale")
    rows = stats.withColumn("g", F.get("keys", F.lit(0)).getField("g"))
    rows = rows.join(F.broadcast(e) if at_most(found, broadcast_groups) else e, "g", "left")
    d2 = F.when(~F.col("base_failed"), _distance(vector()) / F.col("scale"))
    cut = chi2_quantile(REJECT_SHARE, DIM, upper=True)
    return rows.withColumn("distance", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(d2 <= cut, F.lit(True)))


def judge(docs: DataFrame, *carry: str, broadcast_groups: int = 20_000) -> DataFrame:
    """``carry`` columns of every row with its statistics, ``base_failed``, ``distance`` and ``kept``.

    ``kept`` is false where the base rule fails, else whether the squared Mahalanobis distance to the estimate of the
    row's language and source (null is a value of its own; a small group leans on its parents) is within the cut. ``distance`` is
    null where the base rule fails. Null and empty texts have no words and fail it. Repeated rows each get a row and
    weigh as often; other columns are not read; an empty table gives an empty one.
    """
    tables = Written(docs.sparkSession, "quality")
    stats = tables.put(_packed(docs, list(carry), False))
    found = estimates(_vectors(stats), tables, broadcast_groups)
    rows = _verdict(stats, found, broadcast_groups)
    return rows.select("row.*", *_NAMES, "base_failed", "distance", "kept")


def keep(docs: DataFrame, broadcast_groups: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps.

    The estimates come from statistics written without the texts; a second pass measures each text again and drops
    what is rejected, so texts are neither written in between nor shuffled while estimates are few enough to broadcast.
    """
    tables = Written(docs.sparkSession, "quality-keep")
    stats = tables.put(_packed(docs, ["lang"], False))
    found = estimates(_vectors(stats), tables, broadcast_groups)
    tables.drop(stats)
    rows = _verdict(_packed(docs, docs.columns, True), found, broadcast_groups)
    return rows.where("kept").select("row.*")
