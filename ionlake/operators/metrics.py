"""Column metrics of a long matrix (sample_id, group, value), each one plan of partial aggregates.

NaN is missing unless said otherwise. Every function returns one row for each key of ``by``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionlake.functions.columns import MAD_SCALE, NAN, divide, ieee_divide, nan_to_null, null_to_nan

AGGREGATIONS = ("lod", "loq", "sum", "avg", "median", "min", "max", "std")


def aggregation(method: str, value: str = "value") -> Column:
    """An aggregate in which NaN propagates: one NaN value makes the result NaN. std and the limits need two values."""
    v = F.col(value)
    std = null_to_nan(F.stddev_samp(v))
    made = {"lod": F.avg(v) + 3 * std, "loq": F.avg(v) + 10 * std, "sum": F.sum(v), "avg": F.avg(v), "median": F.median(v), "min": F.min(v), "max": F.max(v), "std": std}
    if method not in made:
        raise ValueError(f"unknown aggregation {method!r}; one of {', '.join(AGGREGATIONS)}")
    return F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(made[method])


def aggregate(values: DataFrame, method: str, by: str = "group") -> DataFrame:
    """Aggregate the values of each column (``by`` group) or row (``by`` sample_id)."""
    return values.groupBy(by).agg(aggregation(method).alias("metric"))


def _spread(values: DataFrame, by: list[str], robust: bool) -> DataFrame:
    """Centre and deviation of each key, of non-missing values: mean and sample std, or median and scaled MAD."""
    clean = values.select(*by, nan_to_null("value").alias("value"))
    if not robust:
        return clean.groupBy(*by).agg(F.avg("value").alias("centre"), F.stddev_samp("value").alias("spread"))
    mid = clean.groupBy(*by).agg(F.median("value").alias("centre"))
    # Keys may be null, so the join is null-safe.
    left, right = clean.alias("l"), mid.alias("r")
    on = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
    off = left.join(right, on).select(*[F.col(f"l.{b}").alias(b) for b in by], "value", "centre")
    return off.groupBy(*by).agg(F.first("centre").alias("centre"), (MAD_SCALE * F.median(F.abs(F.col("value") - F.col("centre")))).alias("spread"))


def cv(values: DataFrame, robust: bool = False, by: list[str] | None = None) -> DataFrame:
    """Coefficient of variation; NaN for a zero or missing centre or fewer than two values (plain)."""
    by = by or ["group"]
    return _spread(values, by, robust).select(*by, null_to_nan(divide(F.col("spread"), F.col("centre"))).alias("metric"))


def detection_rate(values: DataFrame, threshold: float | Column = 0.0, by: list[str] | None = None) -> DataFrame:
    """Share of all rows with a value of at least ``threshold``; NaN is not detected, a NaN threshold counts as 0."""
    by = by or ["group"]
    thr = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    seen = nan_to_null("value") >= F.coalesce(nan_to_null(thr), F.lit(0.0))
    return values.groupBy(*by).agg((F.sum(F.when(seen, 1.0).otherwise(0.0)) / F.count("*")).alias("metric"))


def dratio(qc: DataFrame, sample: DataFrame, robust: bool = False) -> DataFrame:
    """Deviation among quality controls over that among samples; infinite or NaN where the latter is 0."""
    q, s = _spread(qc, ["group"], robust), _spread(sample, ["group"], robust)
    both = q.select("group", F.col("spread").alias("q")).join(s.select("group", F.col("spread").alias("s")), "group")
    return both.select("group", null_to_nan(ieee_divide(F.col("q"), F.col("s"))).alias("metric"))


def limit(values: DataFrame, times: float) -> DataFrame:
    """mean + times * sample std of non-missing values; 0 where that is undefined."""
    return _spread(values, ["group"], False).select("group", F.coalesce(F.col("centre") + times * F.col("spread"), F.lit(0.0)).alias("metric"))


def lod(values: DataFrame) -> DataFrame:
    """Limit of detection."""
    return limit(values, 3.0)


def loq(values: DataFrame) -> DataFrame:
    """Limit of quantification."""
    return limit(values, 10.0)


def average_ranks(df: DataFrame, value: str, by: list[str], name: str = "rank", splits: int = 0) -> DataFrame:
    """Ranks from 1 within ``by``; equal values share their mean rank.

    With ``splits``, for keys that may hold much of a large table, a key's distinct values are cut at that many
    quantiles: counts before a part and within it are summed apart, so no task orders a whole key.
    """
    if not splits:
        order = W.partitionBy(*by).orderBy(value)
        return df.withColumn(name, F.rank().over(order) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2)
    keys = [f"__k{i}" for i in range(len(by))]
    counts = df.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(F.col("__v").cast("double"), [k / splits for k in range(1, splits)], 1000).alias("__cuts"))
    same = lambda l, r, names: [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in names]
    parts = counts.alias("c").join(cuts.alias("q"), same("c", "q", keys))
    part = F.coalesce(F.size(F.filter("q.__cuts", lambda x: x < F.col("c.__v").cast("double"))), F.lit(0))
    parts = parts.select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.__v").alias("__v"), F.col("c.__n").alias("__n"), part.alias("__part"))
    sums = parts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "__part", before.alias("__before"))
    inside = F.coalesce(F.sum("__n").over(W.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("__inside", inside).alias("p").join(sums.alias("s"), same("p", "s", [*keys, "__part"]))
    rank = F.col("s.__before") + F.col("p.__inside") + (F.col("p.__n") + 1) / 2
    ranks = placed.select(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.__v").alias("__v"), rank.alias(name))
    on = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip([*by, value], [*keys, "__v"], strict=True)]
    return df.join(ranks, on).drop(*keys, "__v")


def correlation(values: DataFrame, samples: DataFrame, field: str, method: str = "pearson", by: list[str] | None = None) -> DataFrame:
    """Correlation of each column with a numeric field of the samples; NaN for constant columns or under two rows."""
    by = by or ["group"]
    kind = dict(samples.dtypes).get(field)
    if kind is None:
        raise KeyError(f"samples have no field {field!r}")
    if kind not in ("int", "bigint", "double", "float", "smallint", "tinyint") and not kind.startswith("decimal"):
        raise ValueError(f"{field} is not numeric")
    meta = samples.select("sample_id", F.col(field).cast("double").alias("y"), *[c for c in by if c != "group"])
    pairs = values.join(meta, "sample_id").select(*by, F.col("value").alias("x"), "y")
    if method == "spearman":
        pairs = average_ranks(average_ranks(pairs, "x", by, "x"), "y", by, "y")
    elif method != "pearson":
        raise ValueError(f"unknown correlation {method!r}")
    spread = pairs.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("s", F.stddev_pop), ("m", F.max), ("l", F.min))], F.count("*").alias("n"), F.covar_pop("x", "y").alias("cov"))
    fine = (F.col("n") > 1) & (F.col("m_x") != F.col("l_x")) & (F.col("m_y") != F.col("l_y")) & (F.col("s_x") * F.col("s_y") > 0)
    return spread.select(*by, F.when(fine, F.col("cov") / (F.col("s_x") * F.col("s_y"))).otherwise(F.lit(NAN)).alias("metric"))


def covariance(rows: DataFrame, vector: str, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count of an array column.

    Each partition sums products of differences to the mean; size * size sums come to the driver.
    """
    flat = rows.select(F.col(vector).cast("array<double>").alias("x"))
    r = flat.agg(F.count("*").alias("n"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(size)]).head()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(size)])

    def gram(batches):
        total = np.zeros((size, size))
        for p in batches:
            if len(p):
                x = np.stack(p["x"].to_numpy()) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(size), size), "j": np.tile(np.arange(size), size), "s": total.ravel()})

    cov = np.zeros((size, size))
    for i, j, total in flat.mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        cov[i, j] = total / max(1, r["n"] - 1)
    return mean, cov, r["n"]


class PCA:
    """Principal components of centred rows: directions, loadings, variance. Signs make the largest loading positive."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, n_components: int):
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:n_components]
        self.mean, self.variance, self.components = mean, np.maximum(values[order], 0), vectors[:, order].T
        big = np.abs(self.components).argmax(axis=1)
        self.components *= np.sign(self.components[np.arange(len(big)), big])[:, None]
        self.loadings = self.components.T * np.sqrt(self.variance)

    def scores(self, rows: DataFrame, vector: str, name: str = "score") -> DataFrame:
        """Scores of each row, one array expression in the JVM."""
        centre = F.array(*[F.lit(float(m)) for m in self.mean])
        parts = [F.aggregate(F.zip_with(F.zip_with(F.col(vector), centre, lambda a, b: a.cast("double") - b), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in self.components]
        return rows.withColumn(name, F.array(*parts))


def pca(rows: DataFrame, vector: str, size: int, n_components: int = 2) -> PCA:
    """Fit on an array column of ``size`` values; only the covariance comes to the driver. NaN values are refused."""
    if rows.where(F.exists(vector, lambda x: F.isnan(x) | x.isNull())).limit(1).count():
        raise ValueError("missing values need to be imputed before PCA")
    mean, cov, _ = covariance(rows, vector, size)
    return PCA(mean, cov, min(n_components, size))
