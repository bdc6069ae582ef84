"""Feature matching across samples: islands, DBSCAN, species counts, mixture splitting, assignment and merging.

Neighbourhoods never cross a gap wider than the tolerance on one axis, so features are cut into islands on m/z and then
on retention time, and each island is clustered by itself. Only an island's features meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionlake.operators.joins import global_islands, islands
from ionlake.written import Written


def min_samples(sizes: Sequence[int], fraction: float) -> int:
    """Rounded (half to even) share of all samples, or the least over sample groups when several sizes are given."""
    return max(1, min(round(s * fraction) for s in sizes))


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels by Chebyshev density, -1 for noise. A point counts itself; border points join the cluster that finds them first."""
    n = len(x)
    order = np.argsort(x[:, 0], kind="stable")
    v = x[order]
    lo, hi = np.searchsorted(v[:, 0], v[:, 0] - eps), np.searchsorted(v[:, 0], v[:, 0] + eps, side="right")
    near = lambda i: lo[i] + np.flatnonzero((np.abs(v[lo[i] : hi[i]] - v[i]) <= eps).all(axis=1))
    core = np.array([len(near(i)) >= least for i in range(n)], bool)
    label = np.full(n, -1)
    rank = np.argsort(order)
    c = 0
    for start in rank[np.arange(n)] if n else []:
        if label[start] >= 0 or not core[start]:
            continue
        label[start], stack = c, [start]
        while stack:
            i = stack.pop()
            for j in near(i):
                if label[j] < 0:
                    label[j] = c
                    if core[j]:
                        stack.append(j)
        c += 1
    out = np.full(n, -1)
    out[order] = label
    return out


def gaussian_mixture(x: np.ndarray, k: int, steps: int = 100, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of a diagonal mixture by expectation maximisation from far-apart starts."""
    r = np.random.default_rng(seed)
    span = x.std(axis=0) + 1e-9
    z = x / span
    centres = [z[r.integers(len(z))]]
    while len(centres) < k:
        d = np.min([((z - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(z[int(np.argmax(d))])
    mean = np.array(centres) * span
    var, weight = np.tile(x.var(axis=0) / k**2 + 1e-9, (k, 1)), np.full(k, 1 / k)
    last = -np.inf
    for _ in range(steps):
        logp = np.log(weight) - 0.5 * (((x[:, None] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(axis=2)
        top = logp.max(axis=1, keepdims=True)
        p = np.exp(logp - top)
        total = p.sum(axis=1, keepdims=True)
        like = float((np.log(total) + top).mean())
        p /= total
        mass = p.sum(axis=0) + 1e-12
        mean = (p.T @ x) / mass[:, None]
        var = np.maximum((p.T @ x**2) / mass[:, None] - mean**2, 1e-9)
        weight = mass / len(x)
        if abs(like - last) < 1e-6:
            break
        last = like
    return mean, np.sqrt(var)


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; each row and column at most once. Shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = c[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def species_count(clustered: DataFrame, samples: DataFrame, fraction: float, groups: Sequence[str] | None = None) -> DataFrame:
    """How many species each cluster holds: the most features a sample has that enough samples of a group have.

    ``clustered`` has (cluster, sample_id), ``samples`` (sample_id, group). Three aggregations.
    """
    s = samples if groups is None else samples.where(F.col("group").isin(list(groups)))
    sizes = s.groupBy("group").agg(F.count("*").alias("size"))
    per = clustered.join(s.select("sample_id", "group"), "sample_id").groupBy("cluster", "group", "sample_id").count()
    have = per.groupBy("cluster", "group", F.col("count").alias("k")).agg(F.count("*").alias("n"))
    need = F.greatest(F.bround(F.col("size") * fraction), F.lit(1))
    ok = have.join(sizes, "group").where(F.col("n") >= need)
    return ok.groupBy("cluster").agg(F.max("k").cast("int").alias("species"))


def _split(pdf: pd.DataFrame, cols: list[str], k: int, max_deviation: float) -> np.ndarray:
    """Species label of each feature of a cluster; -1 for those too far or in excess in their sample."""
    x = pdf[cols].to_numpy(float)
    if len(x) == 1:
        return np.zeros(1, int)
    if k == 1:
        mean, sd = x.mean(axis=0)[None], np.maximum(x.std(axis=0), 1e-9)[None]
    else:
        mean, sd = gaussian_mixture(x, min(k, len(x)))
    dev = np.abs((x[:, None] - mean) / sd).max(axis=2)
    out = np.full(len(x), -1)
    for _, at in pdf.groupby("sample_id", sort=False).indices.items():
        for i, j in assign(dev[at]):
            if dev[at[i], j] <= max_deviation:
                out[at[i]] = j
    return out


def match_features(features: DataFrame, samples: DataFrame, tolerance: dict[str, float] | None = None, min_fraction: float = 0.25, max_deviation: float = 3.0, groups: Sequence[str] | None = None, bucket: float = 50.0) -> DataFrame:
    """``feature_id`` and ``group`` (a label, -1 for noise) of every feature.

    ``tolerance`` gives the descriptors and how far one species may vary. Labels are numbered by m/z. Each step is
    written, as a plan that holds all of them, each read several times, takes more memory than a driver has.
    """
    tolerance = tolerance or {"mz": 0.01, "rt": 5.0}
    cols = list(tolerance)
    eps = min(tolerance.values())
    tables = Written(features.sparkSession, "matching")
    scaled = tables.put(features.select("feature_id", "sample_id", *[(F.col(c).cast("double") * (eps / t)).alias(c) for c, t in tolerance.items()]))
    named = global_islands(scaled, cols[0], eps, max(bucket * eps, bucket * eps / tolerance[cols[0]]), "i0")
    keys = ["i0"]
    for c in cols[1:]:
        named = islands(named, keys, c, eps, f"i_{c}")
        keys.append(f"i_{c}")
    sizes = [r["count"] for r in (samples.where(F.col("group").isin(list(groups))) if groups else samples).groupBy("group").count().collect()]
    least = min_samples(sizes, min_fraction) if groups else min_samples([sum(sizes)], min_fraction)
    schema = "feature_id string, sample_id string, cluster string, " + ", ".join(f"`{c}` double" for c in cols)

    def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*cols, "feature_id"]).reset_index(drop=True)
        label = dbscan(pdf[cols].to_numpy(float), eps, least)
        name = "/".join(map(str, key))
        pdf["cluster"] = [f"{name}/{k}" if k >= 0 else None for k in label]
        return pdf[["feature_id", "sample_id", "cluster", *cols]]

    text = named.withColumn("feature_id", F.col("feature_id").cast("string")).withColumn("sample_id", F.col("sample_id").cast("string"))
    clustered = tables.put(text.groupBy(*keys).applyInPandas(cluster, schema))
    s = samples.withColumn("sample_id", F.col("sample_id").cast("string"))
    count = species_count(clustered.where("cluster is not null"), s, min_fraction, groups)
    known = clustered.join(count, "cluster")

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*cols, "feature_id"]).reset_index(drop=True)
        pdf["species_label"] = _split(pdf, cols, int(pdf["species"].iloc[0]), max_deviation)
        return pdf[["feature_id", "sample_id", "cluster", "species_label", *cols]]

    parts = tables.put(known.groupBy("cluster").applyInPandas(split, schema.replace("cluster string", "cluster string, species_label int")))
    good = parts.where("species_label >= 0")
    centres = good.groupBy("cluster", "species_label").agg(*[F.avg(c).alias(c) for c in cols])
    # One row for each species, far fewer than features: numbering them needs one order.
    numbered = centres.withColumn("group", (F.row_number().over(W.orderBy(*cols)) - 1).cast("int")).select("cluster", "species_label", "group")
    found = good.join(numbered, ["cluster", "species_label"]).select("feature_id", "group")
    out = tables.put(scaled.select(F.col("feature_id").cast("string")).join(found, "feature_id", "left").select("feature_id", F.coalesce("group", F.lit(-1)).alias("group")))
    tables.only(out)
    return out


def merge_groups(features: DataFrame, tolerance: dict[str, float] | None = None, max_overlap: float = 0.25) -> DataFrame:
    """Merge groups with near centroids whose samples hardly overlap; the group with more samples keeps its label.

    ``features`` has (feature_id, sample_id, group) and the descriptors. Each round joins neighbours in m/z order and
    merges disjoint pairs; it ends when a round merges none. Noise (-1) takes no part. Returns (feature_id, group).
    """
    tolerance = tolerance or {"mz": 0.01, "rt": 5.0}
    cols = list(tolerance)
    tables = Written(features.sparkSession, "merging")
    now = tables.put(features.select("feature_id", "sample_id", "group", *cols))
    while True:  # each round has fewer groups than the one before
        cents = now.where("`group` >= 0").groupBy("group").agg(*[F.avg(c).alias(c) for c in cols], F.collect_set("sample_id").alias("samples"))
        w = W.orderBy(*reversed(cols))
        nxt = cents.select("group", "samples", *cols, *[F.lead(c).over(w).alias(f"n_{c}") for c in ("group", "samples", *cols)]).where("n_group is not null")
        near = F.lit(True)
        for c, t in tolerance.items():
            near = near & (F.abs(F.col(c) - F.col(f"n_{c}")) <= t)
        overlap = F.size(F.array_intersect("samples", "n_samples")) / F.size(F.array_union("samples", "n_samples"))
        pairs = nxt.where(near & (overlap <= max_overlap)).select("group", "n_group", F.size("samples").alias("a"), F.size("n_samples").alias("b")).orderBy("group").collect()
        used, new = set(), {}
        for g, h, a, b in pairs:
            if g not in used and h not in used:
                keep, gone = (g, h) if a >= b else (h, g)
                new[gone] = keep
                used |= {g, h}
        if not new:
            break
        table = features.sparkSession.createDataFrame(list(new.items()), "group int, to int")
        now = tables.put(now.join(table, "group", "left").withColumn("group", F.coalesce("to", "group")).drop("to"))
        tables.only(now)
    return now.select("feature_id", "group")
