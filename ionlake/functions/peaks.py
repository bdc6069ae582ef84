"""Peak descriptors as array expressions in the JVM, and comparisons of peaks as numpy kernels.

A peak is ``start < apex < end`` (end exclusive, from 0) in the parallel arrays of a trace: ``time``, ``spint``, ``mz``,
``noise``, ``baseline`` and ``scan``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionlake.functions.columns import NAN, array_sum, array_trapezoid, divide, null_to_nan

DESCRIPTORS = ("rt_start", "rt_end", "rt", "mz", "mz_std", "height", "area", "width", "extension", "snr")


def part(c: str) -> Column:
    """The peak's slice of an array column."""
    return F.slice(F.col(c), F.col("start") + 1, F.col("end") - F.col("start"))


def slice_height() -> Column:
    """Intensity over the baseline, not below 0."""
    return F.zip_with(part("spint"), part("baseline"), lambda a, b: F.greatest(a - b, F.lit(0.0)))


def _weighted(x: Column, w: Column) -> Column:
    return null_to_nan(divide(array_sum(F.zip_with(x, w, lambda a, b: a * b)), array_sum(w)))


def width(time: Column, height: Column) -> Column:
    """Time between 2.5 % and 97.5 % of the cumulative area; NaN without area."""
    steps = F.transform(F.sequence(F.lit(1), F.size(time) - 1), lambda i: (F.get(time, i) - F.get(time, i - 1)) * (F.get(height, i) + F.get(height, i - 1)) / 2)
    run = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    total = F.element_at(run, -1)

    def at(share: float) -> Column:
        first = F.array_position(F.transform(run, lambda v: v >= share * total), F.lit(True)).cast("int")
        return F.get(time, first - 1)

    return F.when((F.size(time) > 1) & (total > 0), at(0.975) - at(0.025)).otherwise(F.lit(NAN))


def with_descriptors(peaks: DataFrame) -> DataFrame:
    """Add every descriptor to rows with a trace and a peak; one projection, no Python."""
    t, h = F.col("__t"), F.col("__h")
    df = peaks.withColumn("__t", part("time")).withColumn("__h", slice_height()).withColumn("__m", part("mz"))
    mean = F.aggregate("__m", F.lit(0.0), lambda s, x: s + x) / F.size("__m")
    var = F.aggregate(F.transform("__m", lambda x: (x - F.col("__mean")) * (x - F.col("__mean"))), F.lit(0.0), lambda s, x: s + x) / F.size("__m")
    apex_noise = F.get("noise", F.col("apex"))
    height = F.get("spint", F.col("apex")) - F.get("baseline", F.col("apex"))
    df = df.withColumn("__mean", mean).withColumns({
        "rt_start": F.get("time", F.col("start")), "rt_end": F.get("time", F.col("end") - 1), "rt": _weighted(t, h),
        "__mz": F.greatest(_weighted(F.col("__m"), h), F.lit(0.0)), "mz_std": F.sqrt(var), "height": height, "area": array_trapezoid(t, h), "width": width(t, h),
        "extension": F.get("time", F.col("end") - 1) - F.get("time", F.col("start")), "snr": F.when(apex_noise > 1e-12, height / apex_noise).otherwise(F.lit(NAN)),
    })
    return df.withColumn("peak_mz", F.col("__mz")).drop("__t", "__h", "__m", "__mean", "__mz")


# -- numpy kernels for pairs of peaks; a peak is a dict of arrays with start and end ------------------------------


def heights(p: dict, a: int | None = None, b: int | None = None) -> np.ndarray:
    a, b = p["start"] if a is None else a, p["end"] if b is None else b
    return np.maximum(np.asarray(p["spint"][a:b], float) - np.asarray(p["baseline"][a:b], float), 0)


def compare(p: dict, q: dict, least_overlap: float = 0.5) -> float:
    """Cosine of two peaks over their common scans, each over its full norm; 0 unless over half of the shorter is common."""
    sp, sq = (np.asarray(x["scan"])[x["start"] : x["end"]] for x in (p, q))
    common, i, j = np.intersect1d(sp, sq, return_indices=True)
    if not len(common) or len(common) / min(len(sp), len(sq)) <= least_overlap:
        return 0.0
    hp, hq = heights(p), heights(q)
    norm = np.linalg.norm(hp) * np.linalg.norm(hq)
    return float(hp[i] @ hq[j] / norm) if norm > 0 else 0.0


def isotopic_envelope(peaks: list[dict]) -> tuple[list[float], list[float]]:
    """m/z and normalised areas of co-eluting peaks over the scans that all of them have."""
    first = max(p["scan"][p["start"]] for p in peaks)
    last = min(p["scan"][p["end"] - 1] for p in peaks)
    mz, areas = [], []
    for p in peaks:
        scan = np.asarray(p["scan"])
        a, b = max(p["start"], int(np.searchsorted(scan, first))), min(p["end"], int(np.searchsorted(scan, last, side="right")))
        h = heights(p, a, b)
        w = heights(p)
        m = np.asarray(p["mz"][p["start"] : p["end"]], float)
        mz.append(float((m * w).sum() / w.sum()) if w.sum() > 0 else float("nan"))
        areas.append(float(np.trapezoid(h, np.asarray(p["time"][a:b], float))) if b - a > 1 else 0.0)
    total = sum(areas)
    return mz, [x / total if total > 0 else float("nan") for x in areas]
