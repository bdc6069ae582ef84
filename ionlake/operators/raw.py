"""Raw data: chromatograms and spectra as joins and aggregates, and regions of interest as a fold over scans.

``points`` are exploded spectra (sample_id, scan, time, mz, intensity); ``spectra`` keep arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.functions.columns import NAN
from ionlake.operators.joins import range_join

ROI_SCHEMA = "sample_id string, roi_id string, mz array<double>, spint array<double>, time array<double>, scan array<int>, noise array<double>, baseline array<double>"


def select_scans(spectra: DataFrame, ms_level: int | None = None, start_time: float | None = None, end_time: float | None = None) -> DataFrame:
    """Scans of a level within [start, end); plain predicates, which reach a columnar scan."""
    if ms_level is not None:
        spectra = spectra.where(F.col("ms_level") == ms_level)
    if start_time is not None:
        spectra = spectra.where(F.col("time") >= start_time)
    return spectra if end_time is None else spectra.where(F.col("time") < end_time)


def explode_points(spectra: DataFrame) -> DataFrame:
    """One row for each point."""
    zipped = F.explode(F.arrays_zip("mz", "intensity")).alias("p")
    return spectra.select("sample_id", "scan", "time", zipped).select("sample_id", "scan", "time", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def tic(spectra: DataFrame, kind: str = "tic") -> DataFrame:
    """Total (``tic``) or greatest (``bpi``) intensity of each scan; an empty scan has 0. No shuffle: arrays are folded."""
    made = {"tic": F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x), "bpi": F.coalesce(F.array_max("intensity"), F.lit(0.0))}
    return spectra.select("sample_id", "scan", "time", made[kind].alias("intensity"))


def tic_points(points: DataFrame, scans: DataFrame, kind: str = "tic") -> DataFrame:
    """The same from exploded points; scans without points have 0."""
    agg = {"tic": F.sum("intensity"), "bpi": F.max("intensity")}[kind]
    made = points.groupBy("sample_id", "scan").agg(agg.alias("i"))
    return scans.select("sample_id", "scan", "time").join(made, ["sample_id", "scan"], "left").select("sample_id", "scan", "time", F.coalesce("i", F.lit(0.0)).alias("intensity"))


def chromatograms(points: DataFrame, scans: DataFrame, targets: Sequence[float], window: float = 0.05, agg: str = "sum", fill_missing: bool = True) -> DataFrame:
    """Extracted ion chromatograms: for each target and scan the sum or mean of points within [t - w, t + w).

    A bin join on m/z, one aggregation, and the full grid of scans and the (few) targets. Where a scan has no such point
    there is 0, or NaN without ``fill_missing``.
    """
    spark = points.sparkSession
    t = spark.createDataFrame([(i, float(x)) for i, x in enumerate(targets)], "target int, target_mz double")
    w = t.select("target", (F.col("target_mz") - window).alias("lo"), (F.col("target_mz") + window).alias("hi"))
    hit = range_join(points, w, "mz", "lo", "hi", 2 * window)
    made = hit.groupBy("sample_id", "scan", "target").agg((F.sum if agg == "sum" else F.avg)("intensity").alias("i"))
    grid = scans.select("sample_id", "scan", "time").crossJoin(F.broadcast(t))
    out = grid.join(made, ["sample_id", "scan", "target"], "left")
    return out.select("sample_id", "target", "target_mz", "scan", "time", F.coalesce("i", F.lit(0.0 if fill_missing else NAN)).alias("intensity"))


def accumulate_grid(points: DataFrame, start: float, end: float, subtract_start: float, subtract_end: float, digits: int = 5) -> DataFrame:
    """Signed sum on a rounded m/z grid: inside [start, end) added, the rest of the wider window subtracted, positives kept."""
    sign = F.when((F.col("time") >= start) & (F.col("time") < end), F.col("intensity")).otherwise(-F.col("intensity"))
    wide = points.where((F.col("time") >= subtract_start) & (F.col("time") < subtract_end))
    out = wide.groupBy("sample_id", F.round("mz", digits).alias("mz")).agg(F.sum(sign).alias("intensity"))
    return out.where("intensity > 0")


def accumulate_profile(spectra: DataFrame, start: float, end: float, subtract_start: float, subtract_end: float) -> DataFrame:
    """The same for profile spectra, each interpolated (0 outside its range) to the union of the grids of its sample."""
    wide = spectra.where((F.col("time") >= subtract_start) & (F.col("time") < subtract_end)).select("sample_id", "time", "mz", "intensity")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.unique(np.concatenate(pdf["mz"].to_list()))
        total = np.zeros(len(grid))
        for t, m, i in zip(pdf["time"], pdf["mz"], pdf["intensity"], strict=True):
            total += (1 if start <= t < end else -1) * np.interp(grid, m, i, left=0, right=0)
        return pd.DataFrame({"sample_id": pdf["sample_id"].iloc[0], "mz": [grid[total > 0]], "intensity": [total[total > 0]]})

    return wide.groupBy("sample_id").applyInPandas(run, "sample_id string, mz array<double>, intensity array<double>")


def accumulate_centroid(spectra: DataFrame, start: float, end: float, subtract_start: float, subtract_end: float, tolerance: float = 0.01) -> DataFrame:
    """The same for centroid spectra, points gathered to regions of interest first; m/z is a region's mean."""
    wide = spectra.where((F.col("time") >= subtract_start) & (F.col("time") < subtract_end))
    p = F.explode(F.arrays_zip("mz", "spint", "time")).alias("p")
    points = extract_rois(wide, tolerance=tolerance, max_missing=10**6, min_length=1, pad_missing=False).select("sample_id", "roi_id", p)
    sign = F.when((F.col("p.time") >= start) & (F.col("p.time") < end), F.col("p.spint")).otherwise(-F.col("p.spint"))
    out = points.groupBy("sample_id", "roi_id").agg(F.avg("p.mz").alias("mz"), F.sum(sign).alias("intensity"))
    return out.where("intensity > 0").select("sample_id", "mz", "intensity")


def centroid_spectra(spectra: DataFrame, fn: Callable | None = None, **options) -> DataFrame:
    """Profile spectra as centroids; ``fn(mz, intensity)`` may replace the built-in conversion."""
    from ionlake.functions.signal import find_centroids

    def run(batches):
        for pdf in batches:
            made = [(fn or find_centroids)(m, i, **options) for m, i in zip(pdf["mz"], pdf["intensity"], strict=True)]
            pdf["mz"], pdf["intensity"] = [list(m) for m, _ in made], [list(i) for _, i in made]
            pdf["centroid"] = True
            yield pdf

    return spectra.mapInPandas(run, spectra.schema)


def seed_mz(mz: np.ndarray, tolerance: float) -> np.ndarray:
    """Means of runs of sorted m/z whose variance stays within the squared tolerance."""
    mz = np.unique(np.round(mz, 5))
    out, n, s, q = [], 0, 0.0, 0.0
    for x in mz:
        n1, s1, q1 = n + 1, s + x, q + x * x
        if n and q1 / n1 - (s1 / n1) ** 2 > tolerance**2:
            out.append(s / n)
            n1, s1, q1 = 1, x, x * x
        n, s, q = n1, s1, q1
    return np.array([*out, s / n] if n else out)


class RoiFold:
    """Regions of interest of one sample, built scan by scan.

    Points go to the slot with the nearest mean m/z within the tolerance. Slots that missed more than ``max_missing``
    scans are emitted if long and intense enough, and emptied; their mean goes on attracting points.
    """

    def __init__(self, tolerance: float, max_missing: int, min_length: int, min_intensity: float, multiple_match: str, targeted: np.ndarray | None, seeds: np.ndarray | None):
        self.tol, self.max_missing, self.min_length, self.min_int, self.multi = tolerance, max_missing, min_length, min_intensity, multiple_match
        self.fixed, self.seeds = targeted is not None, seeds
        self.mean = np.sort(np.asarray(targeted, float)) if self.fixed else np.zeros(0)
        n = len(self.mean)
        self.points: list[list] = [[] for _ in range(n)]
        self.missing, self.total = np.zeros(n, int), np.zeros(n)
        self.done: list[list] = []

    def feed(self, scan: int, mz: np.ndarray, spint: np.ndarray) -> None:
        if self.seeds is not None:
            near = np.abs(self._nearest(self.seeds, mz)[1]) <= self.tol if len(self.seeds) else np.zeros(len(mz), bool)
            mz, spint = mz[near], spint[near]
        free = np.ones(len(mz), bool)
        self.missing += 1
        if len(self.mean) and len(mz):
            slot, off = self._nearest(self.mean, mz)
            ok = np.abs(off) <= self.tol
            for s in np.unique(slot[ok]):
                mine = np.flatnonzero(ok & (slot == s))
                if self.multi == "reduce" or len(mine) == 1:
                    free[mine] = False
                    m, i = mz[mine].mean(), spint[mine].sum()
                else:  # the closest is kept, the others may begin regions of their own
                    best = mine[np.argmin(np.abs(off[mine]))]
                    free[best] = False
                    m, i = mz[best], spint[best]
                self._extend(s, scan, m, i)
        if not self.fixed and free.any():
            self._insert(scan, mz[free], spint[free])
        for s in np.flatnonzero(self.missing > self.max_missing):
            self._finish(s)

    @staticmethod
    def _nearest(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest value, the right one of two equally near, and the difference."""
        k = np.clip(np.searchsorted(sorted_values, x), 1, max(1, len(sorted_values) - 1))
        if len(sorted_values) == 1:
            k = np.zeros(len(x), int)
        else:
            k = np.where(x - sorted_values[k - 1] < sorted_values[k] - x, k - 1, k)
        return k, x - sorted_values[k]

    def _extend(self, s: int, scan: int, m: float, i: float) -> None:
        self.points[s].append((scan, m, i))
        self.total[s] += m
        self.missing[s] = 0
        if not self.fixed:
            self.mean[s] = self.total[s] / len(self.points[s])

    def _insert(self, scan: int, mz: np.ndarray, spint: np.ndarray) -> None:
        at = np.searchsorted(self.mean, mz)
        self.mean = np.insert(self.mean, at, mz)
        self.missing = np.insert(self.missing, at, 0)
        self.total = np.insert(self.total, at, mz)
        for k, (a, m, i) in enumerate(zip(at, mz, spint, strict=True)):
            self.points.insert(int(a) + k, [(scan, m, i)])
        if len(self.mean) > 1 and (np.diff(self.mean) < 0).any():  # running means may have passed each other
            order = np.argsort(self.mean, kind="stable")
            self.mean, self.missing, self.total = self.mean[order], self.missing[order], self.total[order]
            self.points = [self.points[i] for i in order]

    def _finish(self, s: int) -> None:
        p = self.points[s]
        if len(p) >= self.min_length and max(x[2] for x in p) >= self.min_int:
            self.done.append(p)
        self.points[s], self.total[s], self.missing[s] = [], 0.0, 0

    def finish(self) -> list[list]:
        for s in range(len(self.points)):
            if self.points[s]:
                self._finish(s)
        return self.done


def trace(points: list, scans: np.ndarray, times: np.ndarray, pad: int = 0, fill: bool = True) -> dict:
    """Arrays of a region over all its scans: missing ones get the mean m/z and interpolated intensity.

    ``pad`` adds scans on each side by the slope of the edge, not below 0.
    """
    scan, mz, spint = (np.array(c, float) for c in zip(*sorted(points), strict=True))
    if not fill:
        return {"scan": scan.astype(int), "time": times[np.searchsorted(scans, scan)], "mz": mz, "spint": spint}
    a, b = np.searchsorted(scans, scan[0]), np.searchsorted(scans, scan[-1])
    lo, hi = max(0, a - pad), min(len(scans) - 1, b + pad)
    full = scans[lo : hi + 1]
    y = np.interp(full, scan, spint)
    if pad and len(scan) > 1:
        left, right = full < scan[0], full > scan[-1]
        y[left] = np.maximum(spint[0] + (spint[1] - spint[0]) / (scan[1] - scan[0]) * (full[left] - scan[0]), 0)
        y[right] = np.maximum(spint[-1] + (spint[-1] - spint[-2]) / (scan[-1] - scan[-2]) * (full[right] - scan[-1]), 0)
    m = np.full(len(full), mz.mean())
    m[np.searchsorted(full, scan)] = mz
    return {"scan": full.astype(int), "time": times[lo : hi + 1], "mz": m, "spint": y}


def extract_rois(spectra: DataFrame, tolerance: float = 0.01, max_missing: int = 1, min_length: int = 5, min_intensity: float = 0.0, multiple_match: str = "reduce", targeted_mz: Sequence[float] | None = None, pad: int = 0, pad_missing: bool = True) -> DataFrame:
    """Regions of interest of each sample. Samples are independent; one sample's scans are folded in order in one task."""
    if multiple_match not in ("reduce", "closest"):
        raise ValueError(f"unknown multiple match {multiple_match!r}")
    targets = None if targeted_mz is None else np.asarray(targeted_mz, float)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scan")
        arrays = [(int(s), np.asarray(m, float), np.asarray(i, float)) for s, m, i in zip(pdf["scan"], pdf["mz"], pdf["intensity"], strict=True)]
        seeds = None
        if min_intensity > 0 and targets is None:
            strong = [m[i >= min_intensity] for _, m, i in arrays]
            seeds = seed_mz(np.concatenate(strong) if strong else np.zeros(0), tolerance)
        fold = RoiFold(tolerance, max_missing, min_length, min_intensity, multiple_match, targets, seeds)
        for a in arrays:
            fold.feed(*a)
        scans, times = pdf["scan"].to_numpy(float), pdf["time"].to_numpy(float)
        rows = [{"sample_id": str(key[0]), "roi_id": f"{key[0]}-{k}", "noise": None, "baseline": None} | {n: list(v) for n, v in trace(p, scans, times, pad, pad_missing).items()} for k, p in enumerate(fold.finish())]
        return pd.DataFrame(rows, columns=["sample_id", "roi_id", "mz", "spint", "time", "scan", "noise", "baseline"])

    keep = spectra.select("sample_id", "scan", F.col("time").cast("double").alias("time"), "mz", "intensity")
    return keep.groupBy("sample_id").applyInPandas(run, ROI_SCHEMA)
