"""Numpy kernels for one-dimensional signals: peaks, smoothing, noise, baseline, centroids.

They run inside grouped pandas functions, one trace at a time, on the executors.
"""

from __future__ import annotations

import math

import numpy as np

from ionlake.functions.columns import MAD_SCALE


def smooth(x: np.ndarray, strength: float) -> np.ndarray:
    """Gaussian filter cut at four deviations, with the signal mirrored at its ends."""
    if strength <= 0 or len(x) == 0:
        return np.asarray(x, float).copy()
    r = int(4 * strength + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / strength) ** 2)
    return np.convolve(np.pad(np.asarray(x, float), r, mode="symmetric"), kernel / kernel.sum(), mode="valid")


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places of maxima that rise and fall; a flat top counts at its middle."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    last = np.r_[first[1:] - 1, len(x) - 1]
    v = x[first]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return (first[top] + last[top]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest points on the way to higher ground, or the end, on each side."""
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        above = np.flatnonzero(x > x[p])
        lo, hi = above[above < p], above[above > p]
        a, b = (lo[-1] + 1 if len(lo) else 0), (hi[0] if len(hi) else len(x))
        out[k] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    return out


def find_peaks(x: np.ndarray, prominence: np.ndarray | float = 0.0, distance: int = 1) -> np.ndarray:
    """Maxima at least ``distance`` apart, the tallest kept, that stand out by ``prominence`` (given for each place)."""
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            close = np.abs(peaks - peaks[k]) < distance
            close[k] = False
            keep[close] = False
    peaks = peaks[keep]
    need = np.broadcast_to(np.asarray(prominence, float), x.shape)[peaks]
    return peaks[prominences(x, peaks) >= need]


def _noise_level(x: np.ndarray, robust: bool) -> float:
    d = np.diff(x, 2)
    d = d[np.argsort(np.abs(d), kind="stable")]
    for percent in range(90, 10, -10):
        part = d[: len(d) * percent // 100]
        if len(part) <= 2:
            return 0.0
        mid = np.median(part)
        sd = MAD_SCALE * np.median(np.abs(part - mid)) if robust else part.std()
        if sd == 0:
            return 0.0
        if abs(mid / sd) <= 1:
            return float(sd / 2)
    return 0.0


def estimate_noise(x: np.ndarray, min_chunk_size: int = 200, n_chunks: int = 5, robust: bool = True) -> np.ndarray:
    """Noise of each point, constant within chunks, from the small second differences."""
    x = np.asarray(x, float)
    size = max(len(x) // n_chunks, min_chunk_size)
    starts = list(range(0, max(len(x), 1), size))
    if len(starts) > 1 and len(x) - starts[-1] < size:
        starts.pop()  # a short rest joins the chunk before it
    out = np.zeros(len(x))
    for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
        out[a:b] = _noise_level(x[a:b], robust)
    return out


def extrema(x: np.ndarray) -> np.ndarray:
    """Both ends with all minima and maxima in order; nothing if there is no maximum."""
    tops = local_maxima(x)
    if not len(tops):
        return np.zeros(0, int)
    return np.unique(np.r_[0, local_maxima(-np.asarray(x, float)), tops, len(x) - 1])


def estimate_baseline(x: np.ndarray, noise: np.ndarray, min_proba: float = 0.05) -> np.ndarray:
    """Linear interpolation through intervals between extrema that noise alone may explain."""
    x = np.asarray(x, float)
    ext = extrema(x)
    if len(ext) < 2:
        return x.copy()
    signal = np.zeros(len(ext) - 1, bool)
    for k, (a, b) in enumerate(zip(ext[:-1], ext[1:], strict=True)):
        part = x[a : b + 1]
        total, sd = (part - part.min()).sum(), math.sqrt(float((noise[a : b + 1] ** 2).sum()))
        proba = math.erfc(total / (sd * math.sqrt(2))) if sd > 0 else float(total == 0)
        signal[k] = proba < min_proba
    signal = signal | np.roll(signal, 1) | np.roll(signal, -1)
    at = {0, len(x) - 1}
    for k in np.flatnonzero(~signal):
        at |= set(range(ext[k], ext[k + 1] + 1))
    at = np.array(sorted(at))
    return np.minimum(np.interp(np.arange(len(x)), at, x[at]), x)


def detect_peaks(x: np.ndarray, noise: np.ndarray, baseline: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, apex and end (exclusive) of peaks; start < apex < end and neighbours do not overlap."""
    x = np.asarray(x, float)
    n = len(x)
    flat = np.flatnonzero(x - baseline < noise)
    if not len(flat):
        flat = np.array([0, n - 1])
    apex = np.setdiff1d(find_peaks(x, prominence=3 * np.asarray(noise), distance=3), flat)
    if not len(apex):
        return (np.zeros(0, int),) * 3
    k = np.searchsorted(flat, apex)
    start = np.where(k > 0, flat[np.maximum(k - 1, 0)], 0)
    end = np.where(k < len(flat), flat[np.minimum(k, len(flat) - 1)] + 1, n)
    dips = local_maxima(-x)
    for i in range(len(apex) - 1):
        if end[i] > start[i + 1]:
            between = dips[(dips > apex[i]) & (dips < apex[i + 1])]
            cut = between[np.argmin(x[between])] if len(between) else apex[i] + int(np.argmin(x[apex[i] : apex[i + 1] + 1]))
            end[i], start[i + 1] = min(end[i], cut + 1), cut
    tops = local_maxima(x)
    good = np.zeros(len(apex), bool)
    for i in range(len(apex)):
        inside = tops[(tops > start[i]) & (tops < end[i])]
        if len(inside):
            apex[i] = inside[np.argmax(x[inside])]
            good[i] = start[i] < apex[i] < end[i]
    return start[good], apex[good], end[good]


def find_centroids(mz: np.ndarray, spint: np.ndarray, min_snr: float = 10.0, min_distance: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Centroid m/z and area of the peaks of a profile spectrum; centroids closer than ``min_distance`` are merged."""
    mz, spint = np.asarray(mz, float), np.asarray(spint, float)
    noise = estimate_noise(spint)
    baseline = estimate_baseline(spint, noise)
    start, apex, end = detect_peaks(spint, noise, baseline)
    height = spint[apex] - baseline[apex]
    strong = height >= min_snr * noise[apex]
    start, end = start[strong], end[strong]
    net = np.maximum(spint - baseline, 0)
    total, weighted = np.r_[0, np.cumsum(net)], np.r_[0, np.cumsum(net * mz)]
    area = total[end] - total[start]
    centre = (weighted[end] - weighted[start]) / np.where(area > 0, area, 1)
    centre, area = centre[area > 0], area[area > 0]
    if not len(centre):
        return centre, area
    group = np.cumsum(np.r_[True, np.diff(centre) >= min_distance]) - 1
    sums = np.bincount(group, area)
    return np.bincount(group, area * centre) / sums, sums
