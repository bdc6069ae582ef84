"""Isotopologue annotation: from the tallest feature down, find and validate the envelope that it belongs to.

Greedy and sequential inside a sample, so each sample is one group of a grouped pandas function.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ionlake.functions import peaks
from ionlake.functions.chem import CHNOPS, TABLE, EnvelopeValidator, Formula, FormulaGenerator, Tolerance
from ionlake.operators.sample import SampleData
from ionlake.plans.pipeline import Operator
from ionlake.plans.status import SampleStatus

DEFAULT_BOUNDS = CHNOPS[500]


def step_ranges(elements: list[str], min_p: float, length: int) -> dict[int, tuple[float, float]]:
    """Least and greatest exact mass of each nominal step, from isotopes of at least ``min_p`` in abundance."""
    single: dict[int, list[float]] = {}
    for e in elements:
        mono = TABLE.monoisotope(e)
        for i in TABLE.element(e):
            if i.a > mono.a and i.p >= min_p:
                single.setdefault(i.a - mono.a, []).append(i.m - mono.m)
    out: dict[int, tuple[float, float]] = {}
    for dm in range(1, length + 1):
        lo, hi = [], []
        if dm in single:
            lo.append(min(single[dm]))
            hi.append(max(single[dm]))
        for a in range(1, dm):
            if a in single and dm - a in out:
                lo.append(min(single[a]) + out[dm - a][0])
                hi.append(max(single[a]) + out[dm - a][1])
        if lo:
            out[dm] = min(lo), max(hi)
    return out


class EnvelopeFinder:
    """Candidate envelopes that begin with a feature, by depth-first search over m/z windows."""

    def __init__(self, elements: list[str], min_p: float = 0.005, length: int = 10, tolerance: float = 0.01, min_similarity: float = 0.9):
        self.steps, self.length, self.tol, self.least = step_ranges(elements, min_p, length), length, tolerance, min_similarity

    def window(self, mz: list[float], charge: int) -> tuple[float, float] | None:
        """Where the next member may be, from all members so far."""
        n, lo, hi = len(mz), [], []
        for dm, (a, b) in self.steps.items():
            i = n - dm
            if 0 <= i < n:
                lo.append(mz[i] + a / charge)
                hi.append(mz[i] + b / charge)
        return (min(lo) - self.tol, max(hi) + self.tol) if lo else None

    def find(self, first: int, mz: np.ndarray, free: np.ndarray, charge: int, similarity) -> list[list[int]]:
        """Longest candidates as places in the m/z-sorted features; those inside another are left out."""
        done, stack = [], [[first]]
        while stack:
            path = stack.pop()
            w = self.window([float(mz[i]) for i in path], charge) if len(path) < self.length else None
            more = []
            if w:
                for j in range(int(np.searchsorted(mz, w[0], side="right")), int(np.searchsorted(mz, w[1], side="right"))):
                    if free[j] and j not in path and similarity(first, j) >= self.least:
                        more.append([*path, j])
            if more:
                stack += more
            else:
                done.append(path)
        return [p for p in done if not any(set(p) < set(q) for q in done)]


class MMIFinder:
    """Features that may be the lightest isotopologue (MMI) of an envelope in which a given feature is the tallest.

    Rules hold, for each 100 Da bin and step mi, the ranges of mass difference and abundance ratio over formulas whose
    step mi is about as tall as the first or taller.
    """

    def __init__(self, bounds: dict[str, tuple[int, int]], max_mass: float = 2500.0, length: int = 5, p_tolerance: float = 0.05, bin_size: int = 100):
        self.bin, self.rules, self.p_tol = bin_size, {}, p_tolerance
        # A coarse walk over each element's range is enough for the ranges, which are convex in the counts.
        grids = [sorted({lo, hi, *np.linspace(lo, hi, 5).astype(int).tolist()}) for lo, hi in bounds.values()]
        for counts in itertools.product(*grids):
            f = {e: n for e, n in zip(bounds, counts, strict=True) if n}
            if not f:
                continue
            formula = Formula(f)
            mass = formula.exact_mass()
            if mass > max_mass:
                continue
            m, p = formula.isotopic_envelope(length, 0.0)
            for mi in range(1, len(p)):
                if p[mi] / p[0] >= 1 - p_tolerance:
                    key = (int(mass // bin_size), mi)
                    dm, q = m[mi] - m[0], p[mi] / p[0]
                    a = self.rules.get(key)
                    self.rules[key] = (dm, dm, q, q) if a is None else (min(a[0], dm), max(a[1], dm), min(a[2], q), max(a[3], q))

    def find(self, k: int, mz: np.ndarray, area: np.ndarray, free: np.ndarray, charge: int, tolerance: float) -> list[int]:
        out = []
        mass = float(mz[k]) * charge
        for b in {int(mass // self.bin), int((mass - 10) // self.bin)}:
            for mi in range(1, 10):
                rule = self.rules.get((b, mi))
                if rule is None:
                    continue
                lo, hi = (mass - rule[1]) / charge - tolerance, (mass - rule[0]) / charge + tolerance
                for j in range(int(np.searchsorted(mz, lo)), int(np.searchsorted(mz, hi, side="right"))):
                    ratio = area[k] / area[j] if area[j] > 0 else np.inf
                    if free[j] and rule[2] - self.p_tol <= ratio <= rule[3] + self.p_tol:
                        out.append(j)
        return out


def annotate_sample(features: list[dict], finder: EnvelopeFinder, mmi: MMIFinder, validator: EnvelopeValidator, max_charge: int, max_mass: float, tolerance: float, polarity: int = 1) -> list[tuple[int, int, int]]:
    """(label, index, charge) of each feature, -1 where it belongs to no envelope."""
    order = sorted(range(len(features)), key=lambda i: features[i]["mz"])
    f = [features[i] for i in order]
    mz, area = np.array([x["mz"] for x in f]), np.array([x["area"] for x in f])
    free, out, label = np.ones(len(f), bool), [(-1, -1, -1)] * len(f), 0
    memo: dict[tuple[int, int], float] = {}

    def similarity(i: int, j: int) -> float:
        key = (min(i, j), max(i, j))
        if key not in memo:
            memo[key] = peaks.compare(f[i], f[j])
        return memo[key]

    for top in sorted(range(len(f)), key=lambda i: -f[i]["height"]):
        if not free[top]:
            continue
        best: tuple[list[int], int] = ([top], 0)
        for q in range(1, max_charge + 1):
            starts = ([top] if mz[top] * q < max_mass else []) + mmi.find(top, mz, area, free, q, tolerance)
            for first in starts:
                for path in finder.find(first, mz, free, q, similarity):
                    if top not in path or len(path) <= len(best[0]):
                        continue
                    m, p = peaks.isotopic_envelope([f[i] | {"mz": f[i]["trace_mz"]} for i in path])
                    if not np.isfinite(p).all():
                        continue
                    n = validator.validate([x * q for x in m], p, q * polarity)
                    if n > len(best[0]) and top in path[:n]:
                        best = path[:n], q
        free[top] = False
        if best[1]:
            for k, i in enumerate(best[0]):
                out[i], free[i] = (label, k, best[1]), False
            label += 1
    back = [(-1, -1, -1)] * len(f)
    for place, i in enumerate(order):
        back[i] = out[place]
    return back


@dataclass(frozen=True)
class IsotopologueAnnotator(Operator):
    """Adds isotopologue_label, isotopologue_index and charge to the features of each sample."""

    tier: ClassVar[str] = "sample"
    needs: ClassVar[SampleStatus] = SampleStatus(feature_extracted=True)
    makes: ClassVar[SampleStatus] = SampleStatus(isotopologue_annotated=True)
    max_charge: int = 3
    min_similarity: float = 0.9
    min_p: float = 0.005
    max_length: int = 10
    p_tol: float = 0.05
    min_mass_tol: float = 0.005
    max_mass_tol: float = 0.01
    max_mass: float = 2000.0
    polarity: int = 1
    bounds: dict = field(default_factory=lambda: dict(DEFAULT_BOUNDS))

    def run(self, data: SampleData) -> SampleData:
        return SampleData(data.spectra, data.rois, self.annotate(data.features), data.status)

    def annotate(self, features: DataFrame) -> DataFrame:
        op = self
        base = features.drop("isotopologue_label", "isotopologue_index", "charge")
        schema = base.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", isotopologue_label int, isotopologue_index int, charge int"

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            gen = FormulaGenerator(op.bounds, max_mass=float(pdf["mz"].max() * op.max_charge + 1))
            finder = EnvelopeFinder(list(op.bounds), op.min_p, op.max_length, op.max_mass_tol, op.min_similarity)
            mmi = MMIFinder({e: b for e, b in op.bounds.items() if e in "CHNOS"}, op.max_mass, p_tolerance=op.p_tol)
            check = EnvelopeValidator(gen, Tolerance(op.min_mass_tol, op.max_mass_tol, op.p_tol), op.max_length)
            made = annotate_sample(pdf.to_dict("records"), finder, mmi, check, op.max_charge, op.max_mass, op.max_mass_tol, op.polarity)
            return pdf.assign(isotopologue_label=[m[0] for m in made], isotopologue_index=[m[1] for m in made], charge=[m[2] for m in made])

        return base.groupBy("sample_id").applyInPandas(run, schema)
