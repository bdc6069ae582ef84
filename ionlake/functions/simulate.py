"""Simulated data: species, noise and instrument response, spectra of samples, and data matrices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionlake.functions.chem import Formula


@dataclass(frozen=True)
class AbundanceSpec:
    """Normal, not below 0, and present with probability ``prevalence``."""

    mean: float = 100.0
    std: float = 0.0
    prevalence: float = 1.0

    def expr(self, seed: int) -> Column:
        value = F.greatest(F.lit(self.mean) + self.std * F.randn(seed), F.lit(0.0)) if self.std else F.lit(float(self.mean))
        return F.when(F.rand(seed + 1) < self.prevalence, value).otherwise(F.lit(0.0)) if self.prevalence < 1 else value


@dataclass(frozen=True)
class NoiseSpec:
    """Deviation of a measurement: signal over the greater of ``min_snr`` and ``base_snr`` times relative abundance."""

    base_snr: float | None = None
    min_snr: float = 10.0

    def expr(self, signal: Column, p: float, seed: int) -> Column:
        return F.lit(0.0) if self.base_snr is None else signal / max(self.min_snr, self.base_snr * p) * F.randn(seed)


@dataclass(frozen=True)
class ResponseSpec:
    """Sensitivity: base * (1 - L + L * exp(-order * decay)) * the batch's factor."""

    base: float = 1.0
    loss: float = 0.0
    decay: float = 0.0
    batch_factors: tuple[float, ...] = (1.0,)

    def expr(self, order: Column, batch: Column) -> Column:
        factors = F.array(*[F.lit(float(x)) for x in self.batch_factors])
        return self.base * (1 - self.loss + self.loss * F.exp(-order * self.decay)) * F.get(factors, batch % len(self.batch_factors))


@dataclass(frozen=True)
class Species:
    """An ion with its time of elution, abundance by sample group, and envelope."""

    formula: str
    rt: float = 10.0
    width: float = 3.0
    n_isotopologues: int = 2
    abundance: AbundanceSpec = field(default_factory=AbundanceSpec)
    by_group: dict[str, AbundanceSpec] = field(default_factory=dict)
    noise: NoiseSpec = field(default_factory=NoiseSpec)
    response: ResponseSpec = field(default_factory=ResponseSpec)

    def peaks(self) -> tuple[list[float], list[float]]:
        """m/z and abundances of the isotopologues."""
        f = Formula(self.formula)
        m, p = f.isotopic_envelope(self.n_isotopologues)
        q = abs(f.charge) or 1
        return [float(x) / q for x in m], [float(x) for x in p / p.sum()]


def create_samples(spark: SparkSession, template: Sequence[tuple[str, str]], n_batches: int = 1) -> DataFrame:
    """Samples from a template of (type, group), repeated for each batch in run order."""
    rows = [(f"sample-{b * len(template) + k}", t, g, b * len(template) + k, b) for b in range(n_batches) for k, (t, g) in enumerate(template)]
    return spark.createDataFrame(rows, "sample_id string, type string, `group` string, `order` int, batch int")


def data_matrix(samples: DataFrame, species: Sequence[Species], seed: int = 0) -> DataFrame:
    """(sample_id, group, mz, rt, value): one row for each sample and isotopologue; order is taken within a batch."""
    o = F.col("order") - F.min("order").over(W.partitionBy("batch"))
    base = samples.withColumn("__o", o.cast("double"))
    out, k = None, 0
    for s in species:
        amount = s.abundance.expr(seed + 17 * k)
        for g, spec in s.by_group.items():
            amount = F.when(F.col("group") == g, spec.expr(seed + 17 * k + 5)).otherwise(amount)
        per = base.withColumn("__c", amount)
        for mz, p in zip(*s.peaks(), strict=True):
            signal = F.col("__c") * s.response.expr(F.col("__o"), F.col("batch")) * p
            v = F.greatest(signal + s.noise.expr(signal, p, seed + 31 * k + 3), F.lit(0.0))
            rows = per.select("sample_id", F.lit(k).alias("group"), F.lit(mz).alias("mz"), F.lit(float(s.rt)).alias("rt"), F.lit(float(s.width)).alias("width"), v.alias("value"))
            out = rows if out is None else out.unionByName(rows)
            k += 1
    return out


def simulate_spectra(samples: DataFrame, species: Sequence[Species], n_scans: int = 40, interval: float = 1.0, min_intensity: float = 0.0, grid: Sequence[float] | None = None, mz_width: float = 0.003, mz_noise: float = 0.0, intensity_noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Spectra of every sample: peaks gaussian in time, sticks in m/z or, on a ``grid``, gaussian profiles."""
    cells = data_matrix(samples, species, seed)
    scans = samples.sparkSession.range(n_scans).select(F.col("id").cast("int").alias("scan"), (F.col("id") * interval).alias("time"))
    z = (F.col("time") - F.col("rt")) / F.col("width")
    hit = cells.crossJoin(F.broadcast(scans)).withColumn("i", F.col("value") * F.exp(-0.5 * z * z))
    if intensity_noise:
        hit = hit.withColumn("i", F.greatest(F.col("i") + intensity_noise * F.randn(seed + 101), F.lit(0.0)))
    if mz_noise:
        hit = hit.withColumn("mz", F.col("mz") + mz_noise * F.randn(seed + 102))
    ordered = F.sort_array(F.collect_list(F.when(F.col("i") > min_intensity, F.struct("mz", "i"))))
    spectra = hit.groupBy("sample_id", "scan", "time").agg(ordered.alias("p"))
    mz, inten = F.transform("p", lambda x: x.mz), F.transform("p", lambda x: x.i)
    if grid is not None:
        g = F.array(*[F.lit(float(x)) for x in grid])
        profile = F.transform(g, lambda m: F.aggregate("p", F.lit(0.0), lambda s, x: s + x.i * F.exp(-0.5 * ((m - x.mz) / mz_width) * ((m - x.mz) / mz_width))))
        mz, inten = g, profile
    return spectra.select("sample_id", "scan", F.lit(1).alias("ms_level"), "time", F.lit(grid is None).alias("centroid"), mz.alias("mz"), inten.alias("intensity"))


def gaussian_features(n_per_cluster: int, centres: Sequence[Sequence[float]], spread: float = 0.1, seed: int = 0) -> np.ndarray:
    """Points around centres, for matching tests."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(c, spread, (n_per_cluster, len(c))) for c in centres])
