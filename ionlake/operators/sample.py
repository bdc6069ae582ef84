"""Sample-tier operators: from spectra to regions of interest to features. A container holds DataFrames and a status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.functions import peaks, signal
from ionlake.operators import raw
from ionlake.operators.filters import in_bounds
from ionlake.plans.pipeline import Operator
from ionlake.plans.status import SampleStatus


@dataclass(frozen=True)
class SampleData:
    """Spectra, regions and features of any number of samples."""

    spectra: DataFrame
    rois: DataFrame | None = None
    features: DataFrame | None = None
    status: SampleStatus = field(default_factory=SampleStatus)

    def drop_empty_rois(self) -> SampleData:
        """Regions without a feature go."""
        return replace(self, rois=self.rois.join(self.features.select("roi_id").distinct(), "roi_id", "left_semi"))


@dataclass(frozen=True)
class RoiExtractor(Operator):
    """Spectra to regions."""

    tier: ClassVar[str] = "sample"
    makes: ClassVar[SampleStatus] = SampleStatus(roi_extracted=True)

    def extract(self, spectra: DataFrame) -> DataFrame:
        raise NotImplementedError

    def run(self, data: SampleData) -> SampleData:
        return replace(data, rois=self.extract(data.spectra))


@dataclass(frozen=True)
class RoiTransformer(Operator):
    """Maps each region, a dict of arrays; None deletes it."""

    tier: ClassVar[str] = "sample"
    needs: ClassVar[SampleStatus] = SampleStatus(roi_extracted=True)
    fn: Callable[[dict], dict | None] | None = None

    def transform_roi(self, roi: dict) -> dict | None:
        return self.fn(roi)

    def run(self, data: SampleData) -> SampleData:
        fn, names = self.transform_roi, data.rois.columns

        def each(batches):
            for pdf in batches:
                out = [r for r in map(fn, pdf.to_dict("records")) if r is not None]
                yield pd.DataFrame(out, columns=names)

        return replace(data, rois=data.rois.mapInPandas(each, data.rois.schema))


@dataclass(frozen=True)
class FeatureExtractor(Operator):
    """Regions to peaks with descriptors, kept within closed ``bounds`` of descriptors."""

    tier: ClassVar[str] = "sample"
    needs: ClassVar[SampleStatus] = SampleStatus(roi_extracted=True)
    makes: ClassVar[SampleStatus] = SampleStatus(feature_extracted=True)
    bounds: dict = field(default_factory=dict)

    def find(self, roi: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def run(self, data: SampleData) -> SampleData:
        find, names = self.find, data.rois.columns
        schema = data.rois.schema.simpleString()[len("struct<") : -1] + ",feature_id:string,start:int,apex:int,end:int"

        def each(batches):
            for pdf in batches:
                rows = []
                for r in pdf.to_dict("records"):
                    if r["noise"] is None:
                        r["noise"] = signal.estimate_noise(np.asarray(r["spint"], float))
                    if r["baseline"] is None:
                        r["baseline"] = np.zeros(len(r["spint"]))
                    for k, (s, a, e) in enumerate(zip(*find(r), strict=True)):
                        rows.append(r | {"feature_id": f"{r['roi_id']}-{k}", "start": int(s), "apex": int(a), "end": int(e)})
                yield pd.DataFrame(rows, columns=[*names, "feature_id", "start", "apex", "end"])

        found = data.rois.mapInPandas(each, schema.replace(":", " "))
        full = peaks.with_descriptors(found)
        named = full.withColumnRenamed("mz", "trace_mz").withColumnRenamed("peak_mz", "mz")
        return replace(data, features=named.where(in_bounds(named, self.bounds)))


@dataclass(frozen=True)
class FeatureTransformer(Operator):
    """Maps the features; rows that ``fn`` leaves out are deleted."""

    tier: ClassVar[str] = "sample"
    needs: ClassVar[SampleStatus] = SampleStatus(feature_extracted=True)
    fn: Callable[[DataFrame], DataFrame] | None = None

    def run(self, data: SampleData) -> SampleData:
        return replace(data, features=self.fn(data.features))


@dataclass(frozen=True)
class LCTraceExtractor(RoiExtractor):
    """m/z traces of liquid chromatography data."""

    tolerance: float = 0.01
    max_missing: int = 1
    min_length: int = 5
    min_intensity: float = 0.0
    multiple_match: str = "reduce"
    targeted_mz: tuple | None = None
    pad: int = 0
    # By instrument and separation.
    presets: ClassVar[dict[str, dict]] = {
        f"{i}-{s}": {"tolerance": t, "min_length": n, "max_missing": 1, "pad": 2, "min_intensity": 250.0} for i, t in (("qtof", 0.01), ("orbitrap", 0.005)) for s, n in (("uplc", 10), ("hplc", 20))
    }

    def extract(self, spectra):
        return raw.extract_rois(spectra, self.tolerance, self.max_missing, self.min_length, self.min_intensity, self.multiple_match, self.targeted_mz, self.pad)


@dataclass(frozen=True)
class LCTraceBaselineEstimator(RoiTransformer):
    """Adds noise and baseline to each trace."""

    robust: bool = True
    min_slice_size: int = 200
    n_slices: int = 5
    smoothing_strength: float | None = 1.0
    min_proba: float = 0.05

    def transform_roi(self, roi):
        x = np.asarray(roi["spint"], float)
        noise = signal.estimate_noise(x, self.min_slice_size, self.n_slices, self.robust)
        soft = signal.smooth(x, self.smoothing_strength) if self.smoothing_strength else x
        baseline = np.minimum(signal.estimate_baseline(soft, noise, self.min_proba), x)
        return roi | {"noise": noise, "baseline": baseline}


@dataclass(frozen=True)
class LCTraceSmoother(RoiTransformer):
    strength: float = 1.0

    def transform_roi(self, roi):
        return roi | {"spint": signal.smooth(np.asarray(roi["spint"], float), self.strength)}


@dataclass(frozen=True)
class LCPeakExtractor(FeatureExtractor):
    """Chromatographic peaks."""

    presets: ClassVar[dict[str, dict]] = {"hplc": {"bounds": {"width": (10.0, 90.0), "snr": (5.0, None)}}, "uplc": {"bounds": {"width": (4.0, 60.0), "snr": (5.0, None)}}}

    def find(self, roi):
        x, noise, base = (np.asarray(roi[k], float) for k in ("spint", "noise", "baseline"))
        return signal.detect_peaks(x, noise, base)
