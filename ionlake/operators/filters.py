"""Matrix operators: filters, blank correction, per-vector transformers, normalisation and scaling as pipeline steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.functions.columns import NAN
from ionlake.operators import metrics, transform
from ionlake.operators.matrix import Matrix, UnknownFieldError, predicate
from ionlake.plans.pipeline import Operator
from ionlake.plans.status import MatrixStatus


@dataclass(frozen=True)
class MatrixTransformer(Operator):
    """Maps a whole matrix."""

    tier: ClassVar[str] = "matrix"


@dataclass(frozen=True)
class ColumnFilter(MatrixTransformer):
    """Drops the groups that ``drop_list`` gives, except those in ``exclude``."""

    exclude: tuple = ()

    def drop_list(self, matrix: Matrix) -> DataFrame:
        raise NotImplementedError

    def run(self, matrix: Matrix) -> Matrix:
        gone = self.drop_list(matrix).select("group")
        return matrix.drop_groups(gone.where(~F.col("group").isin(list(self.exclude))) if self.exclude else gone)


@dataclass(frozen=True)
class RowFilter(MatrixTransformer):
    """Drops the samples that ``drop_list`` gives, except those in ``exclude``."""

    exclude: tuple = ()

    def drop_list(self, matrix: Matrix) -> DataFrame:
        raise NotImplementedError

    def run(self, matrix: Matrix) -> Matrix:
        gone = self.drop_list(matrix).select("sample_id")
        return matrix.drop_samples(gone.where(~F.col("sample_id").isin(list(self.exclude))) if self.exclude else gone)


@dataclass(frozen=True)
class VectorTransformer(MatrixTransformer):
    """Maps each column or row, as a numpy vector in a defined order, by ``transform_vector`` on the executors."""

    exclude: tuple = ()
    key: ClassVar[str] = "group"

    def transform_vector(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def run(self, matrix: Matrix) -> Matrix:
        key, other = self.key, "sample_id" if self.key == "group" else "group"
        order = matrix.samples.select("sample_id", F.col("order").alias("__o")) if key == "group" else matrix.groups.select("group", F.col("group").alias("__o"))
        fn, skip = self.transform_vector, set(self.exclude)
        out = T.StructType([matrix.values.schema["sample_id"], matrix.values.schema["group"], T.StructField("value", T.DoubleType())])

        def each(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__o")
            if k[0] not in skip:
                pdf["value"] = fn(pdf["value"].to_numpy(np.float64))
            return pdf[["sample_id", "group", "value"]]

        return replace(matrix, values=matrix.values.join(order, other).groupBy(key).applyInPandas(each, out))


@dataclass(frozen=True)
class ColumnTransformer(VectorTransformer):
    key: ClassVar[str] = "group"
    fn: Callable | None = None

    def transform_vector(self, x):
        return self.fn(x)


@dataclass(frozen=True)
class RowTransformer(VectorTransformer):
    key: ClassVar[str] = "sample_id"
    fn: Callable | None = None

    def transform_vector(self, x):
        return self.fn(x)


@dataclass(frozen=True)
class SampleFilter(RowFilter):
    """Removes the samples that match all criteria; without criteria that is every sample."""

    criteria: dict = field(default_factory=dict)

    def drop_list(self, matrix: Matrix) -> DataFrame:
        return matrix.samples.where(predicate(matrix.samples, **self.criteria))


@dataclass(frozen=True)
class FeatureFilter(ColumnFilter):
    """Keeps the groups whose descriptors lie in closed ranges; an open side is None, NaN lies in no range."""

    bounds: dict = field(default_factory=dict)

    def drop_list(self, matrix: Matrix) -> DataFrame:
        inside = in_bounds(matrix.groups, self.bounds)
        return matrix.groups.where(~F.coalesce(inside, F.lit(False)))


def in_bounds(df: DataFrame, bounds: dict):
    """Condition that each named column lies in [low, high]; None is open, NaN is outside."""
    out = F.lit(True)
    for name, (lo, hi) in bounds.items():
        if name not in df.columns:
            raise UnknownFieldError(name)
        c = F.col(name).cast("double")
        out = out & ~F.isnan(c) & (c >= (float("-inf") if lo is None else float(lo))) & (c <= (float("inf") if hi is None else float(hi)))
    return out


@dataclass(frozen=True)
class BlankCorrector(MatrixTransformer):
    """Subtracts each group's aggregated blank from the samples and clamps every value at 0; NaN stays.

    ``exclude_samples`` and ``exclude_groups`` are not corrected (but clamped). ``blank_groups`` picks blanks by their
    ``group`` field instead of by type. ``apply_to_blanks`` corrects the blanks as well.
    """

    aggregation: str = "avg"
    blank_groups: tuple = ()
    exclude_samples: tuple = ()
    exclude_groups: tuple = ()
    apply_to_blanks: bool = False
    makes: ClassVar[MatrixStatus] = MatrixStatus(corrected=True)

    def run(self, matrix: Matrix) -> Matrix:
        s = matrix.samples
        blanks = s.where(F.col("group").isin(list(self.blank_groups)) if self.blank_groups else F.col("type") == "blank").select("sample_id")
        if blanks.limit(1).count() == 0:
            raise ValueError("there are no blank samples")
        level = metrics.aggregate(matrix.values.join(blanks, "sample_id", "left_semi"), self.aggregation).withColumnRenamed("metric", "blank")
        out = matrix.values.join(level, "group")
        out = out.join(blanks.withColumn("is_blank", F.lit(True)), "sample_id", "left")
        apply = F.lit(True) if self.apply_to_blanks else F.col("is_blank").isNull()
        for name, ids in (("sample_id", self.exclude_samples), ("group", self.exclude_groups)):
            if ids:
                apply = apply & ~F.col(name).isin(list(ids))
        new = F.greatest(F.col("value") - F.when(apply, F.col("blank")).otherwise(F.lit(0.0)), F.lit(0.0))
        return replace(matrix, values=out.select("sample_id", "group", F.when(F.isnan("value"), F.lit(NAN)).otherwise(new).alias("value")))


@dataclass(frozen=True)
class MetricsFilter(ColumnFilter):
    """Drops groups whose metric, aggregated over sample groups, is outside [lb, ub]; NaN metrics are kept."""

    lb: float = 0.0
    ub: float = 0.25
    group_by: tuple = ()
    filter: dict = field(default_factory=dict)
    aggregation: str = "min"

    def __post_init__(self):
        if self.ub < self.lb:
            raise ValueError("the upper bound is below the lower one")

    def metric(self, values: DataFrame, by: list[str], matrix: Matrix) -> DataFrame:
        """Metric of each key in ``by`` (the sample fields and ``group``)."""
        raise NotImplementedError

    def combined(self, matrix: Matrix) -> DataFrame:
        """The metric of each group over the sample groups, as (group, metric)."""
        samples = matrix.samples.where(predicate(matrix.samples, **self.filter))
        for f in self.group_by:
            if f not in samples.columns:
                raise UnknownFieldError(f)
        if samples.limit(1).count() == 0:
            raise ValueError("no sample matches the filter")
        keys = [F.col(f).alias(f"by_{f}") for f in self.group_by]
        values = matrix.values.join(samples.select("sample_id", *keys), "sample_id")
        each = self.metric(values, [*[f"by_{f}" for f in self.group_by], "group"], matrix)
        if not self.group_by:
            return each.select("group", "metric")
        return each.groupBy("group").agg(metrics.aggregation(self.aggregation, "metric").alias("metric"))

    def drop_list(self, matrix: Matrix) -> DataFrame:
        m = F.col("metric")
        return self.combined(matrix).where(~F.isnan(m) & ((m < self.lb) | (m > self.ub)))


@dataclass(frozen=True)
class CVFilter(MetricsFilter):
    """Coefficient of variation, of quality controls by default."""

    filter: dict = field(default_factory=lambda: {"type": "qc"})
    robust: bool = True

    def metric(self, values, by, matrix):
        return metrics.cv(values, self.robust, by)


@dataclass(frozen=True)
class DetectionRateFilter(MetricsFilter):
    """Detection rate of each sample group; without a threshold it is the limit of detection of the samples at hand."""

    lb: float = 0.9
    ub: float = 1.0
    group_by: tuple = ("group",)
    filter: dict = field(default_factory=lambda: {"type": "sample"})
    threshold: float | None = None

    def metric(self, values, by, matrix):
        if self.threshold is not None:
            return metrics.detection_rate(values, self.threshold, by)
        lod = metrics._spread(values, by, False).select(*[F.col(b).alias(f"l_{b}") for b in by], F.coalesce(F.col("centre") + 3 * F.col("spread"), F.lit(0.0)).alias("lod"))
        on = [F.col(b).eqNullSafe(F.col(f"l_{b}")) for b in by]
        return metrics.detection_rate(values.join(lod, on), F.col("lod"), by)


@dataclass(frozen=True)
class DRatioFilter(MetricsFilter):
    """Deviation of quality controls over that of samples. It compares two sets of samples, so takes no filter."""

    lb: float = 0.0
    ub: float = 1.0
    robust: bool = True
    sample_types: tuple = ("sample",)
    qc_types: tuple = ("qc",)

    def __post_init__(self):
        super().__post_init__()
        if self.filter or self.group_by:
            raise ValueError("filter and group_by do not apply to the D-ratio")

    def combined(self, matrix):
        return matrix.metrics.dratio(self.robust, self.sample_types, self.qc_types)


@dataclass(frozen=True)
class CorrelationFilter(MetricsFilter):
    """Correlation with a numeric field of the samples."""

    lb: float = -1.0
    ub: float = 1.0
    field_name: str = "order"
    method: str = "pearson"
    needs: ClassVar[MatrixStatus] = MatrixStatus(missing_imputed=True)

    def metric(self, values, by, matrix):
        samples = matrix.samples
        plain = values.select("sample_id", "group", "value", *[b for b in by if b != "group"])
        meta = samples.select("sample_id", F.col(self.field_name)) if self.field_name in samples.columns else samples
        if len(by) == 1:
            return metrics.correlation(plain, meta, self.field_name, self.method)
        keyed = plain.withColumn("__g", F.struct(*by))
        out = metrics.correlation(keyed.select("sample_id", F.col("__g").alias("group"), "value"), meta, self.field_name, self.method)
        return out.select("group.*", "metric")


@dataclass(frozen=True)
class Normalizer(MatrixTransformer):
    """Row normalisation as a step."""

    method: str = "sum"
    feature: int | str | None = None
    makes: ClassVar[MatrixStatus] = MatrixStatus(normalized=True)

    def run(self, matrix):
        return replace(matrix, values=transform.normalize(matrix.values, self.method, self.feature))


@dataclass(frozen=True)
class Scaler(MatrixTransformer):
    """Column scaling as a step."""

    method: str = "autoscaling"

    def run(self, matrix):
        return replace(matrix, values=transform.scale(matrix.values, self.method))
