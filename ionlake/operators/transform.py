"""Normalisation of rows and scaling of columns of a long matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.functions.columns import NAN, divide, nan_to_null, null_to_nan


def _joined(values: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Statistics of a key joined to its values. Aggregation first keeps hot keys out of a window's single task."""
    return values.join(stats, key)


def normalize(values: DataFrame, method: str = "sum", feature: int | str | None = None) -> DataFrame:
    """Divide each sample's values by their sum, max or norm, or by its own value of one group (``feature``).

    Missing values are skipped; a zero or missing divisor makes the row NaN.
    """
    v = nan_to_null("value")
    if method == "feature":
        if feature is None:
            raise ValueError("method feature needs a reference group")
        stats = values.where(F.col("group") == F.lit(feature)).select("sample_id", v.alias("d"))
        out = values.join(stats, "sample_id", "left")
    else:
        made = {"sum": F.sum(v), "max": F.max(v), "euclidean": F.sqrt(F.sum(v * v))}
        if method not in made:
            raise ValueError(f"unknown normalisation {method!r}")
        out = _joined(values, values.groupBy("sample_id").agg(made[method].alias("d")), "sample_id")
    return out.select("sample_id", "group", null_to_nan(divide(v, F.col("d"))).alias("value"))


def scale(values: DataFrame, method: str = "autoscaling") -> DataFrame:
    """Scale each group: autoscaling (population std), rescaling to [0, 1], or pareto (square root of the std).

    Missing values are skipped and stay missing; constant groups become NaN.
    """
    v = nan_to_null("value")
    stats = values.groupBy("group").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    out = _joined(values, stats, "group")
    made = {
        "autoscaling": divide(v - F.col("mean"), F.col("std")),
        "rescaling": divide(v - F.col("lo"), F.col("hi") - F.col("lo")),
        "pareto": divide(v - F.col("mean"), F.sqrt("std")),
    }
    if method not in made:
        raise ValueError(f"unknown scaling {method!r}")
    fine = F.col("hi") > F.col("lo")
    return out.select("sample_id", "group", F.when(fine, null_to_nan(made[method])).otherwise(F.lit(NAN)).alias("value"))
