"""Assay-tier operations: patches, snapshots, feature groups, consensus annotation, matrix building, imputation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionlake.functions.columns import NAN, nan_to_null, null_to_nan
from ionlake.operators import matching
from ionlake.operators.joins import missing_pairs
from ionlake.operators.matrix import Matrix
from ionlake.operators.raw import explode_points
from ionlake.plans.pipeline import Operator
from ionlake.plans.status import AssayStatus, MatrixStatus

ANNOTATION_FIELDS = ("group", "isotopologue_label", "isotopologue_index", "charge")


def latest(patches: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last patch of each key; max_by combines on the map side, unlike a window."""
    rest = [c for c in patches.columns if c not in keys]
    return patches.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("p")).select(*keys, "p.*")


def apply_patches(table: DataFrame, patches: DataFrame, key: str, name: str, value: str = "value", snapshots: list[str] | None = None) -> DataFrame:
    """Merge on read: entity-attribute-value patches (``key``, ``name``, ``value``, ``seq``, ``snapshot_id``) over columns.

    Only patches of the given snapshots count; the latest of each field wins; fields that are no column raise nothing and
    do nothing.
    """
    if snapshots is not None:
        patches = patches.where(F.col("snapshot_id").isin(snapshots))
    fields = [c for c in table.columns if c != key]
    last = latest(patches.select(key, name, value, "seq"), [key, name]).select(key, name, value)
    wide = last.groupBy(key).pivot(name, fields).agg(F.first(value))
    wide = wide.select(key, *[F.col(f"`{c}`").alias(f"__p_{c}") for c in fields])
    out = table.join(wide, key, "left")
    return out.select(key, *[F.coalesce(F.col(f"__p_{c}").cast(table.schema[c].dataType), F.col(f"`{c}`")).alias(c) for c in fields])


def feature_groups(features: DataFrame, descriptors: list[str], agg: str | dict | Callable = "mean") -> DataFrame:
    """One row for each group with its aggregated descriptors, NaN skipped; ``first`` takes the first feature's.

    ``agg`` may be a name, a name or function of a column for each descriptor, or one function for all.
    """
    named = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}

    def of(d: str):
        how = agg.get(d, "mean") if isinstance(agg, dict) else agg
        if how == "first":
            return F.min_by(d, "feature_id")
        return (named[how] if isinstance(how, str) else how)(nan_to_null(d))

    return features.where("`group` > -1").groupBy("group").agg(*[null_to_nan(of(d)).alias(d) for d in descriptors])


def consensus_annotation(features: DataFrame) -> DataFrame:
    """Isotopologue groups over all samples: (group, isotopologue_group, isotopologue_index, charge).

    Inside samples the member with index 0 of a label (its lightest isotopologue) is linked to the others; links are
    counted over samples. A node's charge and index are what most of its features say (ties: the smallest). Links between
    different charges or equal indices go; each other node keeps its most frequent link, each lightest its most frequent
    for an index; indices are kept as far as they are contiguous.
    """
    a = features.where("`group` > -1 and isotopologue_label > -1").select("sample_id", "group", "isotopologue_label", "isotopologue_index", "charge")
    mode = lambda c: F.max_by(c, F.struct("n", -F.col(c)))
    votes = [a.groupBy("group", c).agg(F.count("*").alias("n")).groupBy("group").agg(mode(c).alias(c)) for c in ("charge", "isotopologue_index")]
    node = votes[0].join(votes[1], "group")
    head = a.where("isotopologue_index = 0").select("sample_id", "isotopologue_label", F.col("group").alias("mmi"))
    link = a.where("isotopologue_index > 0").select("sample_id", "isotopologue_label", F.col("group").alias("member"))
    edges = head.join(link, ["sample_id", "isotopologue_label"]).groupBy("mmi", "member").agg(F.count("*").alias("n"))
    left = node.select(F.col("group").alias("mmi"), F.col("charge").alias("c0"), F.col("isotopologue_index").alias("i0"))
    right = node.select(F.col("group").alias("member"), F.col("charge").alias("c1"), F.col("isotopologue_index").alias("i1"))
    edges = edges.join(left, "mmi").join(right, "member").where("c0 = c1 and i0 <> i1 and i0 = 0 and i1 > 0")
    best = edges.groupBy("member").agg(F.max_by(F.struct("mmi", "n", F.col("i1").alias("idx"), F.col("c1").alias("charge")), F.struct("n", -F.col("mmi"))).alias("e")).select("member", "e.*")
    best = best.groupBy("mmi", "idx").agg(F.max_by(F.struct("member", "charge"), F.struct("n", -F.col("member"))).alias("e")).select("mmi", "idx", "e.*")
    w = W.partitionBy("mmi").orderBy("idx")
    kept = best.withColumn("k", F.row_number().over(w)).where("k = idx").drop("k")
    heads = kept.groupBy("mmi").agg(F.max("charge").alias("charge")).select(F.col("mmi").alias("group"), F.col("mmi").alias("isotopologue_group"), F.lit(0).alias("isotopologue_index"), "charge")
    rest = kept.select(F.col("member").alias("group"), F.col("mmi").alias("isotopologue_group"), F.col("idx").alias("isotopologue_index"), "charge")
    return heads.unionByName(rest)


def build_matrix(features: DataFrame, samples: DataFrame, groups: DataFrame, fill: DataFrame | None = None, duplicates: str = "sum", missing: float = 0.0) -> Matrix:
    """Samples x groups with a feature's area in each cell; two features of a cell add up (or the ``last`` counts).

    Fill values come where no feature is; what is still missing is ``missing``.
    """
    f = features.where("`group` > -1")
    agg = F.sum("area") if duplicates == "sum" else F.max_by("area", "feature_id")
    cells = f.groupBy("sample_id", "group").agg(agg.alias("v"))
    out = samples.select("sample_id").crossJoin(groups.select("group")).join(cells, ["sample_id", "group"], "left")
    value = F.col("v")
    if fill is not None:
        out = out.join(fill.select("sample_id", "group", F.col("value").alias("f")), ["sample_id", "group"], "left")
        value = F.coalesce("f", "v")
    values = out.select("sample_id", "group", F.coalesce(value, F.lit(float(missing))).alias("value"))
    return Matrix(values, samples, groups, MatrixStatus(missing_imputed=missing == missing))


def fill_values(features: DataFrame, samples: DataFrame, groups: DataFrame, spectra: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Area of each missing (sample, group): the trapezoid of its chromatogram over the group's time window.

    The window is [mean rt_start, mean rt_end); an m/z bin join brings the points of all groups at once.
    """
    have = features.where("`group` > -1")
    windows = have.groupBy("group").agg(F.avg("mz").alias("g_mz"), F.avg("rt_start").alias("t0"), F.avg("rt_end").alias("t1"))
    gaps = missing_pairs(samples.select("sample_id"), groups.select("group"), have, ["sample_id", "group"]).join(windows, "group")
    width = 2 * tolerance
    w = gaps.withColumn("bin", F.explode(F.sequence(F.floor((F.col("g_mz") - tolerance) / width), F.floor((F.col("g_mz") + tolerance) / width))))
    p = explode_points(spectra).withColumn("bin", F.floor(F.col("mz") / width))
    hit = p.join(w, ["sample_id", "bin"]).where("time >= t0 and time < t1").where((F.col("mz") >= F.col("g_mz") - tolerance) & (F.col("mz") < F.col("g_mz") + tolerance))
    eic = hit.groupBy("sample_id", "group", "time").agg(F.sum("intensity").alias("i"))
    # Scans of the window without a point are zeros of the chromatogram.
    grid = gaps.select("sample_id", "group", "t0", "t1").join(spectra.select("sample_id", "time"), "sample_id").where("time >= t0 and time < t1").select("sample_id", "group", "time")
    full = grid.join(eic, ["sample_id", "group", "time"], "left").withColumn("i", F.coalesce("i", F.lit(0.0)))
    o = W.partitionBy("sample_id", "group").orderBy("time")
    step = (F.col("time") - F.lag("time").over(o)) * (F.col("i") + F.lag("i").over(o)) / 2
    area = full.withColumn("a", step).groupBy("sample_id", "group").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("value"))
    return gaps.select("sample_id", "group").join(area, ["sample_id", "group"], "left").select("sample_id", "group", F.coalesce("value", F.lit(0.0)).alias("value"))


@dataclass(frozen=True)
class AssayData:
    """Features of all samples with their samples, spectra, groups and fill values."""

    features: DataFrame
    samples: DataFrame
    spectra: DataFrame | None = None
    groups: DataFrame | None = None
    fill: DataFrame | None = None
    status: AssayStatus = field(default_factory=AssayStatus)

    def with_groups(self, descriptors=("mz", "rt", "area", "height")) -> AssayData:
        """Feature groups with descriptors and, where features are annotated, consensus annotation."""
        groups = feature_groups(self.features, [d for d in descriptors if d in self.features.columns])
        if "isotopologue_label" in self.features.columns:
            groups = groups.join(consensus_annotation(self.features), "group", "left")
        return replace(self, groups=groups)

    def matrix(self, **options) -> Matrix:
        data = self if self.groups is not None else self.with_groups()
        return build_matrix(data.features, data.samples, data.groups, data.fill, **options)


@dataclass(frozen=True)
class Patcher(Operator):
    """Computes patches (feature_id, ``field``, value, seq, snapshot_id) and applies them to the features."""

    tier: ClassVar[str] = "assay"
    column: ClassVar[str] = "field"

    def compute(self, data: AssayData) -> DataFrame:
        raise NotImplementedError

    def run(self, data: AssayData) -> AssayData:
        return replace(data, features=apply_patches(data.features, self.compute(data), "feature_id", self.column))


@dataclass(frozen=True)
class AnnotationPatcher(Patcher):
    fn: Callable | None = None

    def compute(self, data):
        return self.fn(data)


@dataclass(frozen=True)
class DescriptorPatcher(Patcher):
    column: ClassVar[str] = "descriptor"
    fn: Callable | None = None

    def compute(self, data):
        return self.fn(data)


@dataclass(frozen=True)
class LCFeatureMatcher(Operator):
    """Sets the group of every feature; groups that split one species are merged unless ``max_sample_overlap`` is None."""

    tier: ClassVar[str] = "assay"
    makes: ClassVar[AssayStatus] = AssayStatus(feature_matched=True)
    mz_tolerance: float = 0.01
    rt_tolerance: float = 3.0
    min_fraction: float = 0.25
    max_deviation: float = 3.0
    max_sample_overlap: float | None = 0.25
    groups: tuple = ()
    # By instrument and separation.
    presets: ClassVar[dict[str, dict]] = {f"{i}-{s}": {"mz_tolerance": t, "rt_tolerance": r} for i, t in (("qtof", 0.01), ("orbitrap", 0.005)) for s, r in (("uplc", 5.0), ("hplc", 10.0))}

    def run(self, data):
        tol = {"mz": self.mz_tolerance, "rt": self.rt_tolerance}
        found = matching.match_features(data.features, data.samples, tol, self.min_fraction, self.max_deviation, list(self.groups) or None)
        if self.max_sample_overlap is not None:
            found = matching.merge_groups(data.features.drop("group").join(found, "feature_id"), tol, self.max_sample_overlap)
        return replace(data, features=data.features.drop("group").join(found, "feature_id", "left"))


@dataclass(frozen=True)
class MissingImputer(Operator):
    """Fills cells without a feature from the raw data."""

    tier: ClassVar[str] = "assay"
    needs: ClassVar[AssayStatus] = AssayStatus(feature_matched=True)
    makes: ClassVar[AssayStatus] = AssayStatus(missing_imputed=True)
    mz_tolerance: float = 0.01

    def run(self, data):
        data = data if data.groups is not None else data.with_groups()
        return replace(data, fill=fill_values(data.features, data.samples, data.groups, data.spectra, self.mz_tolerance))


class Snapshots:
    """Named states of a set of tables; only the head can change. States are immutable DataFrames, so this is a list."""

    def __init__(self, head):
        self._states, self._head, self.current = [], head, "head"

    def create(self, name: str) -> None:
        if name == "head" or name in self.list():
            raise ValueError(f"there is a snapshot {name!r} already")
        self._states.append((name, self._head))

    def list(self) -> list[str]:
        return [n for n, _ in self._states]

    def get(self):
        return self._head if self.current == "head" else dict(self._states)[self.current]

    def set(self, name: str, reset: bool = False) -> None:
        """Go to a snapshot; with ``reset`` it becomes the head, and later ones go."""
        if name != "head" and name not in self.list():
            raise KeyError(name)
        if reset and name != "head":
            self._head = dict(self._states)[name]
            self._states = self._states[: self.list().index(name) + 1]
            self.current = "head"
        else:
            self.current = name

    def update(self, head) -> None:
        if self.current != "head":
            raise ValueError("only the head can be changed")
        self._head = head
