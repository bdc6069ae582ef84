"""The data matrix in long form: values (sample_id, group, value), samples and groups, with a processing status.

Nothing is indexed by position, so removals, selections and unions are joins and filters. The wide form exists only on
export.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.functions.columns import NAN, nan_to_null
from ionlake.operators import metrics
from ionlake.plans.status import MatrixStatus


class EmptyMatrixError(ValueError):
    """A removal would leave no sample or no group."""


class UnknownFieldError(KeyError):
    """Samples or groups have no such field."""


def _id_frame(matrix: Matrix, name: str, ids: Iterable) -> DataFrame:
    kind = (matrix.samples if name == "sample_id" else matrix.groups).schema[name].dataType
    return matrix.values.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(name, kind)]))


def predicate(df: DataFrame, **fields):
    """AND over fields: equality with a scalar, membership in a list or tuple."""
    out = F.lit(True)
    for name, want in fields.items():
        if name not in df.columns:
            raise UnknownFieldError(name)
        out = out & (F.col(name).isin(list(want)) if isinstance(want, (list, tuple, set)) else F.col(name) == F.lit(want))
    return out


@dataclass(frozen=True)
class Query:
    """Selects samples by metadata, optionally grouped."""

    matrix: Matrix
    criteria: dict = field(default_factory=dict)
    fields: tuple[str, ...] = ()

    def filter(self, **criteria) -> Query:
        predicate(self.matrix.samples, **criteria)
        return replace(self, criteria=self.criteria | criteria)

    def group_by(self, *fields: str) -> Query:
        for f in fields:
            if f not in self.matrix.samples.columns:
                raise UnknownFieldError(f)
        return replace(self, fields=fields)

    def samples(self) -> DataFrame:
        """Selected samples as a DataFrame."""
        return self.matrix.samples.where(predicate(self.matrix.samples, **self.criteria))

    def sample_groups(self) -> DataFrame:
        """One row for each combination of the fields with the ids of its samples, in order."""
        ids = F.transform(F.sort_array(F.collect_list(F.struct("order", "sample_id"))), lambda s: s.sample_id)
        return self.samples().groupBy(*self.fields).agg(ids.alias("sample_ids"), F.min("order").alias("first")).orderBy("first").drop("first")

    def fetch_sample_ids(self) -> list[tuple[tuple, list]]:
        """(group, ids) pairs in first-seen order; without group_by one group ()."""
        return [(tuple(r[f] for f in self.fields), list(r.sample_ids)) for r in self.sample_groups().collect()]


@dataclass(frozen=True)
class Matrix:
    """Long values with their samples (sample_id, type, group, order, batch, ...) and groups (group, descriptors...)."""

    values: DataFrame
    samples: DataFrame
    groups: DataFrame
    status: MatrixStatus = field(default_factory=MatrixStatus)

    # -- checks -----------------------------------------------------------

    def validate(self) -> Matrix:
        """Sample ids and orders are unique, groups are unique, and each cell is there exactly once."""
        s = self.samples.agg(F.count("*"), F.countDistinct("sample_id"), F.countDistinct("order")).head()
        if len({*s}) != 1:
            raise ValueError("sample ids and orders need to be unique")
        g = self.groups.agg(F.count("*"), F.countDistinct("group")).head()
        if g[0] != g[1]:
            raise ValueError("groups need to be unique")
        cells = self.values.groupBy("sample_id", "group").count().agg(F.sum("count"), F.count("*")).head()
        if (cells[0] or 0) != s[0] * g[0] or cells[0] != cells[1]:
            raise ValueError("each sample needs one value for each group")
        return self

    def missing_imputed(self) -> bool:
        """Whether no value is missing."""
        return self.values.where(F.isnan("value") | F.col("value").isNull()).limit(1).count() == 0

    # -- lookups ----------------------------------------------------------

    @property
    def query(self) -> Query:
        return Query(self)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the views ``matrix_values``, ``samples`` and ``feature_groups``."""
        for name, df in (("matrix_values", self.values), ("samples", self.samples), ("feature_groups", self.groups)):
            df.createOrReplaceTempView(name)
        return self.values.sparkSession.sql(text)

    def list_sample_ids(self) -> list:
        return [r[0] for r in self.samples.orderBy("order").select("sample_id").collect()]

    def list_groups(self) -> list:
        return [r[0] for r in self.groups.orderBy("group").select("group").collect()]

    def list_sample_field(self, name: str) -> list:
        """One metadata field in sample order; None where it is absent."""
        if name not in self.samples.columns:
            return [None] * self.samples.count()
        return [r[0] for r in self.samples.orderBy("order").select(name).collect()]

    def _check(self, name: str, ids: Iterable | None) -> DataFrame | None:
        if ids is None:
            return None
        want = _id_frame(self, name, dict.fromkeys(ids))
        have = self.samples if name == "sample_id" else self.groups
        gone = [r[0] for r in want.join(have, name, "left_anti").collect()]
        if gone:
            raise KeyError(f"no such {name}: {gone}")
        return want

    def has_sample(self, sample_id) -> bool:
        return self.samples.where(F.col("sample_id") == F.lit(sample_id)).limit(1).count() > 0

    def has_group(self, group) -> bool:
        return self.groups.where(F.col("group") == F.lit(group)).limit(1).count() > 0

    def get_data(self, sample_ids: Iterable | None = None, groups: Iterable | None = None) -> DataFrame:
        """Values of the given samples and groups (all of either if not given); unknown ids raise."""
        out = self.values
        for name, ids in (("sample_id", sample_ids), ("group", groups)):
            want = self._check(name, ids)
            out = out if want is None else out.join(want, name, "left_semi")
        return out.select("sample_id", "group", "value")

    def get_rows(self, *sample_ids) -> DataFrame:
        return self.get_data(sample_ids=sample_ids or None)

    def get_columns(self, *groups) -> DataFrame:
        return self.get_data(groups=groups or None)

    def get_sample(self, sample_id) -> DataFrame:
        return self.get_data(sample_ids=[sample_id])

    def get_feature(self, group) -> DataFrame:
        return self.get_data(groups=[group])

    # -- new matrices -----------------------------------------------------

    def submatrix(self, sample_ids: Iterable | None = None, groups: Iterable | None = None) -> Matrix:
        """Rows and columns of the given ids, with the status kept."""
        s, g = self._check("sample_id", sample_ids), self._check("group", groups)
        return self._semi(s, g)

    def _semi(self, samples: DataFrame | None, groups: DataFrame | None, how: str = "left_semi") -> Matrix:
        v, s, g = self.values, self.samples, self.groups
        if samples is not None:
            v, s = v.join(samples.select("sample_id"), "sample_id", how), s.join(samples.select("sample_id"), "sample_id", how)
        if groups is not None:
            v, g = v.join(groups.select("group"), "group", how), g.join(groups.select("group"), "group", how)
        return replace(self, values=v.select("sample_id", "group", "value"), samples=s, groups=g)

    def where_samples(self, condition) -> Matrix:
        return self._semi(self.samples.where(condition), None)

    def _non_empty(self, what: str) -> Matrix:
        if (self.samples if what == "samples" else self.groups).limit(1).count() == 0:
            raise EmptyMatrixError(f"no {what} are left")
        return self

    def remove_samples(self, *sample_ids) -> Matrix:
        return self._semi(self._check("sample_id", sample_ids), None, "left_anti")._non_empty("samples")

    def remove_groups(self, *groups) -> Matrix:
        return self._semi(None, self._check("group", groups), "left_anti")._non_empty("groups")

    def drop_groups(self, groups: DataFrame) -> Matrix:
        """Remove the groups listed in a DataFrame; no id comes to the driver."""
        return self._semi(None, groups, "left_anti")._non_empty("groups")

    def drop_samples(self, samples: DataFrame) -> Matrix:
        return self._semi(samples, None, "left_anti")._non_empty("samples")

    def set_values(self, new: DataFrame) -> Matrix:
        """Overwrite the cells that ``new`` (sample_id, group, value) has; cells outside the matrix raise."""
        outside = new.join(self.samples, "sample_id", "left_anti").select("sample_id").unionAll(new.join(self.groups, "group", "left_anti").select("sample_id"))
        if outside.limit(1).count():
            raise KeyError("values are given for cells outside the matrix")
        n = new.select("sample_id", "group", F.col("value").cast("double").alias("new"), F.lit(True).alias("has"))
        both = self.values.join(n, ["sample_id", "group"], "left")
        return replace(self, values=both.select("sample_id", "group", F.when(F.col("has"), F.col("new")).otherwise(F.col("value")).alias("value")))

    def set_columns(self, columns: dict[object, Sequence[float]]) -> Matrix:
        """Overwrite whole columns, values in sample order."""
        ids = self.list_sample_ids()
        if any(len(v) != len(ids) for v in columns.values()):
            raise ValueError("a column needs one value for each sample")
        self._check("group", columns)
        return self.set_values(self._cells([(i, g, float(x)) for g, v in columns.items() for i, x in zip(ids, v, strict=True)]))

    def set_rows(self, rows: dict[object, Sequence[float]]) -> Matrix:
        """Overwrite whole rows, values in group order."""
        groups = self.list_groups()
        if any(len(v) != len(groups) for v in rows.values()):
            raise ValueError("a row needs one value for each group")
        self._check("sample_id", rows)
        return self.set_values(self._cells([(i, g, float(x)) for i, v in rows.items() for g, x in zip(groups, v, strict=True)]))

    def _cells(self, cells: list[tuple]) -> DataFrame:
        fields = [T.StructField("sample_id", self.samples.schema["sample_id"].dataType), T.StructField("group", self.groups.schema["group"].dataType), T.StructField("value", T.DoubleType())]
        return self.values.sparkSession.createDataFrame(cells, T.StructType(fields))

    def add_groups(self, values: DataFrame, groups: DataFrame) -> Matrix:
        """New columns; their labels must be new."""
        if groups.join(self.groups, "group", "left_semi").limit(1).count():
            raise ValueError("some groups are there already")
        v = self.values.unionByName(values.select("sample_id", "group", "value"))
        return replace(self, values=v, groups=self.groups.unionByName(groups, allowMissingColumns=True)).validate()

    @staticmethod
    def combine(*matrices: Matrix) -> Matrix:
        """Stack the samples of matrices with equal groups; descriptors come from the first."""
        first = matrices[0]
        for m in matrices[1:]:
            a, b = first.groups.select("group"), m.groups.select("group")
            if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
                raise ValueError("the matrices have different groups")
        union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
        return replace(first, values=union([m.values for m in matrices]), samples=union([m.samples for m in matrices])).validate()

    # -- metrics ----------------------------------------------------------

    @property
    def metrics(self) -> Metrics:
        return Metrics(self)

    # -- exchange ---------------------------------------------------------

    def wide(self) -> DataFrame:
        """One row for each sample and a column for each group, for export."""
        return self.values.groupBy("sample_id").pivot("group", self.list_groups()).agg(F.first("value"))

    def to_dict(self) -> dict:
        """Small matrices as plain lists: sample ids, groups and rows of values."""
        ids, groups = self.list_sample_ids(), self.list_groups()
        cell = {(r.sample_id, r.group): r.value for r in self.values.collect()}
        return {"samples": [r.asDict(recursive=True) for r in self.samples.orderBy("order").collect()], "groups": [r.asDict(recursive=True) for r in self.groups.orderBy("group").collect()], "data": [[cell[i, g] for g in groups] for i in ids]}

    @staticmethod
    def from_dict(spark, data: dict) -> Matrix:
        samples, groups = (spark.createDataFrame([{k: v for k, v in x.items()} for x in data[n]]) for n in ("samples", "groups"))
        ids, labels = [s["sample_id"] for s in data["samples"]], [g["group"] for g in data["groups"]]
        m = Matrix(samples.select(F.lit(NAN).alias("value"), "sample_id"), samples, groups)
        values = m._cells([(i, g, float(NAN if x is None else x)) for i, row in zip(ids, data["data"], strict=True) for g, x in zip(labels, row, strict=True)])
        return replace(m, values=values).validate()

    def write_csv(self, path: str) -> None:
        self.values.select("sample_id", "group", "value").write.mode("overwrite").option("header", True).csv(f"{path}/values")
        for name, df in (("samples", self.samples), ("groups", self.groups)):
            df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")

    @staticmethod
    def read_csv(spark, path: str, samples_schema, groups_schema) -> Matrix:
        samples = spark.read.schema(samples_schema).option("header", True).csv(f"{path}/samples")
        groups = spark.read.schema(groups_schema).option("header", True).csv(f"{path}/groups")
        schema = T.StructType([T.StructField("sample_id", samples.schema["sample_id"].dataType), T.StructField("group", groups.schema["group"].dataType), T.StructField("value", T.DoubleType())])
        return Matrix(spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(f"{path}/values"), samples, groups)


@dataclass(frozen=True)
class Metrics:
    """Metrics bound to a matrix, with samples picked by type."""

    matrix: Matrix

    def _of(self, what: str, types: Sequence[str] | None) -> DataFrame:
        m = self.matrix
        if types is None:
            return m.values
        picked = m.samples.where(F.col("type").isin(list(types)))
        if picked.limit(1).count() == 0:
            raise ValueError(f"there are no samples of type {', '.join(types)} for the {what}")
        return m.values.join(picked.select("sample_id"), "sample_id", "left_semi")

    def cv(self, robust: bool = False, types: Sequence[str] | None = None) -> DataFrame:
        return metrics.cv(self._of("cv", types), robust)

    def detection_rate(self, threshold: float = 0.0, types: Sequence[str] | None = None) -> DataFrame:
        return metrics.detection_rate(self._of("detection rate", types), threshold)

    def dratio(self, robust: bool = False, sample_types: Sequence[str] = ("sample",), qc_types: Sequence[str] = ("qc",)) -> DataFrame:
        return metrics.dratio(self._of("D-ratio", qc_types), self._of("D-ratio", sample_types), robust)

    def lod(self, sample_type: str = "sample") -> DataFrame:
        return metrics.lod(self._of("limit of detection", [sample_type]))

    def loq(self, sample_type: str = "sample") -> DataFrame:
        return metrics.loq(self._of("limit of quantification", [sample_type]))

    def correlation(self, field: str, method: str = "pearson") -> DataFrame:
        return metrics.correlation(self.matrix.values, self.matrix.samples, field, method)

    def pca(self, n_components: int = 2, normalization: str | None = None, scaling: str | None = None) -> tuple[metrics.PCA, DataFrame]:
        """Components and scores (sample_id, score); the number of groups bounds what reaches the driver."""
        from ionlake.operators import transform

        v = self.matrix.values
        if normalization:
            v = transform.normalize(v, normalization)
        if scaling:
            v = transform.scale(v, scaling)
        rows = v.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("group", nan_to_null("value").alias("value")))), lambda s: s.value).alias("x"))
        fit = metrics.pca(rows, "x", self.matrix.groups.count(), n_components)
        return fit, fit.scores(rows, "x").select("sample_id", "score")
