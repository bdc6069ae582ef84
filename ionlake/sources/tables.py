"""Tabular sources and sinks: Progenesis matrices, sample sheets, and assay stores of parquet tables with snapshots."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators.assay import apply_patches
from ionlake.operators.matrix import Matrix


def read_progenesis(spark: SparkSession, path: str, kind: str = "Normalised abundance") -> Matrix:
    """A Progenesis export: three header rows, then a row for each feature. ``kind`` is that or ``Raw abundance``.

    Only the header comes to the driver. Times become seconds; empty cells are 0; a group's name stands over its first
    sample and holds up to the next.
    """
    lines = spark.read.text(path)
    head = [r.value for r in lines.limit(3).collect()]
    top, groups, names = (next(csv.reader(io.StringIO(h))) for h in head)
    starts = {t: i for i, t in enumerate(top) if t}
    if kind not in starts:
        raise ValueError(f"the file has no block {kind!r}")
    first = starts[kind]
    last = min((i for i in starts.values() if i > first), default=len(names))
    filled, prev = [], ""
    for g in groups + [""] * (len(names) - len(groups)):
        prev = g or prev
        filled.append(prev)
    info = {n: i for i, n in enumerate(names[: min(starts.values())])}
    columns = [f"c{i}" for i in range(len(names))]
    rows = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path)
    body = rows.where(~F.col(columns[info["m/z"]]).isin("m/z") & F.col(columns[info["m/z"]]).try_cast("double").isNotNull())
    find = lambda *keys: next((columns[i] for n, i in info.items() if any(k in n.lower() for k in keys)), None)
    key, rt, width = columns[0], find("retention time"), find("peak width")
    feats = body.select(F.col(key).alias("name"), F.col(columns[info["m/z"]]).cast("double").alias("mz"), *[(F.col(c).cast("double") * 60).alias(n) for c, n in ((rt, "rt"), (width, "width")) if c])
    from pyspark.sql import Window as W

    feats = feats.withColumn("group", (F.row_number().over(W.orderBy("mz", "name")) - 1).cast("int"))
    cells = F.explode(F.array(*[F.struct(F.lit(names[i]).alias("sample_id"), F.coalesce(F.col(columns[i]).try_cast("double"), F.lit(0.0)).alias("value")) for i in range(first, last)])).alias("cell")
    long = body.select(F.col(key).alias("name"), cells).select("name", "cell.*").join(feats.select("name", "group"), "name").select("sample_id", "group", "value")
    samples = spark.createDataFrame([(names[i], filled[i], i - first, "sample", 0) for i in range(first, last)], "sample_id string, `group` string, `order` int, type string, batch int")
    return Matrix(long, samples, feats.select("group", *[c for c in feats.columns if c != "group"]))


SAMPLE_FIELDS = ("id", "path", "reader", "ms_data_mode", "ms_level", "start_time", "end_time", "type", "group", "order", "batch")
_TYPES = {"ms_level": "int", "start_time": "double", "end_time": "double", "order": "int", "batch": "int"}


def sample_sheet_template(path: str, ids: Iterable[str] = (), extra: Iterable[str] = ()) -> None:
    """An empty sheet with a row for each sample, as CSV or, by its suffix, YAML."""
    fields = [*SAMPLE_FIELDS, *extra]
    if path.endswith((".yaml", ".yml")):
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump([{k: (i if k == "id" else None) for k in fields} for i in ids], f, sort_keys=False)
        return
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(fields)
        w.writerows([[i, *[""] * (len(fields) - 1)] for i in ids])


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Samples from a CSV or YAML sheet; empty fields are null and unknown columns become the map ``extra``."""
    if path.endswith((".yaml", ".yml")):
        with open(path, encoding="utf-8") as f:
            rows = yaml.safe_load(f) or []
        names = list(dict.fromkeys(k for r in rows for k in r))
        df = spark.createDataFrame([tuple(None if r.get(k) in (None, "") else str(r[k]) for k in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    else:
        df = spark.read.option("header", True).csv(path)
    names = df.columns
    known = [F.col(f"`{c}`").cast(_TYPES.get(c, "string")).alias("sample_id" if c == "id" else c) if c in names else F.lit(None).cast(_TYPES.get(c, "string")).alias("sample_id" if c == "id" else c) for c in SAMPLE_FIELDS]
    rest = [c for c in names if c not in SAMPLE_FIELDS]
    pairs = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`"))]
    extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return check_samples(df.select(*known, extra.alias("extra")))


def check_samples(samples: DataFrame) -> DataFrame:
    """Ids and given orders of samples need to be unique."""
    r = samples.agg(F.count("*"), F.countDistinct("sample_id"), F.count("order"), F.countDistinct("order")).head()
    if r[0] != r[1] or r[2] != r[3]:
        raise ValueError("sample ids and orders need to be unique")
    return samples


class AssayStore:
    """Assay tables as parquet folders with a snapshot column; patches are appended and merged when read.

    A write of a table replaces one snapshot's folder, so a failed job leaves the others as they were.
    """

    TABLES = ("samples", "rois", "features", "feature_groups", "annotation_patches", "descriptor_patches", "fill_values")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, name: str, df: DataFrame, snapshot: str = "head", append: bool = False) -> None:
        if name not in self.TABLES:
            raise KeyError(name)
        df.write.mode("append" if append else "overwrite").parquet(f"{self.path}/{name}/snapshot_id={snapshot}")

    def snapshots(self, name: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if "=" in s.getPath().getName()) if fs.exists(p) else []

    def get(self, name: str, snapshot: str = "head") -> DataFrame:
        if snapshot not in self.snapshots(name):
            raise KeyError(f"{name} has no snapshot {snapshot!r}")
        return self.spark.read.parquet(f"{self.path}/{name}/snapshot_id={snapshot}")

    def create_snapshot(self, snapshot: str) -> None:
        """Copy the head of every table, feature groups too."""
        for t in self.TABLES:
            if "head" in self.snapshots(t):
                if snapshot in self.snapshots(t):
                    raise ValueError(f"there is a snapshot {snapshot!r} already")
                self.put(t, self.get(t), snapshot)

    def reset(self, snapshot: str) -> None:
        """Make a snapshot the head again."""
        for t in self.TABLES:
            if snapshot in self.snapshots(t):
                self.put(t, self.get(t, snapshot), "head")

    def features(self, snapshot: str = "head", sample_ids: list | None = None, groups: list | None = None, columns: list[str] | None = None) -> DataFrame:
        """Features with their patches, filtered and pruned before they are read."""
        out = self.get("features", snapshot)
        for t, name in (("annotation_patches", "field"), ("descriptor_patches", "descriptor")):
            if snapshot in self.snapshots(t):
                out = apply_patches(out, self.get(t, snapshot), "feature_id", name)
        if sample_ids is not None:
            out = out.where(F.col("sample_id").isin(sample_ids))
        if groups is not None:
            out = out.where(F.col("group").isin(groups))
        return out if columns is None else out.select(*columns)

    def fill_values(self, snapshot: str = "head") -> DataFrame:
        """The latest fill value of each cell."""
        f = self.get("fill_values", snapshot)
        return f.groupBy("sample_id", "group").agg(F.max_by("value", "seq").alias("value")) if "seq" in f.columns else f

    def counts(self, snapshot: str = "head") -> dict[str, int]:
        return {t: self.get(t, snapshot).count() for t in ("samples", "rois", "features") if snapshot in self.snapshots(t)}


def array_to_json(a) -> str:
    """An array as JSON with its dtype, shape and base64 bytes."""
    import base64
    import json

    import numpy as np

    a = np.asarray(a)
    return json.dumps({"dtype": a.dtype.str, "shape": list(a.shape), "data": base64.b64encode(a.tobytes()).decode()})


def json_to_array(text: str):
    import base64
    import json

    import numpy as np

    d = json.loads(text)
    return np.frombuffer(base64.b64decode(d["data"]), d["dtype"]).reshape(d["shape"])


