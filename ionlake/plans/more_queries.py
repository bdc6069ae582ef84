"""Queries of lookups, vector steps, stores, serialised pipelines and array functions on the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.functions import columns, peaks
from ionlake.operators import raw
from ionlake.operators.filters import BlankCorrector, ColumnFilter, ColumnTransformer, CVFilter, Normalizer, RowFilter, RowTransformer, in_bounds
from ionlake.operators.matrix import Matrix
from ionlake.plans.matrix_queries import BASE, _values, group_table, matrix, read
from ionlake.plans.matrix_queries import ORACLES as _MATRIX_SQL
from ionlake.plans.pipeline import Pipeline
from ionlake.plans.raw_queries import PTS, points, traces
from ionlake.sources.tables import AssayStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def put(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return put


# -- vector steps and filters of one's own ----------------------------------------------------------------------------


@register("vector_columns", BASE + 'SELECT sample_id, g AS "group", round(v - min(v) OVER (PARTITION BY g), 2) AS value FROM m')
def vector_columns(spark, d):
    return _values(ColumnTransformer(fn=lambda x: x - x.min()).apply(matrix(spark, d)).values, 2)


@register("vector_rows", BASE + 'SELECT sample_id, g AS "group", CASE WHEN sample_id = 3 THEN round(v, 6) ELSE round(v / greatest(max(v) OVER (PARTITION BY sample_id), 1), 6) END AS value FROM m')
def vector_rows(spark, d):
    return _values(RowTransformer(fn=lambda x: x / max(x.max(), 1.0), exclude=(3,)).apply(matrix(spark, d)).values)


@dataclass(frozen=True)
class FaintColumns(ColumnFilter):
    """Drops the groups whose mean is under that of all values."""

    def drop_list(self, matrix: Matrix) -> DataFrame:
        mean = matrix.values.agg(F.avg("value").alias("mean"))
        return matrix.values.groupBy("group").agg(F.avg("value").alias("own")).join(F.broadcast(mean), F.col("own") < F.col("mean"))


@dataclass(frozen=True)
class RichRows(RowFilter):
    """Drops the samples with a value over ``limit``."""

    limit: float = 0.0

    def drop_list(self, matrix: Matrix) -> DataFrame:
        return matrix.values.groupBy("sample_id").agg(F.max("value").alias("top")).where(F.col("top") > self.limit)


@register("column_filter", BASE + "SELECT g AS \"group\" FROM m GROUP BY g HAVING avg(v) >= (SELECT avg(v) FROM m) OR g = 'Brand#11'")
def column_filter(spark, d):
    return FaintColumns(exclude=("Brand#11",)).apply(matrix(spark, d)).groups.select("group")


@register("row_filter", BASE + "SELECT sample_id FROM m GROUP BY sample_id HAVING max(v) <= 1500000 OR sample_id = 7")
def row_filter(spark, d):
    return RichRows(exclude=(7,), limit=1_500_000.0).apply(matrix(spark, d)).samples.select("sample_id")


@register("feature_bounds", BASE + 'SELECT g AS "group" FROM feats WHERE mz >= 900 AND size <= 26')
def feature_bounds(spark, d):
    g = group_table(spark, d)
    return g.where(in_bounds(g, {"mz": (900.0, None), "size": (None, 26.0)})).select("group")


# -- lookups ----------------------------------------------------------------------------------------------------------


@register("matrix_lookups", "SELECT 'sample 1' AS what, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1) AS found UNION ALL SELECT 'sample 0', EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 0) UNION ALL SELECT 'group Brand#11', EXISTS (SELECT 1 FROM part WHERE p_brand = 'Brand#11') UNION ALL SELECT 'group none', false")
def matrix_lookups(spark, d):
    m = matrix(spark, d)
    rows = [("sample 1", m.has_sample(1)), ("sample 0", m.has_sample(0)), ("group Brand#11", m.has_group("Brand#11")), ("group none", m.has_group("none"))]
    return spark.createDataFrame(rows, "what string, found boolean")


@register("matrix_listing", BASE + "SELECT (row_number() OVER (ORDER BY ord) - 1)::INT AS place, sample_id, type FROM samples")
def matrix_listing(spark, d):
    m = matrix(spark, d)
    rows = [(i, s, t) for i, (s, t) in enumerate(zip(m.list_sample_ids(), m.list_sample_field("type"), strict=True))]
    return spark.createDataFrame(rows, "place int, sample_id long, type string")


@register("group_listing", "SELECT (row_number() OVER (ORDER BY p_brand) - 1)::INT AS place, p_brand AS \"group\" FROM (SELECT DISTINCT p_brand FROM part)")
def group_listing(spark, d):
    return spark.createDataFrame(list(enumerate(matrix(spark, d).list_groups())), "place int, `group` string")


# -- exchange, stores, pipelines ----------------------------------------------------------------------------------------


@register("matrix_exchange", BASE + "SELECT sample_id, g AS \"group\", round(v, 2) AS value FROM m WHERE sample_id <= 40")
def matrix_exchange(spark, d):
    small = matrix(spark, d).where_samples("sample_id <= 40")
    return _values(Matrix.from_dict(spark, small.to_dict()).values, 2)


@register("pipeline_exchange", _MATRIX_SQL["matrix_pipeline"])
def pipeline_exchange(spark, d):
    """A nested pipeline, written as plain data and read again."""
    inner = Pipeline("filter").add_operator(CVFilter(ub=1.5, robust=False))
    whole = Pipeline("curate").add_operator(BlankCorrector()).add_operator(inner).add_operator(Normalizer())
    again = Pipeline.deserialize(whole.copy().serialize())
    again.validate_dataflow()
    return _values(again.apply(matrix(spark, d)).values).where(~F.isnan("value"))


def _store(spark: SparkSession, d: str) -> AssayStore:
    """Line items as features in a store of the shared warehouse, with patches of two kinds and a snapshot."""
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("feature_id")
    f = line.join(part, line.l_partkey == part.p_partkey).select(key, F.col("l_suppkey").alias("sample_id"), F.col("p_size").alias("group"), F.col("l_extendedprice").alias("area"), F.col("l_quantity").alias("height"))
    store = AssayStore(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/assay-{uuid.uuid4().hex}")
    store.put("features", f)
    store.put("samples", read(spark, d, "supplier").select(F.col("s_suppkey").alias("sample_id"), "s_name"))
    patch = line.where("l_tax = 0").select(key, F.lit("height").alias("descriptor"), F.lit(-1.0).alias("value"), F.lit(1).alias("seq"))
    store.put("descriptor_patches", patch)
    moved = line.where("l_returnflag = 'R'").select(key, F.lit("group").alias("field"), F.lit(0).alias("value"), F.lit(1).alias("seq"))
    store.create_snapshot("first")
    store.put("annotation_patches", moved)
    return store


_STORED = """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS feature_id, l_suppkey AS sample_id, p_size AS g, l_extendedprice AS area, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
low AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_tax = 0), back AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT f.*, CASE WHEN low.id IS NULL THEN l_quantity ELSE -1.0 END AS height, CASE WHEN back.id IS NULL THEN g ELSE 0 END AS moved FROM f LEFT JOIN low ON low.id = feature_id LEFT JOIN back ON back.id = feature_id)
"""


@register("store_features", _STORED + 'SELECT feature_id, moved AS "group", height FROM p WHERE sample_id IN (2, 3, 5) AND moved IN (0, 7, 9)')
def store_features(spark, d):
    return _store(spark, d).features(sample_ids=[2, 3, 5], groups=[0, 7, 9], columns=["feature_id", "group", "height"])


@register("store_snapshot", _STORED + 'SELECT feature_id, g AS "group", area, height FROM p WHERE sample_id = 4')
def store_snapshot(spark, d):
    return _store(spark, d).features("first", sample_ids=[4], columns=["feature_id", "group", "area", "height"])


@register("store_reset", _STORED + "SELECT g AS \"group\", count(*) AS n, round(sum(area), 2) AS area FROM p WHERE sample_id IN (2, 4) GROUP BY 1")
def store_reset(spark, d):
    """The head after it was reset to the snapshot: what was patched later is patched no more."""
    store = _store(spark, d)
    store.put("annotation_patches", store.get("annotation_patches").limit(0))
    store.reset("first")
    return store.features(sample_ids=[2, 4]).groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


@register("store_counts", "SELECT 'samples' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'features', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey")
def store_counts(spark, d):
    return spark.createDataFrame(list(_store(spark, d).counts().items()), "name string, n long")


# -- arrays and peaks -----------------------------------------------------------------------------------------------------

_TARGETS = [900.0, 903.5, 910.0, 925.25, 950.0, 999.0]


@register("closest_target", f"WITH t AS (SELECT unnest({_TARGETS}::DOUBLE[]) AS v), r AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS i FROM t) SELECT p_partkey, i AS place FROM part CROSS JOIN r QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(v - p_retailprice), i DESC) = 1")
def closest_target(spark, d):
    values = F.array(*[F.lit(t) for t in _TARGETS])
    return read(spark, d, "part").select("p_partkey", columns.find_closest(values, F.col("p_retailprice")).alias("place"))


@register("gauss_model", "SELECT p_partkey, round(2 * exp(-0.5 * pow((p_retailprice - 905) / 3, 2)) + 5 * exp(-0.5 * pow((p_retailprice - 950) / 20, 2)), 6) AS model FROM part")
def gauss_model(spark, d):
    model = columns.gaussian_mixture(F.col("p_retailprice"), [(905.0, 3.0, 2.0), (950.0, 20.0, 5.0)])
    return read(spark, d, "part").select("p_partkey", F.round(model, 6).alias("model"))


@register("tic_spectra", PTS + "SELECT sample_id, scan, sum(intensity) AS tic FROM pts GROUP BY ALL")
def tic_spectra(spark, d):
    """Total ion current of whole spectra, arrays of points that belong to one scan."""
    s = points(spark, d).groupBy("sample_id", "scan", "time").agg(F.collect_list("mz").alias("mz"), F.collect_list("intensity").alias("intensity"))
    return raw.tic(s).select("sample_id", "scan", F.col("intensity").alias("tic"))


_PAIR = """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS h, sum(value) AS v FROM events GROUP BY ALL),
k AS (SELECT user_id, day, count(*) AS n, sqrt(sum(v * v)) AS len FROM e GROUP BY ALL HAVING count(*) >= 3),
n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next FROM k),
c AS (SELECT a.user_id, a.day, a.n, a.len, b.n AS m, b.len AS other, count(y.h) AS k, sum(x.v * y.v) AS dot FROM n a JOIN n b ON b.user_id = a.user_id AND b.day = a.next
  JOIN e x ON x.user_id = a.user_id AND x.day = a.day LEFT JOIN e y ON y.user_id = a.user_id AND y.day = b.day AND y.h = x.h GROUP BY ALL)
SELECT user_id, day, round(CASE WHEN k > 0.5 * least(n, m) THEN dot / (len * other) ELSE 0 END, 6) AS similarity FROM c"""


@register("peak_compare", _PAIR)
def peak_compare(spark, d):
    """Each user's day against the next one with a trace, over the hours that both have."""
    t = traces(spark, d).select("user_id", "day", F.struct(F.col("time").alias("scan"), "spint", "baseline", "start", "end").alias("peak"))
    days = t.groupBy("user_id").agg(F.sort_array(F.collect_set("day")).alias("days"))
    after = days.select("user_id", F.posexplode("days").alias("i", "day"), "days").select("user_id", "day", F.get("days", F.col("i") + 1).alias("next")).where("next is not null")
    both = t.join(after, ["user_id", "day"]).join(t.select("user_id", F.col("day").alias("next"), F.col("peak").alias("other")), ["user_id", "next"])

    def run(batches):
        for b in batches:
            value = [peaks.compare(_plain(p), _plain(q)) for p, q in zip(b["peak"], b["other"], strict=True)]
            yield pd.DataFrame({"user_id": b["user_id"], "day": b["day"], "similarity": np.round(np.array(value, float), 6)})

    return both.select("user_id", "day", "peak", "other").mapInPandas(run, f"user_id {t.schema['user_id'].dataType.simpleString()}, day string, similarity double")


def _plain(p) -> dict:
    return p if isinstance(p, dict) else p.asDict()
