"""Matrix queries on the driver's tables: samples are suppliers, groups are brands, values are summed prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators import metrics, transform
from ionlake.operators.filters import BlankCorrector, ColumnFilter, CorrelationFilter, CVFilter, DetectionRateFilter, DRatioFilter, FeatureFilter, Normalizer, SampleFilter
from ionlake.operators.matrix import EmptyMatrixError, Matrix
from ionlake.plans.pipeline import Pipeline
from ionlake.plans.status import MatrixStatus
from ionlake.session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as samples: every fifth a quality control, every tenth (from 1) a blank; their region is the group."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "qc").when(k % 10 == 1, "blank").otherwise("sample")
    out = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return out.select(k.alias("sample_id"), kind.alias("type"), F.col("r_name").alias("group"), k.alias("order"), (k % 3).cast("int").alias("batch"), F.col("s_acctbal").alias("acctbal"))


def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("group")).agg(F.avg("p_retailprice").alias("mz"), F.avg("p_size").alias("size"))


def matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    """The dense matrix; cells without a line item are 0."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    samples, groups = sample_table(spark, sf_dir), group_table(spark, sf_dir)
    cells = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("group")).agg(F.sum("l_extendedprice").alias("value"))
    grid = samples.select("sample_id").crossJoin(groups.select("group"))
    values = grid.join(cells, ["sample_id", "group"], "left").select("sample_id", "group", F.coalesce("value", F.lit(0.0)).alias("value"))
    return Matrix(values, samples, groups, MatrixStatus(missing_imputed=True))


BASE = """
WITH samples AS (
  SELECT s_suppkey AS sample_id, CASE WHEN s_suppkey % 5 = 0 THEN 'qc' WHEN s_suppkey % 10 = 1 THEN 'blank' ELSE 'sample' END AS type,
    r_name AS grp, s_suppkey AS ord, CAST(s_suppkey % 3 AS INT) AS batch, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
feats AS (SELECT p_brand AS g, avg(p_retailprice) AS mz, avg(p_size) AS size FROM part GROUP BY 1),
cells AS (SELECT l_suppkey AS sample_id, p_brand AS g, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
m AS (SELECT s.sample_id, f.g, coalesce(c.v, 0.0)::DOUBLE AS v, s.type, s.grp, s.ord, s.batch, s.acctbal
  FROM samples s CROSS JOIN feats f LEFT JOIN cells c ON c.sample_id = s.sample_id AND c.g = f.g)
"""
MAD = "1.482602218505602::DOUBLE"


def _out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded results with the same names on both sides."""
    return df.select("group", F.round("metric", digits).alias("metric"))


def _values(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("sample_id", "group", F.round("value", digits).alias("value"))


def _kept(step: ColumnFilter, m: Matrix) -> DataFrame:
    """The groups that a filter keeps. A step refuses to leave a matrix without groups; a query then has no rows."""
    try:
        return step.apply(m).groups.select("group")
    except EmptyMatrixError:
        return m.groups.select("group").where(F.lit(False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


@register("matrix_build", BASE + 'SELECT sample_id, g AS "group", round(v, 2) AS value FROM m')
def matrix_build(spark, d):
    return _values(matrix(spark, d).values, 2)


@register("cv_metric", BASE + 'SELECT g AS "group", round(stddev_samp(v) / avg(v), 6) AS metric FROM m GROUP BY g')
def cv_metric(spark, d):
    return _out(matrix(spark, d).metrics.cv())


ROBUST = "med AS (SELECT {k}, median(v) AS c FROM m{w} GROUP BY {k}), mad AS (SELECT {k}, any_value(c) AS c, " + MAD + " * median(abs(v - c)) AS s FROM m JOIN med USING ({k}){w} GROUP BY {k})"


@register("cv_robust", BASE + ", " + ROBUST.format(k="g", w="") + ' SELECT g AS "group", round(s / c, 6) AS metric FROM mad WHERE c <> 0')
def cv_robust(spark, d):
    return _out(matrix(spark, d).metrics.cv(robust=True)).where(~F.isnan("metric"))


@register("cv_filter", BASE + ", " + ROBUST.format(k="g", w=" WHERE type = 'qc'") + ' SELECT g AS "group" FROM mad WHERE c = 0 OR s / c BETWEEN 0 AND 0.25')
def cv_filter(spark, d):
    return CVFilter(ub=0.25).apply(matrix(spark, d)).groups.select("group")


@register("cv_filter_grouped", BASE + ", each AS (SELECT g, grp, stddev_samp(v) / avg(v) AS cv FROM m GROUP BY g, grp) SELECT g AS \"group\" FROM each GROUP BY g HAVING count(*) > count(cv) OR min(cv) BETWEEN 0.1 AND 0.215")
def cv_filter_grouped(spark, d):
    return _kept(CVFilter(lb=0.1, ub=0.215, robust=False, filter={}, group_by=("group",), aggregation="min"), matrix(spark, d))


@register("dratio", BASE + "SELECT g AS \"group\", round(stddev_samp(v) FILTER (type = 'qc') / stddev_samp(v) FILTER (type = 'sample'), 6) AS metric FROM m GROUP BY g")
def dratio(spark, d):
    return _out(matrix(spark, d).metrics.dratio())


_TWO = ", med AS (SELECT g, type, median(v) AS c FROM m GROUP BY g, type), mad AS (SELECT g, type, median(abs(v - c)) AS s FROM m JOIN med USING (g, type) GROUP BY g, type), dr AS (SELECT q.g, q.s / s.s AS d FROM mad q JOIN mad s ON q.g = s.g AND q.type = 'qc' AND s.type = 'sample')"


@register("dratio_robust", BASE + _TWO + 'SELECT g AS "group", round(d, 6) AS metric FROM dr')
def dratio_robust(spark, d):
    return _out(matrix(spark, d).metrics.dratio(robust=True))


@register("dratio_filter", BASE + _TWO + 'SELECT g AS "group" FROM dr WHERE d BETWEEN 0 AND 1')
def dratio_filter(spark, d):
    return DRatioFilter().apply(matrix(spark, d)).groups.select("group")


@register("detection_rate", BASE + 'SELECT g AS "group", round(avg(CASE WHEN v >= 1200000 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS metric FROM m GROUP BY g')
def detection_rate(spark, d):
    return _out(matrix(spark, d).metrics.detection_rate(1_200_000.0))


@register("detection_rate_filter", BASE + ", each AS (SELECT g, grp, avg(CASE WHEN v >= 1000000 THEN 1.0 ELSE 0.0 END) AS r FROM m WHERE type = 'sample' GROUP BY g, grp) SELECT g AS \"group\" FROM each GROUP BY g HAVING min(r) BETWEEN 0.6 AND 1")
def detection_rate_filter(spark, d):
    return DetectionRateFilter(lb=0.6, threshold=1_000_000.0).apply(matrix(spark, d)).groups.select("group")


@register("detection_rate_lod", BASE + ", l AS (SELECT g, avg(v) + 3 * stddev_samp(v) AS lod FROM m WHERE type = 'blank' GROUP BY g) SELECT g AS \"group\", round(avg(CASE WHEN v >= lod THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS metric FROM m JOIN l USING (g) WHERE type = 'sample' GROUP BY g")
def detection_rate_lod(spark, d):
    m = matrix(spark, d)
    values = m.where_samples("type = 'sample'").values.join(m.metrics.lod("blank").withColumnRenamed("metric", "lod"), "group")
    return _out(metrics.detection_rate(values, F.col("lod")))


for _name, _k, _f in (("lod", 3, "lod"), ("loq", 10, "loq")):
    register(_name, BASE + f"SELECT g AS \"group\", round(avg(v) + {_k} * stddev_samp(v), 4) AS metric FROM m WHERE type = 'blank' GROUP BY g")(lambda spark, d, f=_f: _out(getattr(matrix(spark, d).metrics, f)("blank"), 4))

_AGG = {"lod": "avg(v) + 3 * stddev_samp(v)", "loq": "avg(v) + 10 * stddev_samp(v)", "sum": "sum(v)", "avg": "avg(v)", "median": "median(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_samp(v)"}
#: Digits that lie away from ties: values have two, means and medians more.
_DIGITS = {"sum": 2, "min": 2, "max": 2}
for _m, _sql in _AGG.items():
    register(f"aggregate_{_m}", BASE + f'SELECT g AS "group", round({_sql}, {_DIGITS.get(_m, 5)}) AS metric FROM m GROUP BY g')(lambda spark, d, m=_m: _out(metrics.aggregate(matrix(spark, d).values, m), _DIGITS.get(m, 5)))


@register("correlation_pearson", BASE + 'SELECT g AS "group", round(corr(v, acctbal), 6) AS metric FROM m GROUP BY g')
def correlation_pearson(spark, d):
    return _out(matrix(spark, d).metrics.correlation("acctbal"))


_RANKS = ", r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY g ORDER BY acctbal) + (count(*) OVER (PARTITION BY g, acctbal) - 1) / 2.0::DOUBLE AS y FROM m), sp AS (SELECT g, corr(x, y) AS c FROM r GROUP BY g)"


@register("correlation_spearman", BASE + _RANKS + 'SELECT g AS "group", round(c, 6) AS metric FROM sp')
def correlation_spearman(spark, d):
    return _out(matrix(spark, d).metrics.correlation("acctbal", "spearman"))


@register("correlation_filter", BASE + ", c AS (SELECT g, corr(v, ord) AS c FROM m GROUP BY g) SELECT g AS \"group\" FROM c WHERE c BETWEEN -0.05 AND 1")
def correlation_filter(spark, d):
    return CorrelationFilter(lb=-0.05).apply(matrix(spark, d)).groups.select("group")


@register("correlation_filter_grouped", BASE + ", c AS (SELECT g, batch, corr(v, acctbal) AS c FROM m WHERE type = 'sample' GROUP BY g, batch) SELECT g AS \"group\" FROM c GROUP BY g HAVING max(c) BETWEEN -1 AND 0.2")
def correlation_filter_grouped(spark, d):
    return CorrelationFilter(ub=0.2, field_name="acctbal", group_by=("batch",), filter={"type": "sample"}, aggregation="max").apply(matrix(spark, d)).groups.select("group")


_NORM = {"sum": "sum(v) OVER w", "max": "max(v) OVER w", "euclidean": "sqrt(sum(v * v) OVER w)", "feature": "max(v) FILTER (g = 'Brand#11') OVER w"}
for _m, _sql in _NORM.items():
    register(f"normalize_{_m}", BASE + f', n AS (SELECT sample_id, g, v, {_sql} AS d FROM m WINDOW w AS (PARTITION BY sample_id)) SELECT sample_id, g AS "group", round(v / d, 6) AS value FROM n WHERE d <> 0')(
        lambda spark, d, m=_m: _values(transform.normalize(matrix(spark, d).values, m, "Brand#11")).where(~F.isnan("value"))
    )
_SCALE = {"autoscaling": "(v - avg(v) OVER w) / stddev_pop(v) OVER w", "rescaling": "(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)", "pareto": "(v - avg(v) OVER w) / sqrt(stddev_pop(v) OVER w)"}
for _m, _sql in _SCALE.items():
    register(f"scale_{_m}", BASE + f'SELECT sample_id, g AS "group", round({_sql}, 4) AS value FROM m WINDOW w AS (PARTITION BY g)')(lambda spark, d, m=_m: _values(transform.scale(matrix(spark, d).values, m), 4))


@register("blank_correct", BASE + ", b AS (SELECT g, avg(v) AS b FROM m WHERE type = 'blank' GROUP BY g) SELECT sample_id, g AS \"group\", round(greatest(v - CASE WHEN type = 'blank' THEN 0 ELSE b END, 0), 6) AS value FROM m JOIN b USING (g)")
def blank_correct(spark, d):
    return _values(BlankCorrector().apply(matrix(spark, d)).values)


@register("sample_filter", BASE + "SELECT sample_id, g AS \"group\", round(v, 2) AS value FROM m WHERE NOT (type IN ('blank', 'qc') AND batch = 1) OR sample_id = 10")
def sample_filter(spark, d):
    return _values(SampleFilter(criteria={"type": ("blank", "qc"), "batch": 1}, exclude=(10,)).apply(matrix(spark, d)).values, 2)


@register("feature_filter", BASE + 'SELECT sample_id, m.g AS "group", round(v, 2) AS value FROM m JOIN feats f ON f.g = m.g WHERE f.mz >= 900 AND f.size BETWEEN 25.5 AND 40')
def feature_filter(spark, d):
    return _values(FeatureFilter(bounds={"mz": (900.0, None), "size": (25.5, 40.0)}).apply(matrix(spark, d)).values, 2)


@register("query_filter_groupby", BASE + "SELECT grp AS \"group\", batch, list(sample_id ORDER BY ord)::VARCHAR AS sample_ids FROM samples WHERE type IN ('sample', 'qc') GROUP BY grp, batch")
def query_filter_groupby(spark, d):
    out = matrix(spark, d).query.filter(type=["sample", "qc"]).group_by("group", "batch").sample_groups()
    return out.select("group", "batch", F.concat(F.lit("["), F.concat_ws(", ", F.col("sample_ids").cast("array<string>")), F.lit("]")).alias("sample_ids"))


@register("submatrix", BASE + "SELECT sample_id, g AS \"group\", round(v, 2) AS value FROM m WHERE sample_id IN (1, 5, 9) AND g IN ('Brand#11', 'Brand#23')")
def submatrix(spark, d):
    return _values(matrix(spark, d).submatrix([1, 5, 9], ["Brand#11", "Brand#23"]).values, 2)


@register("remove_features", BASE + "SELECT DISTINCT g AS \"group\" FROM m WHERE g NOT IN ('Brand#11', 'Brand#23')")
def remove_features(spark, d):
    return matrix(spark, d).remove_groups("Brand#11", "Brand#23").groups.select("group")


@register("set_values", BASE + "SELECT sample_id, g AS \"group\", CASE WHEN g = 'Brand#11' THEN -1.0 ELSE round(v, 2) END::DOUBLE AS value FROM m")
def set_values(spark, d):
    m = matrix(spark, d)
    return _values(m.set_values(m.get_columns("Brand#11").withColumn("value", F.lit(-1.0))).values, 2)


@register("combine", BASE + "SELECT sample_id, g AS \"group\", round(v, 2) AS value FROM m WHERE batch <> 2")
def combine(spark, d):
    m = matrix(spark, d)
    return _values(Matrix.combine(m.where_samples("batch = 0"), m.where_samples("batch = 1")).values, 2)


@register("matrix_sql", BASE + "SELECT type, count(*) AS n, round(avg(v), 6) AS mean FROM m GROUP BY type")
def matrix_sql(spark, d):
    return matrix(spark, d).sql("SELECT type, count(*) AS n, round(avg(value), 6) AS mean FROM matrix_values JOIN samples USING (sample_id) GROUP BY type")


@register("matrix_pipeline", BASE + """, b AS (SELECT g, avg(v) AS b FROM m WHERE type = 'blank' GROUP BY g),
c AS (SELECT m.*, greatest(v - CASE WHEN type = 'blank' THEN 0 ELSE b END, 0) AS w FROM m JOIN b USING (g)),
k AS (SELECT g FROM c WHERE type = 'qc' GROUP BY g HAVING stddev_samp(w) / avg(w) BETWEEN 0 AND 1.5 OR avg(w) = 0),
n AS (SELECT sample_id, g, w, sum(w) OVER (PARTITION BY sample_id) AS t FROM c WHERE g IN (SELECT g FROM k))
SELECT sample_id, g AS "group", round(w / t, 6) AS value FROM n WHERE t <> 0""")
def matrix_pipeline(spark, d):
    p = Pipeline("curate").add_operator(BlankCorrector()).add_operator(CVFilter(ub=1.5, robust=False)).add_operator(Normalizer())
    p.validate_dataflow()
    return _values(p.apply(matrix(spark, d)).values).where(~F.isnan("value"))


@register("pca_variance")
def pca_variance(spark, d):
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    fit = metrics.pca(rows, "x", 64, 5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(fit.variance)], "component int, variance double")


@register("pca_scores")
def pca_scores(spark, d):
    m = matrix(spark, d)
    _, scores = m.metrics.pca(3, scaling="autoscaling")
    return scores.select("sample_id", *[F.round(F.get("score", F.lit(i)), 6).alias(f"pc{i + 1}") for i in range(3)])
