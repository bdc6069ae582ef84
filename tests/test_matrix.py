"""Matrix, metrics, transforms, filters and pipelines on small matrices with hand-computed results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.operators import metrics, transform
from ionlake.operators.filters import BlankCorrector, ColumnTransformer, CorrelationFilter, CVFilter, DetectionRateFilter, DRatioFilter, FeatureFilter, Normalizer, RowTransformer, SampleFilter, Scaler
from ionlake.operators.matrix import EmptyMatrixError, Matrix, UnknownFieldError
from ionlake.plans import matrix_queries
from ionlake.plans.pipeline import OPERATORS, Pipeline
from ionlake.plans.status import MatrixStatus, StatusError

NAN = float("nan")


def make(spark, data, types=None, groups=None, status=None):
    n = len(data)
    types, groups = types or ["sample"] * n, groups or ["g"] * n
    samples = spark.createDataFrame([(f"s{i}", types[i], groups[i], i, i // 2) for i in range(n)], "sample_id string, type string, `group` string, `order` int, batch int")
    feats = spark.createDataFrame([(g, 100.0 + g) for g in range(len(data[0]))], "`group` int, mz double")
    values = spark.createDataFrame([(f"s{i}", g, float(x)) for i, row in enumerate(data) for g, x in enumerate(row)], "sample_id string, `group` int, value double")
    return Matrix(values, samples, feats, status or MatrixStatus())


def column(df):
    return {r.group: r.metric for r in df.collect()}


def grid(m):
    ids, groups = m.list_sample_ids(), m.list_groups()
    cell = {(r.sample_id, r.group): r.value for r in m.values.collect()}
    return np.array([[cell[i, g] for g in groups] for i in ids])


def same(a, b):
    assert np.allclose(np.asarray(a, float), np.asarray(b, float), equal_nan=True), (a, b)


def test_cv_edge_cases(spark):
    m = make(spark, [[1, 0, NAN, 1, 3], [1, 0, 2, NAN, 5], [1, 0, NAN, 1, 7]])
    got = column(m.metrics.cv())
    assert got[0] == 0 and math.isnan(got[1]) and math.isnan(got[2]) and got[3] == 0 and abs(got[4] - 0.4) < 1e-12
    robust = column(m.metrics.cv(robust=True))
    assert robust[0] == 0 and math.isnan(robust[1]) and abs(robust[4] - 1.482602218505602 * 2 / 5) < 1e-12
    assert math.isnan(column(make(spark, [[4.0]]).metrics.cv())[0])


def test_detection_dratio_limits(spark):
    m = make(spark, [[1, 5], [NAN, 6], [3, 7], [0, 7]], ["qc", "qc", "sample", "sample"])
    assert column(m.metrics.detection_rate(1.0)) == {0: 0.5, 1: 1.0}
    assert column(metrics.detection_rate(m.values, NAN)) == {0: 0.75, 1: 1.0}
    d = column(m.metrics.dratio())
    assert math.isnan(d[0]) and d[1] == float("inf")
    with pytest.raises(ValueError):
        m.metrics.dratio(qc_types=("none",))
    lod, loq = column(m.metrics.lod("sample")), column(m.metrics.loq("sample"))
    assert abs(lod[0] - (1.5 + 3 * np.std([3, 0], ddof=1))) < 1e-9 and lod[1] == 7 and abs(loq[0] - (1.5 + 10 * np.std([3, 0], ddof=1))) < 1e-9
    assert column(make(spark, [[NAN]]).metrics.lod())[0] == 0.0


@pytest.mark.parametrize("method", metrics.AGGREGATIONS)
def test_aggregate_equals_numpy(spark, method):
    x = np.array([[1, 2, NAN], [4, 8, 1], [7, 1, 2], [2, 2, 2]], float)
    sd = x.std(axis=0, ddof=1)
    want = {"lod": x.mean(axis=0) + 3 * sd, "loq": x.mean(axis=0) + 10 * sd, "sum": x.sum(axis=0), "avg": x.mean(axis=0), "median": np.median(x, axis=0), "min": x.min(axis=0), "max": x.max(axis=0), "std": sd}[method]
    got = column(metrics.aggregate(make(spark, x).values, method))
    same([got[k] for k in range(3)], want)


def test_correlation(spark):
    x = [[0, 5, 1, 2], [1, 4, 1, 8], [2, 3, 1, 8], [3, 2, 1, 9]]
    m = make(spark, x)
    p, s = column(m.metrics.correlation("order")), column(m.metrics.correlation("order", "spearman"))
    assert abs(p[0] - 1) < 1e-12 and abs(p[1] + 1) < 1e-12 and math.isnan(p[2])
    assert abs(p[3] - np.corrcoef([0, 1, 2, 3], [2, 8, 8, 9])[0, 1]) < 1e-12
    assert abs(s[3] - np.corrcoef([1, 2, 3, 4], [1, 2.5, 2.5, 4])[0, 1]) < 1e-12
    with pytest.raises(ValueError):
        m.metrics.correlation("type")
    with pytest.raises(KeyError):
        m.metrics.correlation("nothing")


def test_pca_equals_svd(spark):
    x = np.random.default_rng(1).normal(size=(12, 4))
    fit, scores = make(spark, x).metrics.pca(2)
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    same(fit.variance, s[:2] ** 2 / 11)
    got = np.array([r.score for r in sorted(scores.collect(), key=lambda r: int(r.sample_id[1:]))])
    same(np.abs(got), np.abs(u[:, :2] * s[:2]))
    same(np.abs(fit.loadings), np.abs(vt[:2].T * np.sqrt(s[:2] ** 2 / 11)))
    with pytest.raises(ValueError):
        make(spark, [[1, NAN], [2, 1]]).metrics.pca()


def test_normalize_and_scale(spark):
    x = np.array([[1, 3, NAN], [0, 0, 0], [NAN, NAN, NAN], [2, 2, 4]], float)
    m = make(spark, x)
    with np.errstate(all="ignore"):
        same(grid(Normalizer().apply(m)), [[0.25, 0.75, NAN], [NAN] * 3, [NAN] * 3, [0.25, 0.25, 0.5]])
        same(grid(Normalizer(method="max").apply(m)), [[1 / 3, 1, NAN], [NAN] * 3, [NAN] * 3, [0.5, 0.5, 1]])
        same(grid(Normalizer(method="euclidean").apply(m))[3], np.array([2, 2, 4]) / math.sqrt(24))
        same(grid(Normalizer(method="feature", feature=0).apply(m)), [[1, 3, NAN], [NAN] * 3, [NAN] * 3, [1, 1, 2]])
    y = np.array([[1, 5, 1], [2, 5, NAN], [6, 5, 3]], float)
    s = lambda how: grid(Scaler(method=how).apply(make(spark, y)))
    same(s("autoscaling")[:, 0], (y[:, 0] - 3) / y[:, 0].std())
    same(s("rescaling")[:, 0], [0, 0.2, 1])
    same(s("pareto")[:, 0], (y[:, 0] - 3) / math.sqrt(y[:, 0].std()))
    same(s("autoscaling")[:, 1:], [[NAN, -1], [NAN, NAN], [NAN, 1]])
    for f in (transform.normalize, transform.scale):
        with pytest.raises(ValueError):
            f(m.values, "nothing")


def alternating(spark):
    kinds = [("blank", "a") if i % 2 else ("sample", "b") for i in range(10)]
    return make(spark, [[100, 100] if i % 2 else [1000, 1000] for i in range(10)], [k for k, _ in kinds], [g for _, g in kinds])


def test_blank_correction(spark):
    m = alternating(spark)
    same(grid(BlankCorrector().apply(m)), [[900, 900] if i % 2 == 0 else [100, 100] for i in range(10)])
    same(grid(BlankCorrector(apply_to_blanks=True).apply(m)), [[900, 900] if i % 2 == 0 else [0, 0] for i in range(10)])
    out = grid(BlankCorrector(exclude_samples=("s0",), exclude_groups=(1,), blank_groups=("a",)).apply(m))
    same(out[0], [1000, 1000])
    same(out[2], [900, 1000])
    with pytest.raises(ValueError):
        BlankCorrector().apply(make(spark, [[1], [2]]))
    n = make(spark, [[NAN, -5], [1, 1]], ["sample", "blank"])
    same(grid(BlankCorrector().apply(n)), [[NAN, 0], [1, 1]])


def test_cv_filter(spark):
    kinds = [("qc", "a") if i % 2 else ("sample", "b") for i in range(10)]
    r = np.random.default_rng(0)
    data = [[100.0, 100 + r.normal() * 80] if i % 2 else [100 + r.normal() * 80, 100.0] for i in range(10)]
    m = make(spark, data, [k for k, _ in kinds], [g for _, g in kinds])
    assert CVFilter(ub=0.01).apply(m).list_groups() == [0]
    assert CVFilter(ub=0.01, filter={"group": "b"}).apply(m).list_groups() == [1]
    assert CVFilter(ub=0.01, filter={}, group_by=("group",)).apply(m).list_groups() == [0, 1]
    with pytest.raises(EmptyMatrixError):
        CVFilter(ub=0.01, filter={}, group_by=("group",), aggregation="max").apply(m)
    assert CVFilter(ub=0.01, exclude=(1,)).apply(m).list_groups() == [0, 1]
    with pytest.raises(ValueError):
        CVFilter(lb=1, ub=0)
    with pytest.raises(ValueError):
        CVFilter(filter={"type": "none"}).apply(m)
    assert CVFilter(ub=0.01, robust=False, filter={"type": "qc"}).apply(make(spark, [[NAN], [NAN]], ["qc", "qc"])).list_groups() == [0]  # NaN is kept


@pytest.mark.parametrize(("prices", "kept"), [((100.0, 0.0, 0.0, 0.0), []), ((100.0, 100.0, 130.0, 130.0), ["b"])])
def test_cv_query_without_a_group_left_has_no_rows(spark, tmp_path, prices, kept):
    tables = {
        "supplier": ([(k + 1, 0, 1.0) for k in range(4)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "r")], "r_regionkey int, r_name string"),
        "part": ([(1, "b", 1.0, 1)], "p_partkey long, p_brand string, p_retailprice double, p_size int"),
        "lineitem": ([(1, k + 1, x) for k, x in enumerate(prices) if x], "l_partkey long, l_suppkey long, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = matrix_queries.QUERIES["cv_filter_grouped"](spark, str(tmp_path))
    assert out.columns == ["group"] and [r.group for r in out.collect()] == kept


def test_other_filters(spark):
    r = np.random.default_rng(1)
    kinds = ["qc" if i % 2 else "sample" for i in range(20)]
    m = make(spark, [[500 + r.normal() * (100 if k == "qc" else 10), 500 + r.normal() * (10 if k == "qc" else 100)] for k in kinds], kinds)
    assert DRatioFilter().apply(m).list_groups() == [1]
    with pytest.raises(ValueError):
        DRatioFilter(group_by=("group",))
    d = make(spark, [[10, 0], [10, 10], [10, 0]])
    assert DetectionRateFilter(threshold=5.0).apply(d).list_groups() == [0]
    assert DetectionRateFilter(threshold=0.0).apply(d).list_groups() == [0, 1]
    c = make(spark, [[i, -i] for i in range(8)], status=MatrixStatus(missing_imputed=True))
    assert CorrelationFilter(lb=0.5).apply(c).list_groups() == [0]
    with pytest.raises(StatusError):
        CorrelationFilter(lb=0.5).apply(make(spark, [[1, 2], [2, NAN]]))
    with pytest.raises(EmptyMatrixError):
        CorrelationFilter(lb=0.9999, ub=0.99999).apply(c)
    assert FeatureFilter(bounds={"mz": (100.5, None)}).apply(m).list_groups() == [1]
    with pytest.raises(UnknownFieldError):
        FeatureFilter(bounds={"rt": (0, 1)}).apply(m)
    assert SampleFilter(criteria={"type": "qc", "batch": (0, 1)}).apply(m).samples.count() == 18
    with pytest.raises(EmptyMatrixError):
        SampleFilter().apply(m)


def test_query_and_lookups(spark):
    m = alternating(spark)
    assert m.query.filter(type="blank").fetch_sample_ids() == [((), ["s1", "s3", "s5", "s7", "s9"])]
    assert m.query.group_by("type").fetch_sample_ids()[0] == (("sample",), ["s0", "s2", "s4", "s6", "s8"])
    assert m.query.filter(batch=[0, 1], group="a").group_by("batch", "group").fetch_sample_ids() == [((0, "a"), ["s1"]), ((1, "a"), ["s3"])]
    for bad in (lambda: m.query.filter(none=1), lambda: m.query.group_by("none")):
        with pytest.raises(UnknownFieldError):
            bad()
    assert m.has_sample("s1") and not m.has_sample("x") and m.has_group(1) and not m.has_group(9)
    assert m.get_data(["s0", "s1"], [1]).count() == 2 and m.get_sample("s0").count() == 2 and m.get_feature(0).count() == 10
    with pytest.raises(KeyError):
        m.get_rows("x")
    assert m.list_sample_field("order") == list(range(10)) and m.list_sample_field("none") == [None] * 10
    assert m.submatrix(["s3", "s1"], [0]).list_sample_ids() == ["s1", "s3"]
    assert m.sql("SELECT count(*) c FROM matrix_values JOIN samples USING (sample_id) WHERE type = 'blank'").head().c == 10


def test_changes(spark, tmp_path):
    m = alternating(spark)
    assert m.remove_groups(0).list_groups() == [1] and m.remove_groups(0).validate()
    with pytest.raises(EmptyMatrixError):
        m.remove_groups(0, 1)
    assert m.remove_samples("s0").samples.count() == 9
    same(grid(m.set_columns({1: range(10)}))[:, 1], range(10))
    same(grid(m.set_rows({"s3": [7, 8]}))[3], [7, 8])
    with pytest.raises(ValueError):
        m.set_rows({"s3": [7]})
    with pytest.raises(KeyError):
        m.set_values(spark.createDataFrame([("x", 0, 1.0)], m.values.schema))
    a, b = m.where_samples("batch < 2"), m.where_samples("batch >= 2")
    same(grid(Matrix.combine(a, b)), grid(m))
    with pytest.raises(ValueError):
        Matrix.combine(a, b.remove_groups(0))
    with pytest.raises(ValueError):
        Matrix.combine(a, a)
    same(grid(Matrix.from_dict(spark, m.to_dict())), grid(m))
    m.write_csv(str(tmp_path / "m"))
    same(grid(Matrix.read_csv(spark, str(tmp_path / "m"), m.samples.schema, m.groups.schema)), grid(m))
    assert len(m.wide().columns) == 3
    new = m.get_columns(0).withColumn("group", F.lit(5))
    assert m.add_groups(new, spark.createDataFrame([(5, 1.0)], m.groups.schema)).list_groups() == [0, 1, 5]


def test_vector_transformers(spark):
    m = make(spark, [[1, 2], [3, 4], [5, 6]])
    same(grid(ColumnTransformer(fn=np.cumsum).apply(m)), [[1, 2], [4, 6], [9, 12]])
    same(grid(RowTransformer(fn=np.cumsum, exclude=("s0",)).apply(m)), [[1, 2], [3, 7], [5, 11]])


def test_blank_then_detection_pipeline(spark):
    kinds = ["blank", "qc", "sample", "sample", "qc"]
    ab = {"blank": (200, 10), "qc": (1000, 1000), "sample": (100, 1000)}
    m = make(spark, [ab[k] for k in kinds], kinds)
    p = Pipeline("p").add_operator(BlankCorrector()).add_operator(DetectionRateFilter(threshold=10.0))
    out = p.apply(m)
    assert out.list_groups() == [1] and out.status.corrected


def test_pipelines(spark):
    p = Pipeline("p").add_operator(CVFilter(id="cv", ub=0.3)).add_operator(Pipeline("inner", [Normalizer(id="n")]))
    assert p.list_operator_ids() == ["cv", "inner"] and p.get_operator("cv").ub == 0.3
    again = Pipeline.deserialize(p.serialize())
    assert again == p and p.copy() == p and p.serialize() == again.serialize()
    for bad in (lambda: p.add_operator(CVFilter(id="cv")), lambda: p.add_operator(Pipeline("e"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        p.get_operator("none")
    with pytest.raises(StatusError):
        Pipeline("q").add_operator(CorrelationFilter()).validate_dataflow()
    assert Pipeline("q").add_operator(CorrelationFilter()).validate_dataflow(MatrixStatus(missing_imputed=True)).missing_imputed
    assert {"CVFilter", "BlankCorrector", "LCTraceExtractor"} <= set(OPERATORS) or "CVFilter" in OPERATORS
    from ionlake.operators.sample import LCTraceExtractor

    with pytest.raises(ValueError):
        p.add_operator(LCTraceExtractor())
    assert LCTraceExtractor.from_defaults("qtof-uplc").min_length == 10
    with pytest.raises(ValueError):
        LCTraceExtractor.from_defaults("none")
