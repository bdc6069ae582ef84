"""Signals, peaks, raw data, matching, annotation, assay operations, chemistry, simulation, sources and streaming."""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionlake.functions import chem, columns, peaks, signal, simulate
from ionlake.operators import annotation, assay, joins, matching, raw, sample
from ionlake.plans import raw_queries as Q
from ionlake.plans.pipeline import Pipeline
from ionlake.plans.status import SampleStatus, StatusError
from ionlake.sources import mzml, tables
from ionlake.streaming import chromatograms


# -- signals ----------------------------------------------------------------------------------------------------------


def bell(n, *at, width=5.0, height=100.0):
    x = np.arange(n)
    return sum(height * np.exp(-0.5 * ((x - a) / width) ** 2) for a in at)


def test_maxima_prominence_and_distance():
    assert signal.local_maxima(np.array([0, 1, 1, 1, 0, 2, 0, 3])).tolist() == [2, 5]
    x = np.array([0, 5, 1, 3, 0, 9, 0], float)
    assert signal.prominences(x, np.array([1, 3, 5])).tolist() == [5, 2, 9]
    assert signal.find_peaks(x, 2.5).tolist() == [1, 5]
    assert signal.find_peaks(x, 0, distance=3).tolist() == [1, 5]
    assert signal.local_maxima(np.zeros(2)).tolist() == []


def test_smooth_and_noise():
    assert np.allclose(signal.smooth(np.full(30, 4.0), 2), 4) and len(signal.smooth(np.arange(5.0), 3)) == 5
    r = np.random.default_rng(0)
    assert abs(signal.estimate_noise(r.normal(0, 2, 4000)).mean() - 2) < 1.0
    assert signal.estimate_noise(np.zeros(50)).tolist() == [0] * 50
    assert len(set(signal.estimate_noise(r.normal(size=1050), 200, 5).tolist())) == 5


@pytest.mark.parametrize("at, n", [((100,), 1), ((60, 140), 2), ((90, 108), 2)])
def test_detect_peaks(at, n):
    r = np.random.default_rng(3)
    x = bell(200, *at) + r.normal(0, 0.5, 200) + 10
    noise = signal.estimate_noise(x)
    base = signal.estimate_baseline(signal.smooth(x, 1), noise)
    base = np.minimum(base, x)
    s, a, e = signal.detect_peaks(x, noise, base)
    big = [k for k in range(len(a)) if x[a[k]] > 50]
    assert len(big) == n and all(s[k] < a[k] < e[k] for k in range(len(a))) and all(abs(a[k] - p) <= 3 for k, p in zip(big, at))


def test_centroids():
    mz = np.arange(100, 101, 0.002)
    prof = sum(h * np.exp(-0.5 * ((mz - c) / 0.006) ** 2) for c, h in ((100.2, 50), (100.6, 90)))
    m, a = signal.find_centroids(mz, prof + np.random.default_rng(1).normal(0, 0.01, len(mz)))
    top = m[np.argsort(a)[-2:]]
    assert np.allclose(np.sort(top), [100.2, 100.6], atol=0.002)


def test_peak_descriptors(spark):
    n, lo, hi = 201, 90, 111
    spint = [11.0 if lo <= i < hi else 1.0 for i in range(n)]
    row = ("p", [200.0] * n, spint, [float(i) for i in range(n)], list(range(n)), [2.0] * n, [1.0] * n, 90, 100, 111)
    df = spark.createDataFrame([row], "feature_id string, mz array<double>, spint array<double>, time array<double>, scan array<int>, noise array<double>, baseline array<double>, start int, apex int, `end` int")
    r = peaks.with_descriptors(df).head()
    assert (r.peak_mz, r.height, r.snr, r.extension, r.area, r.rt, r.mz_std, r.rt_start, r.rt_end) == (200, 10, 5, 20, 200, 100, 0, 90, 110)
    t, h = np.arange(90, 111.0), np.full(21, 10.0)
    c = np.r_[0, np.cumsum((h[1:] + h[:-1]) / 2)]
    assert r.width == t[np.searchsorted(c, 0.975 * 200)] - t[np.searchsorted(c, 0.025 * 200)]
    none = peaks.with_descriptors(df.withColumn("noise", F.transform("noise", lambda x: F.lit(0.0))).withColumn("spint", F.col("baseline"))).head()
    assert math.isnan(none.snr) and math.isnan(none.width) and math.isnan(none.rt) and none.area == 0


def test_compare_and_envelope():
    x = bell(60, 30)
    p = {"spint": x, "baseline": np.zeros(60), "mz": np.full(60, 100.0), "scan": np.arange(60), "time": np.arange(60.0), "start": 15, "end": 46}
    q = p | {"spint": x / 4, "mz": np.full(60, 101.0)}
    assert abs(peaks.compare(p, q) - 1) < 1e-9 and peaks.compare(p, q) == peaks.compare(q, p)
    assert peaks.compare(p, p | {"scan": np.arange(60) + 25}) == 0
    m, a = peaks.isotopic_envelope([p, q])
    assert np.allclose(m, [100, 101]) and np.allclose(a, [0.8, 0.2])


def test_array_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "a array<double>")
    pick = lambda x: df.select(columns.find_closest(F.col("a"), F.lit(x)).alias("k")).head().k
    assert [pick(x) for x in (0.0, 1.5, 2.9, 3.0, 9.0)] == [0, 1, 1, 2, 2]
    g = df.select(columns.gaussian_mixture(F.lit(1.0), [(1.0, 1.0, 2.0), (3.0, 1.0, 1.0)]).alias("g")).head().g
    assert abs(g - (2 + math.exp(-2))) < 1e-12


# -- raw data ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def simulated(spark):
    samples, spectra = Q.simulated(spark, 3)
    return samples, spectra.persist()


def test_simulated_sample(simulated):
    samples, spectra = simulated
    assert spectra.count() == 120
    rois = raw.extract_rois(spectra)
    assert {r["count"] for r in rois.groupBy("sample_id").count().collect()} == {6}
    assert {r["count"] for r in raw.extract_rois(spectra, min_intensity=2000).groupBy("sample_id").count().collect()} == {1}
    t = raw.extract_rois(spectra, targeted_mz=[848.783, 500.0]).collect()
    assert len(t) == 3 and all(abs(r.mz[0] - 848.783) < 0.01 for r in t)
    tic, bpi = raw.tic(spectra), raw.tic(spectra, "bpi").withColumnRenamed("intensity", "b")
    assert tic.join(bpi, ["sample_id", "scan"]).where("b > intensity or b < 0").count() == 0


def test_chromatograms_equal_plain_sums(spark, simulated):
    _, spectra = simulated
    pts = raw.explode_points(spectra)
    got = raw.chromatograms(pts, spectra, [848.78, 2500.0], 0.05).collect()
    assert len(got) == 3 * 40 * 2 and all(r.intensity == 0 for r in got if r.target == 1)
    want = {(r.sample_id, r.scan): sum(i for m, i in zip(r.mz, r.intensity) if 848.73 <= m < 848.83) for r in spectra.collect()}
    assert all(abs(r.intensity - want[r.sample_id, r.scan]) < 1e-9 for r in got if r.target == 0)
    gaps = raw.chromatograms(pts, spectra, [2500.0], 0.05, fill_missing=False).collect()
    assert all(math.isnan(r.intensity) for r in gaps)
    assert raw.tic_points(pts, spectra).where("intensity > 0").count() > 0
    assert raw.select_scans(spectra, 1, 5.0, 7.0).count() == 6


def spectra_of(spark, scans):
    return spark.createDataFrame([("s", k, float(k), m, i) for k, (m, i) in enumerate(scans)], "sample_id string, scan int, time double, mz array<double>, intensity array<double>")


def test_roi_rules(spark):
    base = [([100.0, 200.0], [5.0, 7.0])] * 3 + [([100.0], [5.0])] * 2 + [([100.0, 200.0], [5.0, 7.0])] * 3
    df = spectra_of(spark, base)
    got = {round(r.mz[0]): r for r in raw.extract_rois(df, max_missing=2, min_length=2).collect()}
    assert len(got[200].mz) == 8 and got[200].spint[3] == 7.0
    assert sorted(len(r.mz) for r in raw.extract_rois(df, max_missing=1, min_length=2).collect()) == [3, 3, 8]
    two = spectra_of(spark, [([100.0], [1.0])] + [([100.001, 100.004], [2.0, 3.0])] * 3)
    one = raw.extract_rois(two, min_length=1).collect()
    assert len(one) == 1 and one[0].spint[1:] == [5.0] * 3
    assert len(raw.extract_rois(two, min_length=1, multiple_match="closest").collect()) == 2
    pad = raw.extract_rois(spectra_of(spark, [([], [])] * 2 + [([100.0], [4.0]), ([100.0], [3.0])] + [([], [])] * 3), min_length=1, pad=2).head()
    assert pad.scan == [0, 1, 2, 3, 4, 5] and pad.spint == [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]
    with pytest.raises(ValueError):
        raw.extract_rois(df, multiple_match="none")
    assert np.allclose(raw.seed_mz(np.array([100.0, 100.001, 100.002, 100.5]), 0.01), [100.001, 100.5])


def test_accumulation(spark):
    scans = [([100.0, 200.0], [1.0, 5.0])] * 2 + [([100.0, 200.0], [4.0, 5.0])] * 2 + [([200.0], [5.0])]
    df = spectra_of(spark, scans)
    c = raw.accumulate_centroid(df, 2, 4, 0, 5).collect()
    assert len(c) == 1 and abs(c[0].mz - 100) < 1e-9 and c[0].intensity == 6
    g = raw.accumulate_grid(raw.explode_points(df), 2, 4, 0, 5).collect()
    assert [(r.mz, r.intensity) for r in g] == [(100.0, 6.0)]
    p = raw.accumulate_profile(df, 2, 4, 0, 5).head()
    assert p.mz == [100.0] and p.intensity == [6.0]
    prof = spectra_of(spark, [([float(x) for x in np.arange(100, 101, 0.002)], [float(x) for x in 90 * np.exp(-0.5 * ((np.arange(100, 101, 0.002) - 100.5) / 0.006) ** 2)])])
    cen = raw.centroid_spectra(prof.withColumn("centroid", F.lit(False)), lambda m, i: (m[:1], i[:1])).head()
    assert cen.centroid and len(cen.mz) == 1


# -- joins ------------------------------------------------------------------------------------------------------------


def test_joins_equal_brute_force(spark):
    r = random.Random(2)
    pts = [(i, round(r.uniform(0, 30), 2)) for i in range(200)]
    win = [(k, round(a, 2), round(a + r.uniform(0.1, 4), 2)) for k, a in enumerate(r.uniform(0, 30) for _ in range(30))]
    p, w = spark.createDataFrame(pts, "id int, x double"), spark.createDataFrame(win, "w int, lo double, hi double")
    got = {(q.id, q.w) for q in joins.range_join(p, w, "x", "lo", "hi", 1.0).collect()}
    assert got == {(i, k) for i, x in pts for k, a, b in win if a <= x < b}
    t = [(k, k * 1.5) for k in range(20)]
    near = {q.id: q.t for q in joins.nearest_match(p, spark.createDataFrame(t, "t int, y double"), "x", "y", 0.5).collect()}
    want = {}
    for i, x in pts:
        d, y, k = min((abs(x - y), -y, k) for k, y in t)
        if d <= 0.5:
            want[i] = k
    assert near == want
    g = joins.global_islands(p, "x", 0.3, 3.0).collect()
    xs = sorted(x for _, x in pts)
    start, names = xs[0], {xs[0]: xs[0]}
    for a, b in zip(xs, xs[1:]):
        start = start if b - a <= 0.3 else b
        names[b] = start
    assert all(q.island == names[q.x] for q in g) and len(g) == 200
    e = spark.createDataFrame([(1, float(x), v) for x, v in enumerate([1, 3, 3, 1, 0, 0, 2])], "k int, t double, v int")
    assert [q.extremum for q in joins.local_extrema(e, ["k"], "t", "v").orderBy("t").collect()] == [0, 1, 0, 0, -1, 0, 0]


def test_extrema_keep_null_keys(spark):
    v = [1.0, 3.0, 3.0, 2.0, None, 2.0, 0.0, 5.0, float("nan"), 1.0]
    e = spark.createDataFrame([(k, t, x) for k in (1, None) for t, x in enumerate(v)], "k int, t int, v double")
    for plateaus, want in ((True, [0, 1, 0, 0, 0, 0, -1, 0, 1, 0]), (False, [0, 0, 0, 0, 0, 0, -1, 0, 1, 0])):
        got = joins.local_extrema(e, ["k"], "t", "v", plateaus=plateaus)
        assert got.columns == ["k", "t", "v", "extremum"]
        rows = got.orderBy("k", "t").collect()
        assert [r.extremum for r in rows] == want * 2 and {r.k for r in rows} == {1, None}


def test_extrema_query_takes_no_plateau(spark, tmp_path):
    rows = [(u, f"2024-01-20 0{h}:30:00", x) for u in (1, None) for h, x in enumerate([5.0, 8.0, 8.0, 2.0, 9.0, 1.0])]
    e = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    e.unionByName(e.limit(1).select(F.lit(3).cast("long").alias("user_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), "value")).write.parquet(f"{tmp_path}/events.parquet")
    out = Q.QUERIES["local_extrema"](spark, str(tmp_path)).collect()
    assert {(r.user_id, r.h): r.extremum for r in out} == {(u, h): x for u in (1, None) for h, x in enumerate([0, 0, 0, -1, 1, 0])} | {(3, None): 0}


def test_nearest_match_keeps_repeated_points(spark):
    p = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 1.0), (2, 5.0), (2, 5.0), (3, 9.0)], "id int, x double")
    t = spark.createDataFrame([(7, 1.2), (8, 5.1)], "t int, y double")
    assert sorted((q.id, q.t) for q in joins.nearest_match(p, t, "x", "y", 0.5).collect()) == [(1, 7), (1, 7), (1, 7), (2, 8), (2, 8)]


# -- matching ---------------------------------------------------------------------------------------------------------


def brute_dbscan_core(x, eps, least):
    d = np.abs(x[:, None] - x[None]).max(axis=2) <= eps
    return d, d.sum(axis=1) >= least


def test_dbscan_partition():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 0.3, (60, 2)), r.normal(4, 0.3, (60, 2)), r.uniform(-3, 8, (15, 2))])
    lab = matching.dbscan(x, 0.4, 5)
    near, core = brute_dbscan_core(x, 0.4, 5)
    for i, j in itertools.combinations(np.flatnonzero(core), 2):
        if near[i, j]:
            assert lab[i] == lab[j] >= 0
    for i in np.flatnonzero(~core):
        reach = {lab[j] for j in np.flatnonzero(near[i] & core)}
        assert (lab[i] in reach) if reach else lab[i] == -1
    assert matching.min_samples([10], 0.25) == 2 and matching.min_samples([20, 6], 0.25) == 2


def test_assignment_is_optimal():
    r = np.random.default_rng(6)
    for n, m in ((3, 3), (2, 5), (5, 2), (4, 4)):
        c = r.random((n, m))
        got = sum(c[i, j] for i, j in matching.assign(c))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(a, b)) for a in itertools.combinations(range(n), k) for b in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-12


def features_frame(spark, n=12, seed=7):
    r = np.random.default_rng(seed)
    rows, truth = [], {}
    for g, (mz, rt) in enumerate([(200.0, 50.0), (200.0, 58.0), (350.0, 70.0)]):
        for s in range(n):
            rows.append((f"{g}-{s}", f"s{s}", mz + r.normal(0, 0.001), rt + r.normal(0, 0.6)))
            truth[f"{g}-{s}"] = g
    rows += [(f"x-{k}", "s0", 500.0 + k, 10.0) for k in range(5)]
    return spark.createDataFrame(rows, "feature_id string, sample_id string, mz double, rt double"), truth


def test_matching_finds_species(spark):
    f, truth = features_frame(spark)
    samples = spark.createDataFrame([(f"s{k}", "a" if k % 2 else "b") for k in range(12)], "sample_id string, `group` string")
    for groups in (None, ["a", "b"]):
        got = {r.feature_id: r.group for r in matching.match_features(f, samples, {"mz": 0.01, "rt": 5.0}, 0.5, groups=groups).collect()}
        assert all(got[f"x-{k}"] == -1 for k in range(5))
        by = {}
        for k, g in truth.items():
            if got[k] >= 0:
                by.setdefault(g, set()).add(got[k])
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == 3
        assert sum(v == -1 for v in got.values()) <= 5 + 3


def test_merge_groups(spark):
    rows = [(f"a{k}", f"s{k}", 0, 200.0, 50.0) for k in range(6)] + [(f"b{k}", f"s{k + 6}", 1, 200.002, 51.0) for k in range(3)] + [(f"c{k}", f"s{k}", 2, 200.001, 52.0) for k in range(6)]
    f = spark.createDataFrame(rows, "feature_id string, sample_id string, `group` int, mz double, rt double")
    got = {r.feature_id: r.group for r in matching.merge_groups(f).collect()}
    assert {got[f"a{k}"] for k in range(6)} | {got[f"b{k}"] for k in range(3)} in ({0}, {0, 2}) and len(set(got.values())) == 2


def test_species_count(spark):
    rows = [("c", f"s{k}") for k in range(4)] * 2 + [("c", "s0")] + [("d", "s0")]
    s = spark.createDataFrame([(f"s{k}", "g") for k in range(4)], "sample_id string, `group` string")
    got = {r.cluster: r.species for r in matching.species_count(spark.createDataFrame(rows, "cluster string, sample_id string"), s, 0.5).collect()}
    assert got == {"c": 2}


# -- end to end -------------------------------------------------------------------------------------------------------


def test_end_to_end_ten_by_six(spark):
    data = Q.assay_data(spark)
    m = data.matrix().validate()
    assert m.samples.count() == 10 and m.groups.count() == 6 and m.missing_imputed()
    assert data.status.feature_matched


def test_annotation_and_consensus(spark):
    samples, done = Q.processed(spark, 2, True)
    rows = done.features.select("sample_id", "isotopologue_label", "isotopologue_index", "charge", "mz").orderBy("sample_id", "mz").collect()
    assert [r.isotopologue_index for r in rows] == [0, 1] * 6 and {r.charge for r in rows} == {1}
    assert done.status.isotopologue_annotated
    labels = pd.DataFrame([r.asDict() for r in rows]).groupby("sample_id").isotopologue_label.nunique()
    assert set(labels) == {3}


def test_feature_matching_keeps_the_plan_small(spark):
    data = Q.assay_data(spark, 2, True)
    for df in (data.features, assay.consensus_annotation(data.features), assay.MissingImputer().apply(data).fill):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" not in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted((r.isotopologue_group, r.isotopologue_index, r.charge) for r in assay.consensus_annotation(data.features).collect()) == [(0, 0, 1), (0, 1, 1), (2, 0, 1), (2, 1, 1), (4, 0, 1), (4, 1, 1)]


def test_consensus_rules(spark):
    rows = []
    for s in range(5):
        rows += [(f"s{s}", 0, 0, 0, 1), (f"s{s}", 1, 0, 1, 1), (f"s{s}", 2, 0, 2 if s else 3, 1), (f"s{s}", 3, 0, 4, 1)]
    rows += [("s0", 4, 1, 0, 2), ("s0", 5, 1, 1, 1), ("s0", -1, 2, 1, 1)]
    f = spark.createDataFrame(rows, "sample_id string, `group` int, isotopologue_label int, isotopologue_index int, charge int")
    got = {(r.group, r.isotopologue_group, r.isotopologue_index, r.charge) for r in assay.consensus_annotation(f).collect()}
    assert got == {(0, 0, 0, 1), (1, 0, 1, 1), (2, 0, 2, 1)}  # index 4 is not contiguous; charges 2 and 1 do not link


def test_steps_of_the_finder():
    steps = annotation.step_ranges(["C", "H", "O"], 0.001, 4)
    assert abs(steps[1][0] - 1.00335484) < 1e-9 and steps[2][0] <= 2 * 1.00335484 <= steps[2][1] + 1e-9
    rules = annotation.MMIFinder({"C": (0, 120), "H": (0, 200), "O": (0, 10)}, 2500).rules
    assert any(mi == 1 and b >= 10 for b, mi in rules)


def test_patches_and_groups(spark):
    f = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 4.0), ("c", -1, 9.0), ("d", 2, float("nan"))], "feature_id string, `group` int, area double")
    p = spark.createDataFrame([("a", "group", 5.0, 1, "x"), ("a", "group", 6.0, 2, "y"), ("b", "area", 7.0, 1, "x")], "feature_id string, field string, value double, seq int, snapshot_id string")
    got = {r.feature_id: (r.group, r.area) for r in assay.apply_patches(f, p, "feature_id", "field").collect()}
    assert got["a"] == (6, 2.0) and got["b"] == (1, 7.0) and got["c"] == (-1, 9.0)
    old = {r.feature_id: r.group for r in assay.apply_patches(f, p, "feature_id", "field", snapshots=["x"]).collect()}
    assert old["a"] == 5
    g = {r.group: r.area for r in assay.feature_groups(f, ["area"]).collect()}
    assert g[1] == 3.0 and math.isnan(g[2])
    assert {r.group: r.area for r in assay.feature_groups(f, ["area"], "first").collect()}[1] == 2.0
    assert {r.group: r.area for r in assay.feature_groups(f, ["area"], {"area": F.max}).collect()}[1] == 4.0
    data = assay.AssayData(f, f.select(F.col("feature_id").alias("sample_id")))
    fix = assay.AnnotationPatcher(fn=lambda d: p).apply(data)
    assert fix.features.where("feature_id = 'a'").head().group == 6


def test_matrix_of_features(spark):
    f = spark.createDataFrame([("1", "s0", 0, 5.0), ("2", "s0", 0, 6.0), ("3", "s1", 1, 7.0), ("4", "s1", -1, 1.0)], "feature_id string, sample_id string, `group` int, area double")
    s = spark.createDataFrame([("s0", 0), ("s1", 1)], "sample_id string, `order` int")
    g = spark.createDataFrame([(0,), (1,)], "`group` int")
    cell = lambda m: {(r.sample_id, r.group): r.value for r in m.values.collect()}
    fill = spark.createDataFrame([("s1", 0, 0.5)], "sample_id string, `group` int, value double")
    assert cell(assay.build_matrix(f, s, g, fill)) == {("s0", 0): 11, ("s0", 1): 0, ("s1", 0): 0.5, ("s1", 1): 7}
    assert cell(assay.build_matrix(f, s, g, duplicates="last"))["s0", 0] == 6
    assert math.isnan(cell(assay.build_matrix(f, s, g, missing=float("nan")))["s0", 1])
    with pytest.raises(StatusError):
        assay.MissingImputer().apply(assay.AssayData(f, s))


def test_imputation_recovers_a_removed_peak(spark):
    data = Q.assay_data(spark, 3)
    full = {(r.sample_id, r.group): r.value for r in data.matrix().values.collect()}
    cut = replace(data, features=data.features.where("not (sample_id = 'sample-1' and `group` = 2)"))
    out = assay.MissingImputer().apply(cut)
    got = {(r.sample_id, r.group): r.value for r in out.matrix().values.collect()}
    assert out.fill.count() == 1 and abs(got["sample-1", 2] / full["sample-1", 2] - 1) < 0.05


def test_simulated_queries_ship_the_package(spark, monkeypatch):
    shipped = []
    monkeypatch.setattr(Q, "ship", shipped.append, raising=False)
    Q.simulated(spark, 1)
    assert shipped == [spark]


def test_missing_imputation_query_fits_a_small_driver(spark):
    out = Q.missing_imputation(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and plan.count("Window [") < 10
    row = out.collect()
    assert [(r.sample_id, r.group) for r in row] == [("sample-1", 2)] and row[0].value > 0


def test_snapshots():
    s = assay.Snapshots(1)
    s.create("one")
    s.update(2)
    s.create("two")
    s.update(3)
    s.set("one")
    assert s.get() == 1 and s.list() == ["one", "two"]
    with pytest.raises(ValueError):
        s.update(9)
    s.set("two", reset=True)
    assert s.get() == 2 and s.list() == ["one", "two"]
    for bad in (lambda: s.create("one"), lambda: s.create("head")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        s.set("none")


def test_sample_operators(spark, simulated):
    _, spectra = simulated
    data = sample.SampleData(spectra)
    with pytest.raises(StatusError):
        sample.LCPeakExtractor().apply(data)
    p = Q.sample_pipeline().add_operator(sample.FeatureTransformer(fn=lambda f: f.where("mz < 500")))
    assert p.validate_dataflow(SampleStatus()).feature_extracted
    out = p.apply(data)
    assert out.features.count() == 6 and out.drop_empty_rois().rois.count() == 6
    keep = sample.RoiTransformer(fn=lambda r: r if r["mz"][0] < 400 else None).apply(sample.LCTraceExtractor().apply(data))
    assert keep.rois.count() == 6
    soft = sample.LCTraceSmoother(strength=1.0).apply(keep)
    assert soft.rois.count() == 6
    assert Q.sample_pipeline().steps[2].apply(sample.LCTraceBaselineEstimator(min_slice_size=20).apply(keep)).features.count() == 6
    assert sample.LCPeakExtractor.from_defaults("uplc").bounds["width"] == (4.0, 60.0)
    none = Pipeline("n", [*Q.sample_pipeline().steps[:2], sample.LCPeakExtractor(bounds={"height": (1e9, None)})])
    assert none.apply(data).features.count() == 0


# -- chemistry --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, mass, nominal, charge, out", [("H2O", 18.010565, 18, 0, "H2O"), ("C6H12O6", 180.063388, 180, 0, "C6H12O6"), ("(13C)C5H12O6", 181.066743, 181, 0, "C5(13C)H12O6"), ("Ca(OH)2", 73.968069, 74, 0, "H2CaO2"), ("[C6H12O6]2+", 180.062291, 180, 2, "[C6H12O6]2+"), ("[Cl]-", 34.969401, 35, -1, "[Cl]-"), ("[Na]+", 22.989221, 23, 1, "[Na]+"), ("C(C(CH3)2)3", 118.0, 0, 0, None)])
def test_formulas(text, mass, nominal, charge, out):
    f = chem.Formula(text)
    assert f.charge == charge
    if out:
        assert abs(f.exact_mass() - mass) < 2e-6 and f.nominal_mass() == nominal and str(f) == out and chem.Formula(str(f)) == f


def test_formula_algebra_and_errors():
    a, b = chem.Formula("C6H12O6"), chem.Formula("H2O")
    assert str(a - b) == "C6H10O5" and a + b - b == a and a != b and len({a, chem.Formula("C6H12O6")}) == 1
    for bad in ("Xx2", "C(H2", "C)H", "C6H-", "(99C)2", "c6"):
        with pytest.raises(chem.FormulaError):
            f = chem.Formula(bad)
            if f.charge:
                raise chem.FormulaError("charge")
    with pytest.raises(chem.FormulaError):
        _ = b - a
    own = chem.PeriodicTable(abundances={"C": (0.5, 0.5)})
    assert abs(chem.Formula("C", table=own).isotopic_envelope()[1][1] - 0.5) < 1e-12


def test_envelope_equals_enumeration():
    m, p = chem.Formula("C3O2").isotopic_envelope(5)
    c, o = chem.TABLE.element("C"), chem.TABLE.element("O")
    tot, wm = np.zeros(5), np.zeros(5)
    for combo in itertools.product(c, c, c, o, o):
        k = sum(i.a for i in combo) - 68
        if k < 5:
            q = math.prod(i.p for i in combo)
            tot[k] += q
            wm[k] += q * sum(i.m for i in combo)
    assert np.allclose(p, tot / tot.sum()) and np.allclose(m, wm / tot)
    assert len(chem.Formula("C60H110O6").isotopic_envelope(15, 0.0)[0]) == 15


def test_generator_equals_enumeration():
    bounds = {"C": (0, 8), "H": (0, 12), "N": (0, 3), "O": (0, 4), "S": (0, 1), "13C": (0, 1)}
    gen = chem.FormulaGenerator(bounds)
    iso = gen.isotopes
    for mass, tol in ((89.0477, 0.02), (132.05, 0.05)):
        want = {c for c in itertools.product(*[range(b[0], b[1] + 1) for b in (bounds.get(i.name, bounds.get(i.symbol)) if i.name != "13C" else bounds["13C"] for i in iso)]) if abs(sum(n * i.m for n, i in zip(c, iso)) - mass) <= tol}
        coef, found = gen.generate(mass, tol)
        assert {tuple(map(int, c)) for c in coef} == want and len(want) > 2
    with pytest.raises(ValueError):
        chem.FormulaGenerator({"C": (3, 2)})
    with pytest.raises(ValueError):
        gen.generate(-1, 0.1)


def test_scorer_and_validator():
    gen = chem.FormulaGenerator({"C": (0, 30), "H": (0, 60), "N": (0, 5), "O": (0, 12)})
    for text in ("C12H22O11", "C9H11NO3", "C20H30O2"):
        m, p = chem.Formula(text).isotopic_envelope(4)
        p = p / p.sum()
        top = chem.EnvelopeScorer(gen).score(m, p, 0.005, top=3)
        assert str(top[0][0]) == text and top[0][1] > 0.99 and top == sorted(top, key=lambda x: -x[1])
        v = chem.EnvelopeValidator(gen)
        assert v.validate(m, p) == 4
        assert v.validate([*m[:2], m[2] + 0.5], p[:3] / p[:3].sum()) == 2
    assert chem.EnvelopeScorer(gen, scorer=lambda *a: 0.5).score(m, p, 0.005)[0][1] == 0.5


def test_chemistry_on_frames(spark):
    df = spark.createDataFrame([("H2O",), ("C6H12O6",)], "formula string")
    got = {r.formula: (round(r.exact_mass, 5), r.nominal_mass) for r in chem.formula_mass(df).collect()}
    assert got == {"H2O": (18.01056, 18), "C6H12O6": (180.06339, 180)}
    assert [len(r.env_p) > 2 for r in chem.envelopes(df).collect()] == [True, True]
    f = chem.formula_search(spark.createDataFrame([(180.063388,)], "mass double"), {"C": (0, 10), "H": (0, 20), "O": (0, 10)}, 0.001)
    assert "C6H12O6" in {r.formula for r in f.collect()}


# -- simulation, sources, streaming -----------------------------------------------------------------------------------


def test_simulated_matrix(spark):
    s = simulate.create_samples(spark, [("qc", "a"), ("sample", "b")], 2)
    sp = simulate.Species("[C6H12O6]+", abundance=simulate.AbundanceSpec(10.0), by_group={"b": simulate.AbundanceSpec(20.0)}, n_isotopologues=1, response=simulate.ResponseSpec(1.0, 0.5, 1.0, (1.0, 2.0)))
    got = {r.sample_id: r.value for r in simulate.data_matrix(s, [sp]).collect()}
    late = 0.5 + 0.5 * math.exp(-1)
    assert all(abs(got[f"sample-{k}"] - w) < 1e-9 for k, w in enumerate([10, 20 * late, 20, 40 * late]))
    gone = simulate.data_matrix(s, [replace(sp, abundance=simulate.AbundanceSpec(10.0, 1.0, 0.0), by_group={})])
    assert {r.value for r in gone.collect()} == {0.0}
    grid = simulate.simulate_spectra(s, [sp], 3, grid=[180.06, 180.063, 180.066])
    assert {(r.centroid, len(r.mz)) for r in grid.collect()} == {(False, 3)}
    assert simulate.gaussian_features(5, [(0, 0), (4, 4)]).shape == (10, 2)


@pytest.mark.parametrize("indexed", [True, False])
def test_mzml(spark, tmp_path, indexed):
    specs = [{"time": 60.0 * k, "ms_level": 1 + k % 2, "mz": [100.0 + k, 200.0], "intensity": [1.0, 2.0 + k]} for k in range(6)]
    path = str(tmp_path / "run.mzML")
    mzml.write(path, specs, [{"name": "TIC", "time": [0.0, 60.0], "intensity": [3.0, 4.0]}], indexed, compress=indexed)
    df = mzml.load(spark, path, chunk=2)
    rows = df.orderBy("scan").collect()
    assert [r.mz for r in rows] == [s["mz"] for s in specs] and [round(r.time, 6) for r in rows] == [60.0 * k for k in range(6)]
    assert df.where("ms_level = 1 and time >= 60 and time < 241").count() == 2 and rows[0].centroid and rows[0].polarity == 1
    c = mzml.load(spark, path, kind="chromatogram").head()
    assert c.name == "TIC" and c.time == [0.0, 60.0] and c.intensity == [3.0, 4.0]
    f = mzml.MZMLFile(path, rebuild_index=True)
    assert (f.n_spectra, f.n_chromatograms) == (6, 1) and f.get_spectrum(3)["mz"].tolist() == [103.0, 200.0]
    with pytest.raises(KeyError):
        mzml.load(spark, path, reader="none")


def test_progenesis(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('"","","","","Normalised abundance","","","Raw abundance","",""\n"","","","","A","","B","A","","B"\n"Compound","m/z","Retention time (min)","Chromatographic peak width (min)","s1","s2","s3","s1","s2","s3"\n"x",200.1,1.5,0.1,10,,30,1,2,3\n"y",100.2,2,0.2,4,5,6,7,8,9\n')
    m = tables.read_progenesis(spark, str(path)).validate()
    assert m.list_sample_field("group") == ["A", "A", "B"] and [r.mz for r in m.groups.orderBy("group").collect()] == [100.2, 200.1]
    assert {(r.sample_id, r.group): r.value for r in m.values.collect()}["s2", 1] == 0.0 and m.groups.orderBy("group").head().rt == 120.0
    assert {r.value for r in tables.read_progenesis(spark, str(path), "Raw abundance").values.collect()} == {1, 2, 3, 7, 8, 9}
    with pytest.raises(ValueError):
        tables.read_progenesis(spark, str(path), "Nothing")


@pytest.mark.parametrize("suffix", ["csv", "yaml"])
def test_sample_sheets(spark, tmp_path, suffix):
    path = str(tmp_path / f"s.{suffix}")
    tables.sample_sheet_template(path, ["a", "b"], ["site"])
    assert tables.read_sample_sheet(spark, path).count() == 2
    if suffix == "csv":
        with open(path, "w") as f:
            f.write("id,path,order,type,site\na,/x,0,qc,north\nb,,1,,\n")
    else:
        with open(path, "w") as f:
            f.write("- {id: a, path: /x, order: 0, type: qc, site: north}\n- {id: b, order: 1}\n")
    rows = {r.sample_id: r for r in tables.read_sample_sheet(spark, path).collect()}
    assert rows["a"].extra == {"site": "north"} and rows["b"].extra == {} and rows["b"].type is None and rows["a"].order == 0
    dup = spark.createDataFrame([("a", 1), ("a", 2)], "sample_id string, `order` int")
    with pytest.raises(ValueError):
        tables.check_samples(dup)


def test_assay_store(spark, tmp_path):
    st = tables.AssayStore(spark, str(tmp_path / "store"))
    f = spark.createDataFrame([("a", "s0", 1, 2.0), ("b", "s1", 2, 3.0)], "feature_id string, sample_id string, `group` int, area double")
    p = spark.createDataFrame([("a", "group", 9.0, 1)], "feature_id string, field string, value double, seq int")
    st.put("features", f)
    st.create_snapshot("raw")
    st.put("annotation_patches", p)
    st.put("fill_values", spark.createDataFrame([("s0", 1, 1.0, 1), ("s0", 1, 4.0, 2)], "sample_id string, `group` int, value double, seq int"))
    assert {r.feature_id: r.group for r in st.features().collect()} == {"a": 9, "b": 2} and st.fill_values().head().value == 4.0
    assert {r.feature_id: r.group for r in st.features("raw").collect()} == {"a": 1, "b": 2}
    assert st.features(sample_ids=["s0"], groups=[9], columns=["area"]).collect()[0].area == 2.0
    assert st.snapshots("features") == ["head", "raw"] and st.counts() == {"features": 2}
    st.reset("raw")
    for bad in (lambda: st.get("rois"), lambda: st.put("none", f)):
        with pytest.raises(KeyError):
            bad()
    a = np.arange(6.0).reshape(2, 3)
    assert (tables.json_to_array(tables.array_to_json(a)) == a).all()


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m)) for m in (0, 5, 10, 50, 55)] + [("b", "2024-01-01 02:00:00", 7.0)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "sample_id string, t string, intensity double").select("sample_id", F.to_timestamp("t").alias("ts"), "intensity")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for fn, opts, name in ((chromatograms.streaming_tic, {"window": "30 minutes"}, "tic"), (chromatograms.streaming_traces, {"gap": "20 minutes"}, "traces")):
        q = fn(stream, **opts).writeStream.format("memory").queryName(name).outputMode("complete" if name == "tic" else "append").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.sample_id, r.n) for r in spark.sql("select * from tic").collect()} == {("a", 3), ("a", 2), ("b", 1)}
    assert {(r.sample_id, r.n) for r in chromatograms.streaming_traces(df, "20 minutes").collect()} == {("a", 3), ("a", 2), ("b", 1)}
