import math

import pytest
from pyspark.sql import functions as F

from columnaut.functions import tails
from columnaut.operators import anomalies, drift, meta, multivariate, plots, schema, summaries
from columnaut.plans.columns import normalised
from columnaut.plans.fused import quantiles


def by(frame, key="column"):
    return {r[key]: r for r in frame.collect()}


def frame(spark, ddl, rows):
    return normalised(spark.createDataFrame(rows, ddl))


@pytest.fixture(scope="module")
def odd(spark):
    """Every kind of column, nulls everywhere, awkward names."""
    rows = [(1, None, None, "a", None, [1], {"k": 1}, b"x", True, None), (2, float("nan"), -0.0, None, None, None, None, None, None, None), (2, 1.5, 0.0, "a", None, [1], {"k": 1}, b"x", False, None)]
    ddl = "`a.b` int, x double, z double, s string, n string, arr array<int>, m map<string,int>, bin binary, flag boolean, d date"
    return frame(spark, ddl, rows)


def test_every_operator_takes_odd_columns_and_empty_tables(spark, odd):
    for df in (odd, odd.limit(0), odd.select("n"), odd.select("arr", "m")):
        for op in (
            summaries.dataset_shape, summaries.null_counts, summaries.null_patterns, summaries.missing_cells, summaries.missing_together, summaries.summarize_numeric, summaries.unique_counts,
            summaries.modes, summaries.value_counts, summaries.boolean_fields, summaries.text_fields, summaries.length_stats, summaries.entropy, anomalies.skewness, anomalies.outliers, anomalies.zeros,
            anomalies.near_zero_variance, anomalies.bimodal, anomalies.dominant_values, anomalies.constant_columns, anomalies.high_cardinality, anomalies.id_columns, anomalies.duplicate_rows,
            anomalies.duplicate_columns, anomalies.encoded_columns, schema.infer_types, schema.datetime_consistency, schema.mixed_types, schema.out_of_bounds, multivariate.correlations,
            multivariate.collinear_features, multivariate.reliability_flags, multivariate.binning_suggestions, meta.infer_stage, plots.histogram, plots.boxplot,
        ):
            op(df).collect()


def test_nulls(spark, odd):
    got = by(summaries.null_counts(odd))
    assert {c: got[c].null_count for c in ("a.b", "x", "s", "n", "arr")} == {"a.b": 0, "x": 2, "s": 1, "n": 3, "arr": 1}
    assert got["n"].high_null and not got["s"].high_null
    t = frame(spark, "a int, b int, c int", [(None, None, 1), (1, None, 1), (None, 1, 1), (1, 1, 1)])
    assert {r.pattern: r.n for r in summaries.null_patterns(t).collect()} == {"110": 1, "010": 1, "100": 1, "000": 1}
    assert summaries.missing_cells(t).first()[0] == 4
    assert {(r.a, r.b): r.n for r in summaries.missing_together(t).collect()} == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_quantiles_equal_definition(spark, n):
    import random

    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 5), 1.0, 2.0]) for _ in range(n)]
    df = frame(spark, "v double, w double", [(v, None) for v in values])
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = by(quantiles(df, ["v", "w"], probabilities, few=50, accuracy=100))
    s = sorted(values)
    want = [s[math.floor(p * (n - 1))] + (s[math.ceil(p * (n - 1))] - s[math.floor(p * (n - 1))]) * (p * (n - 1) % 1) for p in probabilities]
    assert got["v"].n == n and got["v"].q == pytest.approx(want)
    assert got["w"].n == 0 and got["w"].q is None


def test_numeric_summary(spark):
    t = frame(spark, "a int, b int, c int, e int", [(i + 1, 10, 100 * (i + 1), None) for i in range(5)])
    got = by(summaries.summarize_numeric(t))
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].p50, got["a"].p25, got["c"].max, got["a"].mean) == (3, 2, 500, 3)
    assert got["b"].near_zero_variance and not got["a"].near_zero_variance and got["a"].std == pytest.approx(math.sqrt(2.5))
    approx = by(summaries.summarize_numeric(t, exact=False))
    assert approx["a"].p50 == 3


def test_unique_modes_counts(spark):
    t = frame(spark, "a int, b string, c boolean, e int", [(1, "x", True, None), (2, "x", False, None), (2, "y", True, None), (3, "z", False, None)])
    assert {c: r.n_unique for c, r in by(summaries.unique_counts(t)).items()} == {"a": 3, "b": 3, "c": 2, "e": 0}
    assert {c: r.n_unique for c, r in by(summaries.unique_counts(t, count_nulls=True)).items()}["e"] == 1
    assert {c: r.n_unique for c, r in by(summaries.unique_counts(t, approximate=True)).items()}["a"] == 3
    modes = {(r.column, r.value) for r in summaries.modes(frame(spark, "x int", [(1,), (1,), (2,), (2,), (3,)])).collect()}
    assert modes == {("x", "1"), ("x", "2")}
    top = summaries.value_counts(frame(spark, "v string", [("a",), ("a",), (None,), (None,), ("b",), ("c",)]), top_k=3).collect()
    assert sorted((r.value or "", r.n) for r in top) == [("", 2), ("a", 2), ("b", 1)]


def test_boolean_and_text(spark):
    t = frame(spark, "f boolean, i int, n int, s string", [(True, 1, 5, "a b!"), (None, 0, 1, "ccc"), (False, None, 2, None), (True, 1, 3, "é😀")])
    got = by(summaries.boolean_fields(t))
    assert set(got) == {"f", "i"} and got["f"].pct_null == 0.25 and got["f"].pct_true == 0.5 and got["i"].pct_false == 0.25
    text = by(summaries.text_fields(t))["s"]
    assert text.total_chars == 9 and text.contains_symbols and text.avg_char_length == 3 and text.avg_word_length == 9 / 4 and text.most_frequent_value == "a b!"
    lengths = by(summaries.length_stats(t))["s"]
    assert (lengths.min_length, lengths.max_length, lengths.mean_length) == (2, 4, 3)


def test_head_tail_entropy(spark):
    t = frame(spark, "a int", [(i,) for i in range(10)])
    assert [r.a for r in summaries.sample_head(t, 3, ["a"]).collect()] == [0, 1, 2]
    assert [r.a for r in summaries.sample_tail(t, 3, ["a"]).collect()] == [7, 8, 9]
    assert summaries.sample_tail(t, 0, ["a"]).count() == 0 and summaries.sample_tail(t, 0).count() == 0 and summaries.sample_tail(t, 99).count() == 10
    assert by(summaries.entropy(frame(spark, "c string", [("x",)] * 4)))["c"].entropy == 0.0
    assert by(summaries.entropy(frame(spark, "c string", [("x",), ("y",)] * 4)))["c"].entropy == pytest.approx(1.0)


def test_types(spark):
    rows = [(i, i % 2, i % 2 == 0, f"2024-01-{i % 28 + 1:02d}", f"{i:08x}-ab", f"name{i}", "some longer text that goes on and on " + str(i % 3), "ab"[i % 2], None, [i]) for i in range(100)]
    t = frame(spark, "num int, bin int, flag boolean, day string, hexid string, name string, prose string, cat string, nothing string, arr array<int>", rows)
    got = {c: r.semantic_type for c, r in by(schema.infer_types(t)).items()}
    assert got == {"num": "continuous", "bin": "categorical", "flag": "categorical", "day": "datetime", "hexid": "id", "name": "id", "prose": "text", "cat": "categorical", "nothing": "unknown", "arr": "unknown"}


def test_contract(spark):
    t = frame(spark, "seats int, width double, shape string", [(0, 22.0, "round"), (1, -3.0, "oval"), (1, 130.0, None)])
    contract = {"required_columns": ["seats", "price"], "dtypes": {"width": "int", "shape": "str"}, "value_ranges": {"width": {"min": 0, "max": 120}}, "categories": {"shape": ["round", "oval"]}, "surplus": 1}
    got = {tuple(r) for r in schema.validate_schema(t, contract).collect()}
    assert got == {("unknown_key", None, "surplus", None), ("required_columns", "price", "missing", None), ("dtypes", "width", "expected int, found double", None), ("value_ranges", "width", "< 0", 1), ("value_ranges", "width", "> 120", 1), ("categories", "shape", "null", 1)}
    mixed = frame(spark, "a string, b string", [("1", "x"), ("2", "y"), ("2024-01-02", None)])
    assert {tuple(r) for r in schema.validate_schema(mixed, {"mixed_types": ["a", "b"]}).collect()} == {("mixed_types", "a", "datetime beside int", 1)}
    assert schema.validate_schema(t, {}).count() == 0


def test_compare(spark):
    a = frame(spark, "A int, B int, T string", [(1, 2, "x"), (3, None, "y")])
    b = frame(spark, "B int, C int, T int", [(2, 1, 1), (400, 1, 2)])
    got = by(schema.compare_tables(a, b))
    assert {c: r.change for c, r in got.items()} == {"A": "added", "B": "shared", "C": "dropped", "T": "type_mismatch"}
    assert got["B"].missing_flag and got["B"].minmax_flag and not got["B"].unique_flag and got["B"].missing_diff == 0.5


def test_formats(spark):
    t = frame(spark, "email string, day string, mix string, age int", [("a@b.c", "2024-01-01", "1", 20), ("bad", "nope", "2", -1), (None, None, "3.5", 130), ("x@y.z\n", "2024-01-03T10:00:00", "x", 50)])
    bad = by(schema.regex_violations(t, {"email": r"[^@]+@[^@]+\.[a-z]", "none": "x", "mix": "("}))
    assert set(bad) == {"email"} and bad["email"].violations == 2 and bad["email"].examples == ["bad", "x@y.z\n"]
    assert schema.regex_violation_rows(t, "email", r"[^@]+@[^@]+\.[a-z]").count() == 2
    day = by(schema.datetime_consistency(t, ["day"]))["day"]
    assert (day.num_invalid, day.percent_valid) == (2, 50.0)
    kinds = {r.kind: (r.n, r.is_minority) for r in schema.mixed_types(t, ["mix"]).collect()}
    assert kinds == {"int": (2, False), "float": (1, True), "string": (1, True)}
    off = by(schema.out_of_bounds(t))["age"]
    assert (off.violations, off.min_violation, off.max_violation) == (2, -1, 130)


def test_anomalies(spark):
    t = frame(spark, "normal int, skewed int, const int", [(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 2, 5), (5, 100, 5)])
    skew = by(anomalies.skewness(t))
    assert abs(skew["normal"].skewness) < 1e-9 and skew["skewed"].skewness > 1 and skew["const"].skewness == 0 and skew["skewed"].score == 0.6
    out = by(anomalies.outliers(frame(spark, "v int", [(100,), (101,), (99,), (100,), (102,), (98,), (1000,)])))["v"]
    assert out.outlier_count == 1 and out.flagged
    assert anomalies.outlier_rows(frame(spark, "v int, k int", [(1, 1), (2, 2), (1, 3), (2, 4), (99, 5)]), "v").collect()[0].k == 5
    z = by(anomalies.zeros(frame(spark, "a int", [(0,)] * 5 + [(1,)] * 5)))["a"]
    assert (z.zero_count, z.zero_share, z.flagged) == (5, 0.5, False)
    nzv = by(anomalies.near_zero_variance(frame(spark, "c double, v double", [(3.14, float(i)) for i in range(50)])))
    assert set(nzv) == {"c"}
    dom = by(anomalies.dominant_values(frame(spark, "m int, u int", [(1 if i < 97 else i, i) for i in range(100)])))
    assert set(dom) == {"m"} and dom["m"].proportion == 0.97
    k = frame(spark, "a int, b int, c string, g int", [(1, i, "x", None) for i in range(100)])
    assert set(by(anomalies.constant_columns(k))) == {"a", "c"}
    assert set(by(anomalies.high_cardinality(k))) == {"b"} and set(by(anomalies.id_columns(k))) == {"b"}
    assert anomalies.duplicate_rows(frame(spark, "a int, b string", [(1, None), (1, None), (2, "x"), (2, "x"), (3, "y")])).first().duplicate_count == 2
    pairs = anomalies.duplicate_columns(frame(spark, "a int, b int, c int, d bigint", [(1, 1, 3, 1), (None, None, 2, None)])).collect()
    assert [(p.a, p.b) for p in pairs] == [("a", "b")]


def test_bimodal(spark):
    import random

    rng = random.Random(42)
    rows = [(rng.gauss(0, 1) if i % 2 else rng.gauss(5, 1), rng.gauss(0, 1), 1.0) for i in range(400)]
    got = by(anomalies.bimodal(frame(spark, "two double, one double, flat double", rows)))
    assert got["two"].is_bimodal and not got["one"].is_bimodal and "flat" not in got


def test_encoded(spark):
    import base64
    import random
    import uuid

    rng = random.Random(1)
    rows = [(base64.b64encode(rng.randbytes(9)).decode(), rng.randbytes(8).hex(), str(uuid.UUID(int=rng.getrandbits(128))), "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ!?") for _ in range(21)), rng.choice(["anna", "bob"])) for _ in range(40)]
    got = {c: r.encoding for c, r in by(anomalies.encoded_columns(frame(spark, "b64 string, hex string, uid string, hashy string, name string", rows))).items()}
    assert got == {"b64": "base64", "hex": "hex", "uid": "uuid", "hashy": "high_entropy"}


def test_imbalance(spark):
    one = lambda rows, **k: anomalies.class_imbalance(frame(spark, "t int", rows), "t", **k).first()
    assert one([(0,), (1,)] * 50).majority_ratio == 0.5
    r = one([(0,)] * 95 + [(1,)] * 5)
    assert (r.majority_ratio, r.is_imbalanced, r.majority_class, r.n_classes) == (0.95, True, "0", 2)
    assert one([(1,)] * 10).majority_ratio == 1.0
    assert one([]).majority_ratio == 0.0 and not one([]).is_imbalanced


def test_pairs(spark):
    t = frame(spark, "x int, y int, k int, c1 string, c2 string", [(i, 2 * i, 7, "ab"[i % 2], "uv"[i % 2]) for i in range(1, 6)])
    r = {(x.a, x.b): x.r for x in multivariate.correlations(t).collect()}
    assert r["x", "y"] == pytest.approx(1.0) and r["x", "k"] is None
    assert [(x.a, x.b) for x in multivariate.data_leakage(t).collect()] == [("x", "y")]
    v = multivariate.cramers_v(t, yates=False).first()
    assert v.v == pytest.approx(1.0) and v.n == 5 and v.dof == 1
    c = multivariate.cramers_v(t).first()  # expected 3*3/5 etc., after Yates
    o, e = [[3, 0], [0, 2]], [[1.8, 1.2], [1.2, 0.8]]
    assert c.chi2 == pytest.approx(sum((abs(o[i][j] - e[i][j]) - 0.5) ** 2 / e[i][j] for i in (0, 1) for j in (0, 1)))
    vif = by(multivariate.collinear_features(frame(spark, "a double, b double, c double", [(1.0, 2.0, 5.0), (2.0, 4.1, 3.0), (3.0, 6.0, 8.0), (4.0, 7.9, 1.0), (5.0, 10.0, 2.0)])))
    assert vif["a"].flagged and vif["a"].score == 0.85 and vif["c"].vif < 10
    singular = by(multivariate.collinear_features(frame(spark, "a double, b double", [(1.0, 2.0), (2.0, 4.0)])))
    assert singular["a"].vif == math.inf


def test_suggestions(spark):
    rows = [("ab"[i % 2], f"c{i % 20}", f"v{i}", float(i % 2)) for i in range(100)]
    got = by(multivariate.encoding_suggestions(frame(spark, "low string, mid string, high string, y double", rows), target="y"))
    assert got["low"].suggestion == "one-hot + target encoding" and got["mid"].suggestion.startswith("frequency") and got["high"].suggestion.startswith("frequency (high-cardinality)")
    kinds = lambda values: by(multivariate.binning_suggestions(frame(spark, "v int", [(v,) for v in values])))
    assert kinds([1] * 50 + [1000] * 10)["v"].suggestion == "log-transform"
    assert kinds(range(0, 1000, 10))["v"].suggestion == "equal-width"
    assert kinds([10, 11, 12, 13, 14] * 20)["v"].suggestion == "quantile"
    assert not kinds([3] * 20)


def test_reliability(spark):
    f = by(multivariate.reliability_flags(frame(spark, "a double, b double, n double", [(1.0, 1.0, None)] + [(1.0, float(i), 2.0) for i in range(9)] + [(1.0, 1000.0, 1.0)])))
    assert f["a"].n_rows == 10 and f["a"].low_row_count and f["a"].zero_variance and f["b"].extreme_outliers and f["b"].high_skew
    codes = {(r.level, r.code) for r in multivariate.reliability_warnings(frame(spark, "a double, b double", [(1.0, float(i)) for i in range(9)] + [(1.0, 1000.0)])).collect()}
    assert codes == {("strong", "low_row_count"), ("strong", "zero_variance"), ("strong", "extreme_outliers_low_n"), ("strong", "high_skew_low_n")}


def test_tails():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(0, 3) == 1 and tails.chi2_sf(1e4, 2) == pytest.approx(0, abs=1e-12)
    assert tails.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-6)
    # two samples of two: all values of one below the other happens in 2 of 6 orders
    assert tails.ks_two_sample_p(1.0, 2, 2) == pytest.approx(2 / 6)
    assert tails.ks_two_sample_p(0.5, 2, 2) == pytest.approx(1.0)
    assert tails.ks_two_sample_p(1.0, 3, 3) == pytest.approx(2 / 20)
    assert abs(tails.ks_two_sample_p(0.15, 300, 280, 10) - tails.ks_two_sample_p(0.15, 300, 280)) < 0.01


def test_drift(spark):
    import random

    rng = random.Random(0)
    cur = frame(spark, "x double, c string, same int, only int, arr array<int>", [(rng.gauss(0, 1), rng.choice("aaaab"), i % 5, 1, [1]) for i in range(500)])
    ref = frame(spark, "x double, c string, same int, arr array<int>", [(rng.gauss(3, 1), rng.choice("aabbbb"), i % 5, [1]) for i in range(500)])
    got = by(drift.feature_drift(cur, ref))
    assert set(got) == {"x", "c", "same", "arr"}
    assert got["x"].psi > 0.2 and got["x"].severity == "high" and got["x"].ks_p == 0 and got["c"].tvd > 0.2 and got["same"].severity == "low" and got["same"].ks_p == 1 and got["arr"].error
    assert by(drift.psi(cur, ref, ["x"], density=True))["x"].psi != pytest.approx(got["x"].psi)
    assert drift.target_drift(cur, ref, "x").first().drift == "significant"
    assert drift.target_drift(cur, ref, "c").first().drift == "significant"
    assert drift.target_drift(cur, cur, "c").first().drift == "none"
    assert drift.target_drift(cur, ref, "only").count() == 0
    flat = frame(spark, "x double", [(1.0,)] * 5)
    assert drift.psi(flat, flat).first().psi == 0


def test_meta(spark):
    assert meta.infer_stage(frame(spark, "a int, b int", [(1, 2), (3, 4)])).first().stage == "model_ready"
    assert meta.infer_stage(frame(spark, "a int, b string", [(None, None), (1, None)])).first().stage == "raw"
    assert meta.infer_stage(frame(spark, "a string, b string", [("x", "y")])).first().stage == "cleaned"
    assert set(meta.quality_parts([], 0, 0, False, False, 0, 0).values()) == {100.0}
    assert meta.quality_parts([0.5, 0.1], 1, 2, True, True, 3, 2) == {"completeness": 86.0, "consistency": 95.0, "distribution": 70.0, "redundancy": 94.0, "drift": 90.0}
    assert meta.quality_score(frame(spark, "a int, s string", [(i, "word") for i in range(40)])).first().overall >= 90
    runs = frame(spark, "task string, seconds double", [("a", 1.0), ("b", 7.5), ("c", 2.0), ("d", 0.5)])
    assert [(r.task, r.slow) for r in meta.bottlenecks(runs, 2).collect()] == [("b", True), ("c", False)]
    use = meta.resource_usage(runs).first()
    assert (use.task_count, use.total_seconds, use.mean_seconds, use.slow_total) == (4, 11.0, 2.75, False)
    assert meta.resource_usage(runs.limit(0)).first().task_count == 0
    assert meta.recommendation("detect_skewness", {"max_abs_skew": 3}).startswith("Transform")
    assert meta.recommendation("detect_skewness", {}) is None and not meta.holds("__import__('os')", {}) and meta.holds("a > 1 and not b < 0", {"a": 2, "b": 0})


def test_plots(spark):
    t = frame(spark, "v int, k int", [(i, 5) for i in range(60)])
    h = plots.histogram(t, bins=30).where("column = 'v'").orderBy("bin").collect()
    assert [r.n for r in h] == [2] * 30 and plots.histogram(t).where("column = 'k'").agg(F.sum("n")).first()[0] == 60
    b = by(plots.boxplot(frame(spark, "v int", [(i,) for i in range(9)] + [(500,)])))["v"]
    assert b.whisker_high == 8 and b["median"] == 4.5
    assert plots.correlation_matrix(t.withColumn("w", F.col("v") * -1), ["v", "w"]).count() == 4


def test_nan_is_null_in_every_operator(spark):
    """Operators used alone, on tables that no reader has normalised."""
    t = frame(spark, "a double, b float, c int", [(1.0, float("nan"), 1), (float("nan"), 2.0, 2), (3.0, 4.0, 3), (-0.0, 0.0, 4)])
    row = by(summaries.summarize_numeric(t))["a"]
    assert (row["count"], row["max"], row["p50"]) == (3, 3.0, 1.0) and row["mean"] == pytest.approx(4 / 3)
    assert by(summaries.null_counts(t))["a"].null_count == 1 and by(summaries.unique_counts(t))["b"].n_unique == 3
    assert by(anomalies.zeros(t))["a"].zero_count == 1 and by(anomalies.outliers(t))["a"].outlier_count == 0
    assert summaries.dataset_shape(t).first().null_cell_share == round(2 / 12, 4)
    assert {(r.a, r.b): r.r for r in multivariate.correlations(t).collect()}[("a", "c")] is not None
    assert {r.value for r in summaries.modes(t, ["a"]).collect()} == {"0.0", "1.0", "3.0"}


def test_two_values_are_corrected_after_yates(spark):
    now = frame(spark, "c string", [("x",)] * 30 + [("y",)] * 20)
    then = frame(spark, "c string", [("x",)] * 20 + [("y",)] * 30)
    assert by(drift.feature_drift(now, then))["c"].chi2_p == pytest.approx(0.0719, abs=1e-4)
    three = drift.category_drift(now.union(frame(spark, "c string", [("z",)])), then).first()
    assert three.dof == 2


def test_exact_ks_counts_paths():
    import itertools

    for n, m in ((3, 4), (5, 5), (2, 7), (6, 4)):
        for k in range(1, n * m + 1):
            d, out = k / (n * m), 0
            ways = list(itertools.combinations(range(n + m), n))
            for own in ways:
                a = b = far = 0
                for i in range(n + m):
                    a, b = (a + 1, b) if i in own else (a, b + 1)
                    far = max(far, abs(a * m - b * n))
                out += far >= round(d * n * m)
            if k % (n * m // __import__("math").lcm(n, m)) == 0:
                assert tails.ks_two_sample_p(d, n, m) == pytest.approx(out / len(ways))
    assert tails.ks_two_sample_p(0.02, 10_000, 9_999) == pytest.approx(tails.ks_two_sample_p(0.02, 10_001, 9_999), abs=0.002)


def test_quantiles_of_many_rows_with_ties(spark):
    """More rows than are ordered at once, half of them equal."""
    t = spark.range(0, 60_000).selectExpr("if(id % 2 = 0, 7.0D, cast(id * 7919 % 60000 as double)) as v", "cast(id % 3 as int) as w", "cast(null as double) as n")
    rows = sorted(7.0 if i % 2 == 0 else float(i * 7919 % 60000) for i in range(60_000))
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.501, 0.75, 0.99, 1.0)
    want = []
    for p in probabilities:
        x = p * 59_999
        k = int(x)
        want.append(rows[k] + (rows[min(k + 1, 59_999)] - rows[k]) * (x - k))
    for few, accuracy in ((100, 50), (1000, 200), (100_000, 2000)):
        got = by(quantiles(t, ["v", "w", "n"], probabilities, few=few, accuracy=accuracy))
        assert got["v"].q == pytest.approx(want) and got["w"].q[3] == 1.0 and got["n"].q is None and got["n"].n == 0


def test_shared_statistics_are_those_of_the_operators(spark):
    from columnaut.plans.fused import Shared

    t = frame(spark, "a double, b string, c int", [(float(i % 7), "xyz"[i % 3], i) for i in range(50)])
    alone = [sorted(map(tuple, f.collect())) for f in (summaries.unique_counts(t), summaries.summarize_numeric(t), anomalies.outliers(t))]
    with Shared(t) as s:
        assert alone == [sorted(map(tuple, f.collect())) for f in (summaries.unique_counts(t), summaries.summarize_numeric(t), anomalies.outliers(t))]
        assert s._distinct and s._quantiles
    assert Shared.active is None


def test_contingency_tables_of_all_pairs(spark):
    t = frame(spark, "a string, b string, c string, d string", [("x", "p", None, "k"), ("y", "q", None, "k"), ("x", "p", "s", "k"), ("y", "q", None, "k")])
    got = {(r.a, r.b): r for r in multivariate.cramers_v(t, yates=False).collect()}
    assert got[("a", "b")].v == pytest.approx(1.0) and got[("a", "c")].n == 1 and got[("a", "d")].v == 0 and len(got) == 6


def test_wide_tables_by_blocks(spark):
    """Products of blocks agree with the aggregates, nulls and constants and far-off means included."""
    import random

    rng = random.Random(3)
    rows = [tuple(None if rng.random() < 0.1 else 1e6 + rng.gauss(0, 1) for _ in range(5)) + (5.0, None, float(i), float("nan") if i % 9 == 0 else -2.0 * i) for i in range(200)]
    t = frame(spark, ", ".join(f"c{i} double" for i in range(9)), rows).repartition(3)
    both = [{(r.a, r.b): r.r for r in multivariate.correlations(t, by_blocks=x).collect()} for x in (False, True)]
    assert both[0].keys() == both[1].keys()
    for k, v in both[0].items():
        assert both[1][k] == (None if v is None else pytest.approx(v, abs=1e-9))
    some = ["c0", "c1", "c7", "c8"]
    (a, g, n), (b, h, m) = (multivariate.gram(t, some, by_blocks=x) for x in (False, True))
    assert a == b and n == m and h == pytest.approx(g)
    wide = frame(spark, ", ".join(f"c{i} double" for i in range(40)), [tuple(None if (i * 7 + j) % 5 == 0 else float(i * j % 11) for j in range(40)) for i in range(30)])
    got = {(r.a, r.b): r.n for r in summaries.missing_together(wide).collect()}
    assert len(got) == 780 and got[("c0", "c5")] == sum(i * 7 % 5 == 0 for i in range(30)) and got[("c0", "c1")] == 0
    found = multivariate.correlations(wide).collect()
    assert len(found) == 780 and {(r.a, r.b): r.r for r in found}[("c1", "c2")] is not None
    assert multivariate.correlations(wide.limit(0)).count() == 780
