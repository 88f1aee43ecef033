from pyspark.sql import functions as F

from lumen.operators import profile as P
from lumen.operators import quality as Q
from lumen.plans.dataset import analyze_dataset, brief_row, brief_rows
from lumen.operators import rules as N


def _small(spark):
    return spark.createDataFrame([(1, 10.5, "low"), (2, None, "mid"), (3, 30.5, "high")],
                                 "feature_a long, feature_b double, category string")


def test_profile_small(spark):
    df = _small(spark)
    prof = {r["column"]: r for r in P.column_profile(df).collect()}
    assert set(prof) == {"feature_a", "feature_b", "category"}
    assert prof["feature_b"]["missing"] == 1 and prof["feature_a"]["missing"] == 0
    assert prof["feature_a"]["is_numeric"] and prof["feature_b"]["is_numeric"]
    assert not prof["category"]["is_numeric"] and prof["category"]["mean"] is None
    assert prof["feature_b"]["p50"] == 20.5
    targets = [r["column"] for r in Q.recommend_targets(P.column_profile(df)).collect()]
    assert "feature_b" in targets


def test_nan_counts_as_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, "b"), (1.0, "a")], "x double, y string")
    prof = {r["column"]: r for r in P.column_profile(df).collect()}
    assert prof["x"]["missing"] == 2
    assert P.duplicate_rows(df).collect()[0][0] == 1


def test_quality_rules_and_score(spark):
    rows = [(i, "same", "A" if i < 19 else "B", float(i if i < 19 else 1000), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, const string, cls string, val double, target_label int")
    a = analyze_dataset(df, "t")
    flags = {r["column"]: r for r in a.flags.collect()}
    assert flags["const"]["is_constant"]
    assert flags["row_id"]["is_id_like"] and flags["row_id"]["is_high_cardinality"]
    assert flags["cls"]["is_imbalanced"]
    assert flags["val"]["has_outliers"]
    assert flags["target_label"]["is_leakage"]
    s = a.summary.collect()[0]
    # issues: constant 1 + high-card 2 (row_id, val) + outliers 1 + imbalance 1 + leakage 1 = 6 → -18
    assert s["issue_count"] == 6 and s["quality_score"] == 82
    codes = [r["code"] for r in a.issues.orderBy("ord").collect()]
    assert codes == ["constant_columns", "high_cardinality", "outliers", "class_imbalance", "target_leakage"]
    brief = N.dataset_brief(brief_row(a)).collect()[0]
    assert brief["confidence"] == "low" or brief["confidence"] == "medium"


def test_date_frequency(spark):
    rows = [(f"2024-01-{d:02d}",) for d in (1, 2, 3, 5, 5)]
    df = spark.createDataFrame(rows, "trade_date string")
    r = P.date_frequency(df).collect()[0]
    assert r["valid_ratio"] == 1.0 and r["median_interval_seconds"] == 86400.0


def test_long_texts_counted_by_digest(spark):
    long_a, long_b = "a" * 400, "b" * 300 + "é"
    df = spark.createDataFrame([(long_a,), (long_a,), (long_b,), ("short",), (None,)], "t string")
    r = P.column_profile(df).collect()[0]
    assert (r["distinct"], r["top_count"], r["top_value"], r["missing"]) == (3, 2, long_a, 1)


def test_duplicate_rows_long_texts_and_floats(spark):
    rows = [("x" * 500, 1.0, None), ("x" * 500, 1.0, None), ("y", -0.0, 2), ("y", 0.0, 2), ("y", float("nan"), 2),
            ("y", float("nan"), 2), ("y", None, 2)]
    df = spark.createDataFrame(rows, "t string, v double, k int")
    assert P.duplicate_rows(df).collect()[0][0] == 3


def test_brief_rows_run_side_by_side_and_keep_their_order(spark, monkeypatch):
    import threading

    from lumen.plans import dataset
    tables = {f"t{i}": spark.createDataFrame([(k, float(k % (i + 2)), None if i == 1 else "x") for k in range(20)],
                                             "k long, price double, note string") for i in range(3)}
    want = [tuple(brief_row(analyze_dataset(df, name)).first()) for name, df in tables.items()]
    met, analyze = threading.Barrier(3, timeout=60), dataset.analyze_dataset

    def together(df, name):
        met.wait()   # breaks if one table waits for another's analysis
        assert spark.sparkContext.getLocalProperty("lumen.caller") == "test"
        return analyze(df, name)

    monkeypatch.setattr(dataset, "analyze_dataset", together)
    spark.sparkContext.setLocalProperty("lumen.caller", "test")
    try:
        rows = brief_rows(tables)
    finally:
        spark.sparkContext.setLocalProperty("lumen.caller", None)
    assert [tuple(r.first()) for r in rows] == want and [r[0] for r in want] == ["t0", "t1", "t2"]
