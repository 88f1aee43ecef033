from pyspark.sql import functions as F

from lumen.functions import text as TX
from lumen.operators import model_fit as MF
from lumen.operators import rules as N
from lumen.operators import runlog as G
from lumen.plans.dataset import analyze_dataset
from lumen.plans.modeling import run_model_analysis
from lumen.sources import files as S
from tests.test_model import _housing


def test_text_helpers(spark):
    df = spark.createDataFrame([("My File (v2).csv", 1234.5, 0.12345)], "f string, n double, r double")
    r = df.select(TX.safe_stem("f").alias("s"), TX.format_number(F.col("n")).alias("n"),
                  TX.format_percent(F.col("r")).alias("p"), TX.normalize_name(F.lit(" Customer-ID ")).alias("k")).collect()[0]
    assert (r["s"], r["n"], r["p"], r["k"]) == ("My_File_v2", "1,234.5", "12.35%", "customer_id")


def test_quick_search_and_folds(spark):
    assert MF.cv_folds("regression", 5) == 2 and MF.cv_folds("regression", 50) == 3
    assert MF.cv_folds("classification", 50, [1, 30]) == 1 and MF.cv_folds("classification", 50, [2, 30]) == 2
    run = run_model_analysis(_housing(spark), "price_usd", models=["ridge", "decision_tree_regressor"], automl="quick")
    assert any("best parameters" in n for n in run.notes)
    assert run.results.count() == 3


def test_profile_reads_every_row(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "k long, v double")
    s = analyze_dataset(df, "t").summary.collect()[0]
    assert not s["is_profiled_sample"] and s["row_count"] == 100


def test_wide_decimals_and_far_values(spark):
    from decimal import Decimal
    from lumen.operators.model_prep import numeric_stats
    from lumen.operators.profile import column_profile
    big = spark.createDataFrame([(Decimal(10 ** 30 + i),) for i in range(3)], "d decimal(38,0)")
    p = column_profile(big, quantiles=False).first()
    assert (p["distinct"], p["top_count"]) == (3, 1) and abs(p["mean"] / 1e30 - 1) < 1e-12
    far = spark.createDataFrame([(1e9,), (1e9 + 1,), (1e9 + 2,), (None,)], "`a.b` double")
    s = numeric_stats(far, ["a.b"]).first()
    assert s["median"] == 1e9 + 1 and abs(s["std"] - 0.5 ** 0.5) < 1e-6


def test_nested_names_reach_finance_and_models(spark):
    from lumen.operators.series import build_series
    rows = [(f"2024-01-{i + 1:02}", float(i), "x" if i % 2 else "y") for i in range(20)]
    df = spark.createDataFrame(rows, "`q.date` string, `q.price` double, `q.kind` string")
    assert build_series(df, "q.date", "q.price").count() == 20
    run = run_model_analysis(df, "q.price", models=["linear_regression"])
    assert run.results.count() == 2


def test_split_is_exact_and_in_proportion(spark):
    from lumen.operators.model_prep import with_split
    df = spark.createDataFrame([(i, float(i % 3 == 0)) for i in range(101)], "k long, label double")
    got = with_split(df, "label", ["k"], "classification").groupBy("label", "is_test").count().collect()
    n = {(r["label"], r["is_test"]): r["count"] for r in got}
    assert n[0.0, True] + n[1.0, True] == 26 and abs(n[1.0, True] - 34 / 4) <= 1
    for size in range(1, 12):
        part = with_split(df.limit(size), "label", ["k"], "regression")
        assert part.where("is_test").count() == -(-size // 4)


def test_model_run_guards(spark):
    import pytest
    df = spark.createDataFrame([(i, float(i)) for i in range(4)], "k long, y double")
    with pytest.raises(ValueError, match="at least 5"):
        run_model_analysis(df, "y")
    with pytest.raises(ValueError, match="no values"):
        run_model_analysis(df.selectExpr("k", "cast(null as double) y"), "y")


def test_glossary_and_bands(spark):
    terms = spark.createDataFrame([(0, "dataset", 0, "RMSE"), (1, "model", 0, "rmse "), (1, "model", 1, "R²"),
                                   (2, "finance", 0, "RSI")], "source_ord int, source string, term_ord int, term string")
    merged = {r["term"]: r["sources"] for r in N.merge_terms(terms).collect()}
    assert merged == {"RMSE": ["dataset", "model"], "R²": ["model"], "RSI": ["finance"]}
    assert N.glossary_df(spark).count() == 19
    assert [r["key"] for r in N.glossary_terms(spark, ["rsi", "nothing", "mean"]).collect()] == ["rsi", "mean"]
    m = spark.createDataFrame([("rsi", 72.0), ("rsi", 30.0), ("rsi", 50.0), ("r2", 0.5)], "metric string, value double")
    got = {(r["metric"], r["value"]): r["band"] for r in N.metric_bands(m, N.bands_df(spark)).collect()}
    assert got == {("rsi", 72.0): "overheated", ("rsi", 30.0): "oversold", ("rsi", 50.0): "neutral",
                   ("r2", 0.5): "moderate"}


def test_replace_model_results(spark):
    old = spark.createDataFrame([("r1", "a", 0, 1.0), ("r2", "b", 0, 2.0)], "run_id string, model_key string, ord int, rmse double")
    new = spark.createDataFrame([("r1", "baseline", 0, 3.0), ("r1", "ridge", 1, 1.5)], "run_id string, model_key string, ord int, rmse double")
    out = {(r["run_id"], r["model_key"]): (r["rank"], r["metric_rank"]) for r in G.replace_model_results(old, new).collect()}
    assert out == {("r2", "b"): (None, None), ("r1", "baseline"): (1, 2), ("r1", "ridge"): (2, 1)}


def test_manifest_and_model_save(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("a,b\n1,2\n")
    h = S.file_hashes(spark, str(p))
    m = G.run_manifest("run_1", "profile", h, S.batch_hash(h), {"x": 1}).collect()[0]
    assert m["input_files"][0]["file_name"] == "in.csv" and '"run_id":"run_1"' in m["manifest_json"]
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "a double, label double"))
    model = LinearRegression().fit(df)
    path = S.save_model(model, str(tmp_path / "model"))
    from pyspark.ml.regression import LinearRegressionModel
    assert LinearRegressionModel.load(path).coefficients[0] == model.coefficients[0]


def test_manifest_of_files_that_no_value_holds(spark, tmp_path):
    import hashlib
    (tmp_path / "in.bin").write_bytes(b"x" * 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")   # longest file that Spark takes as a value
    try:
        h = S.file_hashes(spark, str(tmp_path / "in.bin"))
        m = G.run_manifest("run_1", "profile", h, S.batch_hash(h), {}).first()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    sha = hashlib.sha256(b"x" * 1000).hexdigest()
    assert [tuple(f) for f in m["input_files"]] == [("in.bin", 1000, sha)]
    assert m["combined_input_hash"] == hashlib.sha256(f"in.bin\0{sha}".encode()).hexdigest()


def test_priority_findings(spark):
    runs = spark.createDataFrame([("r1", "ridge", 91, "prediction_baseline", None),
                                  ("r2", "tree", 60, "fix_data_quality", "bearish")],
                                 "run_id string, best_model string, quality_score int, next_action string, trend_label string")
    got = {(r["run_id"], r["ord"]): r["level"] for r in N.priority_findings(runs).collect()}
    assert got[("r1", 3)] == "opportunity" and got[("r2", 3)] == "risk" and len(got) == 8


def test_stratified_sample(spark):
    from lumen.operators.model_prep import stratified_sample
    rows = [(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else "c")) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y string")
    s = stratified_sample(df, "y", ["k"], 101, buckets=4)
    counts = {r["y"]: r["count"] for r in s.groupBy("y").count().collect()}
    assert sum(counts.values()) == 101 and counts == {"a": 71, "b": 20, "c": 10}


def test_json_lines_with_bad_line_rejected(spark, tmp_path):
    import pytest
    p = tmp_path / "bad.jsonl"
    p.write_text('{"a": 1}\n{"a": 2\n{"a": 3}\n')
    with pytest.raises(ValueError):
        S.read_json(spark, str(p))


def test_merged_run_skips_bad_files(spark, tmp_path):
    from lumen.plans.merged import load_and_union
    a = tmp_path / "a.csv"; a.write_text("x,y\n1,2\n")
    b = tmp_path / "b.csv"; b.write_text("x,z\n3,4\n")
    u, status, notes = load_and_union(spark, [str(a), str(b), str(tmp_path / "nope.csv")])
    assert u.count() == 2 and len(notes) == 1 and set(u.columns) >= {"x", "y", "z", "source_file"}


def test_saved_pipeline_scores_raw_rows(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from lumen.sources.files import save_model
    rows = [(float(i), None if i % 7 == 0 else float(i % 5), ["it's", "b\\c", None][i % 3], 3.0 * i + (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "`x.1` double, gap double, kind string, y double")
    run = run_model_analysis(df, "y", models=["linear_regression"])
    path = save_model(run.pipelines["linear_regression"], str(tmp_path / "m"))
    new = spark.createDataFrame([(10.0, None, "it's"), (20.0, 1.0, "unseen")], "`x.1` double, gap double, kind string")
    got = [r["prediction"] for r in PipelineModel.load(path).transform(new).orderBy("`x.1`").collect()]
    assert abs(got[0] - 30.0) < 1.5 and abs(got[1] - 60.0) < 2.5
