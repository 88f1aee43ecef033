import pytest
from pyspark.sql import functions as F

from lumen.operators import model_eval as ME
from lumen.operators import model_prep as MP
from lumen.plans import modeling
from lumen.plans.modeling import run_model_analysis

HOUSING = [(700, 2, 1, 1, 300000), (850, 2, 1, 0, 320000), (900, 3, 2, 1, 360000), (1000, 3, 2, 0, 380000),
           (1100, 3, 2, 1, 420000), (1200, 4, 2, 0, 450000), (1300, 4, 3, 1, 500000), (1400, 4, 3, 0, 520000),
           (1500, 5, 3, 1, 580000), (1650, 5, 4, 0, 610000)]


def _housing(spark):
    return spark.createDataFrame(HOUSING, "area_sqft long, bedrooms long, bathrooms long, near_mrt long, price_usd long")


def test_problem_type(spark):
    df = _housing(spark)
    assert MP.problem_type(df, "price_usd").collect()[0]["problem_type"] == "regression"
    assert MP.problem_type(df, "near_mrt").collect()[0]["problem_type"] == "classification"


def test_regression_run(spark):
    run = run_model_analysis(_housing(spark), "price_usd", models=["linear_regression", "ridge", "decision_tree_regressor"])
    res = run.results.collect()
    assert run.problem_type == "regression" and len(res) == 4
    assert res[0]["model_key"] in {r["model_key"] for r in res}
    assert any(r["model_key"] == "baseline_regressor" for r in res)
    assert sum(1 for r in res if r["best"]) == 1


def test_classification_run(spark):
    run = run_model_analysis(_housing(spark), "near_mrt", models=["logistic_regression", "random_forest_classifier"])
    assert run.problem_type == "classification"
    assert all(r["accuracy"] is not None for r in run.results.collect())


def test_feature_exclusion_large_sales(spark):
    n = 6000
    rows = [(f"CUST-{i:06d}", ["north", "south", "west", "east"][i % 4], ["A", "B", "C"][i % 3], i % 8 + 1,
             95 + (i % 11) * 2, (i % 8 + 1) * (95 + (i % 11) * 2) + i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_id string, region string, product string, units long, "
                                     "unit_price long, revenue long")
    ex = {r["column"]: r["reason"] for r in MP.feature_exclusion(df, "revenue").collect()}
    assert ex["customer_id"] == "id_like" and ex["units"] is None
    num, cat = MP.kept_features(df, "revenue")
    assert sorted(num + cat) == ["product", "region", "unit_price", "units"]
    shape = ME.shape_summary(df.drop("customer_id"), "revenue")
    keys = [r["key"] for r in ME.recommend_models(shape, "regression").collect()]
    assert "svr" not in keys and "knn_regressor" not in keys


def test_metrics(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (2.0, 2.0)], "label double, prediction double")
    m = ME.classification_metrics(pred).collect()[0]
    assert m["accuracy"] == 0.75
    # per class F1: c0 2/3 (support 1), c1 2/3 (support 2), c2 1 (support 1) → weighted 0.75
    assert m["f1_score"] == pytest.approx(0.75)
    r = ME.regression_metrics(pred).collect()[0]
    assert r["rmse"] == pytest.approx(0.5) and r["mae"] == pytest.approx(0.25)


def test_category_cap(spark):
    rows = [(f"c{i % 40}",) for i in range(400)] + [("c0",)] * 10
    maps = MP.category_maps(spark.createDataFrame(rows, "x string"), ["x"]).collect()
    assert max(r["slot"] for r in maps) == 31 and len(maps) == 32
    inf = [r for r in maps if r["is_infrequent"]]
    assert len(inf) == 1 and inf[0]["count"] == 9 * 10   # nine least frequent categories, ten rows each
    assert [r["category"] for r in maps if r["is_mode"]] == ["c0"]


def test_models_by_key_label_or_alias():
    from lumen.operators import model_eval as ME
    for name, kind, key in [("Ridge", "regression", "ridge"), ("隨機森林", "classification", "random_forest_classifier"), (" XGB ", "regression", "xgboost_regressor"),
                            ("LGBM", "classification", "lightgbm_classifier"), ("svm", "classification", "svc"), ("Logistic Regression", "classification", "logistic_regression"),
                            ("unheard of", "regression", "unheard of"), ("elastic net", "regression", "elastic_net")]:
        assert ME.model_key(name, kind) == key


def test_slow_models_are_left_out_or_an_error():
    import pytest

    from lumen.operators import model_eval as ME
    assert ME.without_slow(["svr", "ridge"], 100, 3, 0) == (["svr", "ridge"], [])
    for shape in ((1501, 3, 0), (100, 25, 0), (100, 3, 1)):
        assert ME.without_slow(["svr", "ridge"], *shape) == (["ridge"], ["svr"])
        with pytest.raises(ValueError):
            ME.without_slow(["svr", "knn_regressor"], *shape)


def test_a_run_of_the_recommended_models(spark):
    from lumen.operators import model_eval as ME
    from lumen.plans.modeling import run_model_analysis
    df = spark.createDataFrame([(float(i), float(i % 7), 3.0 * i + i % 7 + (i % 5) * 0.1) for i in range(70)], "a double, b double, y double")
    run = run_model_analysis(df, "y", mode="regression", models=["Linear Regression", "決策樹迴歸"])
    assert {r["model_key"] for r in run.results.collect()} >= {"linear_regression", "decision_tree_regressor"}
    want = [r["key"] for r in ME.recommend_models(ME.shape_summary(df, "y"), "regression").orderBy("ord").collect()]
    assert want[0] == "ridge" and "knn_regressor" in want


def test_matrix_parts_grow_in_number_with_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 50), ["a", "b"][i % 2], 3.0 * (i % 50) + i % 7) for i in range(700)],
                               "x double, kind string, y double").coalesce(1)
    seen, fit = [], modeling.MF.fit_and_predict

    def spied(prep, *args):
        seen.append(prep.data.rdd.glom().map(len).collect())
        return fit(prep, *args)

    monkeypatch.setattr(modeling.MF, "fit_and_predict", spied)
    run_model_analysis(df, "y", mode="regression", models=["linear_regression"])
    monkeypatch.setattr(modeling, "PART_ROWS", 20)
    run_model_analysis(df, "y", mode="regression", models=["linear_regression"])
    small, large = seen
    assert sum(small) == sum(large) == 700 and len(large) == 35 > len(small) and max(large) <= 30


def test_a_single_tree_keeps_no_node_of_every_row():
    for key, kind in (("decision_tree_regressor", "regression"), ("decision_tree_classifier", "classification")):
        assert not modeling.MF.estimator(key, kind, 100, 1.0).getCacheNodeIds()


def test_a_forest_grows_in_groups_and_is_one_model(spark, tmp_path, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor

    from lumen.operators import model_fit as MF
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.range(400).selectExpr(
        "cast(id % 20 as double) a", "cast(id % 7 as double) b", "cast(id % 3 as double) c", "cast(id % 20 * (id % 7) as double) label"))
    sizes = []
    once = RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, d: sizes.append(self.getNumTrees()) or once(self, d))
    model = MF.estimator("random_forest", "regression", 400, 1.0).fit(data)
    assert sum(sizes) == 35 and max(sizes) <= 12   # what is kept of a row goes with the trees under way
    assert len(model.trees) == model.getNumTrees == 35 and model.numFeatures == 3 and model.getMaxDepth() == 12
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) > 30
    row = data.first()
    mean = sum(t.predict(row["features"]) for t in model.trees) / 35
    assert abs(model.transform(data).first()["prediction"] - mean) < 1e-9
    assert abs(sum(model.featureImportances) - 1) < 1e-9
    path = str(tmp_path / "forest")
    model.save(path)
    assert abs(RandomForestRegressionModel.load(path).predict(row["features"]) - mean) < 1e-9


def test_the_matrix_is_written_once_and_read_by_its_parts(spark, monkeypatch):
    monkeypatch.setattr(modeling, "PART_ROWS", 100)
    df = spark.range(6000).selectExpr("cast(id % 50 as double) a", "cast(id % 11 as double) b", "cast(id % 50 + id % 11 as double) y")
    seen = []
    once = modeling._compared
    monkeypatch.setattr(modeling, "_compared", lambda *a: seen.append((a[8].rdd.getNumPartitions(), a[8].storageLevel)) or once(*a))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    run = run_model_analysis(df, "y", models=["ridge", "random_forest"])
    assert run.notes == [] and {r["model_key"] for r in run.results.collect()} == {"baseline_regressor", "ridge", "random_forest"}
    assert seen[0][0] >= 60 and not seen[0][1].useDisk   # not a second time in the cache
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
