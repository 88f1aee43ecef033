"""Model catalogue, recommendation rules, baselines and metrics
(survey ids M9, M10, M24-M30, M32-M34).

Metrics are SQL aggregates over a prediction table ``(label, prediction)``; model
results are a small table (one row per model) ranked with a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.functions.ranks import exact_quantiles
from lumen.functions.rows import with_row
from lumen.session import checkpoint_dir

SLOW_MODEL_ROW_LIMIT = 1_500
SLOW_MODEL_FEATURE_LIMIT = 24
SLOW_MODEL_KEYS = ("svr", "svc", "knn_regressor", "knn_classifier")

# fixed values: model catalogue (key, problem type, family, complexity, built here?)
# Keys of estimators that have no MLlib twin are kept for the rules; "built" says whether
# this library trains them, and "note" names the stand-in used instead.
CATALOG = (
    ("linear_regression", "regression", "linear", "low", True, ""),
    ("ridge", "regression", "linear", "low", True, ""),
    ("lasso", "regression", "linear", "low", True, ""),
    ("elastic_net", "regression", "linear", "low", True, ""),
    ("decision_tree_regressor", "regression", "tree", "medium", True, ""),
    ("random_forest", "regression", "ensemble", "medium", True, ""),
    ("extra_trees_regressor", "regression", "ensemble", "medium", True, ""),
    ("gradient_boosting_regressor", "regression", "boosting", "high", True, ""),
    ("knn_regressor", "regression", "distance", "medium", True, ""),
    ("svr", "regression", "kernel", "high", False, ""),
    ("xgboost_regressor", "regression", "boosting", "high", False, "gbt_60_d3"),
    ("lightgbm_regressor", "regression", "boosting", "high", False, "gbt_60_d4"),
    ("logistic_regression", "classification", "linear", "low", True, ""),
    ("decision_tree_classifier", "classification", "tree", "medium", True, ""),
    ("random_forest_classifier", "classification", "ensemble", "medium", True, ""),
    ("extra_trees_classifier", "classification", "ensemble", "medium", True, ""),
    ("gradient_boosting_classifier", "classification", "boosting", "high", True, ""),
    ("knn_classifier", "classification", "distance", "medium", True, ""),
    ("svc", "classification", "kernel", "high", False, "linear_svc"),
    ("xgboost_classifier", "classification", "boosting", "high", False, "gbt_60_d3_classifier"),
    ("lightgbm_classifier", "classification", "boosting", "high", False, "gbt_60_d4_classifier"),
)


def catalog_df(spark: SparkSession) -> DataFrame:
    """The catalogue as a table (filter by problem type / key like any table)."""
    return spark.createDataFrame(
        list(CATALOG), "key string, problem_type string, family string, complexity string, built boolean, stand_in string")


# fixed values: names of models besides their keys → (regression key, classification key)
MODEL_NAMES = {
    "linear regression": ("linear_regression", None),
    "線性迴歸": ("linear_regression", None),
    "ridge 迴歸": ("ridge", None),
    "lasso 迴歸": ("lasso", None),
    "elasticnet": ("elastic_net", None),
    "elastic net": ("elastic_net", None),
    "elasticnet 迴歸": ("elastic_net", None),
    "logistic regression": (None, "logistic_regression"),
    "決策樹迴歸": ("decision_tree_regressor", None),
    "決策樹分類": (None, "decision_tree_classifier"),
    "隨機森林": ("random_forest", "random_forest_classifier"),
    "隨機森林分類": (None, "random_forest_classifier"),
    "random forest": ("random_forest", "random_forest_classifier"),
    "extra trees 迴歸": ("extra_trees_regressor", None),
    "extra trees 分類": (None, "extra_trees_classifier"),
    "gradient boosting": ("gradient_boosting_regressor", "gradient_boosting_classifier"),
    "gradient boosting 迴歸": ("gradient_boosting_regressor", None),
    "gradient boosting 分類": (None, "gradient_boosting_classifier"),
    "knn": ("knn_regressor", "knn_classifier"),
    "knn 迴歸": ("knn_regressor", None),
    "knn 分類": (None, "knn_classifier"),
    "svm": ("svr", "svc"),
    "svr 支援向量迴歸": ("svr", None),
    "svc 支援向量分類": (None, "svc"),
    "xgboost": ("xgboost_regressor", "xgboost_classifier"),
    "xgb": ("xgboost_regressor", "xgboost_classifier"),
    "xgboost 迴歸": ("xgboost_regressor", None),
    "xgboost 分類": (None, "xgboost_classifier"),
    "lightgbm": ("lightgbm_regressor", "lightgbm_classifier"),
    "lgbm": ("lightgbm_regressor", "lightgbm_classifier"),
    "lightgbm 迴歸": ("lightgbm_regressor", None),
    "lightgbm 分類": (None, "lightgbm_classifier"),
}


def model_key(name: str, kind: str) -> str:
    """The key that a key, label or alias stands for, in any case (an unknown name: itself)."""
    wanted = name.strip()
    named = MODEL_NAMES.get(wanted.lower(), (None, None))[kind == "classification"]
    return named or next((row[0] for row in CATALOG if row[0] == wanted.lower()), wanted)


# ---------------------------------------------------------------------------- M28, M29
def without_slow(keys: list[str], rows: int, feature_count: int, categorical_count: int) -> tuple[list[str], list[str]]:
    """M29 for models that the caller names: (kept, left out).  Slow ones are left out of large,
    wide or categorical data; if nothing else was asked for, that is an error."""
    if not (rows > SLOW_MODEL_ROW_LIMIT or feature_count > SLOW_MODEL_FEATURE_LIMIT or categorical_count):
        return list(keys), []
    kept, slow = [k for k in keys if k not in SLOW_MODEL_KEYS], [k for k in keys if k in SLOW_MODEL_KEYS]
    if slow and not kept:
        raise ValueError(f"{', '.join(slow)}: too slow for data of this shape; choose tree or linear models")
    return kept, slow


def shape_summary(features: DataFrame, target: str) -> DataFrame:
    """One row: rows, feature count, categorical count, mean missing ratio, target distinct."""
    from lumen.functions.casts import is_feature_numeric

    feats = [f for f in features.schema.fields if f.name != target]
    n_cat = sum(1 for f in feats if not is_feature_numeric(f.dataType))
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"__m{i}") for i, f in enumerate(feats)]
    one = features.agg(*aggs)
    miss = sum((F.col(f"__m{i}") for i in range(len(feats))), F.lit(0))
    tdist = features.where(F.col(f"`{target}`").isNotNull()).select(f"`{target}`").distinct() \
        .agg(F.count(F.lit(1)).alias("target_distinct"))
    out = one.select(F.col("rows").cast("bigint").alias("rows"), F.lit(len(feats)).alias("feature_count"),
                     F.lit(n_cat).alias("categorical_count"),
                     (miss / F.greatest(F.col("rows") * len(feats), F.lit(1))).alias("missing_ratio"))
    return with_row(out, tdist)


def recommend_models(shape: DataFrame, kind: str) -> DataFrame:
    """M28 + M29: recommended model keys in order, then slow models filtered out when
    rows > 1500, features > 24 or any categorical feature.  Output: ord, key."""
    rows, feats, cats = F.col("rows"), F.col("feature_count"), F.col("categorical_count")
    miss, tdist = F.col("missing_ratio"), F.col("target_distinct")
    large = rows > SLOW_MODEL_ROW_LIMIT
    wide = (feats >= 20) | (miss > 0.15)

    def keys(*ks: str) -> Column:
        return F.array(*[F.lit(k) for k in ks])

    if kind == "regression":
        small = F.concat(keys("ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting_regressor",
                              "xgboost_regressor"), F.when(feats <= 8, keys("knn_regressor")).otherwise(keys()))
        default = F.concat(keys("linear_regression", "ridge", "random_forest", "extra_trees_regressor",
                                "gradient_boosting_regressor", "xgboost_regressor", "lightgbm_regressor"),
                           F.when((rows <= SLOW_MODEL_ROW_LIMIT) & (feats <= 12) & (cats == 0), keys("svr"))
                           .otherwise(keys()))
        chosen = (F.when(rows <= 80, small)
                  .when(large, keys("decision_tree_regressor", "random_forest", "extra_trees_regressor"))
                  .when(wide, keys("ridge", "elastic_net", "random_forest", "extra_trees_regressor",
                                   "gradient_boosting_regressor", "lightgbm_regressor"))
                  .otherwise(default))
    else:
        small = F.concat(keys("logistic_regression", "decision_tree_classifier", "random_forest_classifier",
                              "gradient_boosting_classifier", "xgboost_classifier"),
                         F.when(feats <= 10, keys("knn_classifier")).otherwise(keys()))
        default = F.concat(keys("logistic_regression", "random_forest_classifier", "extra_trees_classifier",
                                "gradient_boosting_classifier", "xgboost_classifier", "lightgbm_classifier"),
                           F.when((rows <= SLOW_MODEL_ROW_LIMIT) & (feats <= 12) & (cats == 0), keys("svc"))
                           .otherwise(keys()))
        chosen = (F.when((rows <= 80) | (tdist <= 5), small)
                  .when(large, keys("decision_tree_classifier", "random_forest_classifier", "extra_trees_classifier"))
                  .when((cats > 0) | (miss > 0.15),
                        keys("logistic_regression", "random_forest_classifier", "extra_trees_classifier",
                             "gradient_boosting_classifier", "lightgbm_classifier"))
                  .otherwise(default))
    skip_slow = large | (feats > SLOW_MODEL_FEATURE_LIMIT) | (cats > 0)
    slow = F.array(*[F.lit(k) for k in SLOW_MODEL_KEYS])
    kept = F.when(skip_slow, F.filter(chosen, lambda k: ~F.array_contains(slow, k))).otherwise(chosen)
    return shape.select(F.posexplode(kept).alias("ord", "key")).select(
        (F.col("ord") + 1).cast("int").alias("ord"), "key")


# ---------------------------------------------------------------------------- M9, M10
def baseline_prediction(train: DataFrame, kind: str, label: str = "label") -> DataFrame:
    """One-row table ``(prediction)`` — most frequent train class (ties →
    smallest code) or the exact train median."""
    if kind == "classification":
        counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
        return counts.agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).cast("double").alias("prediction"))
    labels = train.select(F.lit(1).alias("__k"), F.col(label).alias("v"), F.lit(1).alias("c"))
    return exact_quantiles(labels, ["__k"], "v", "c", [0.5]).select(F.col("value").alias("prediction"))


# ---------------------------------------------------------------------------- M24, M25
def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2 (1 - SSE/SST; SST = 0 → 1 if SSE = 0 else 0; n < 2 → null), RMSE, MAE."""
    y, p = F.col(label), F.col(prediction)
    agg = pred.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("sse"),
                   F.sum(F.abs(y - p)).alias("sae"), F.var_pop(y).alias("vy"))
    sst = F.col("vy") * F.col("n")
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(sst == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("sse") / sst))
    return agg.select(F.col("n").cast("bigint").alias("n_test"), r2.alias("r2"),
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1 (zero division → 0) with predictions rounded
    half-to-even to whole class codes, plus R2 / RMSE / MAE on the codes.

    The raw predictions are read once, into confusion counts ``(y, p, raw p, count)``
    (partial aggregation: at most classes x distinct predictions rows); every metric is
    computed from that small table.
    """
    conf = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("q")).agg(F.count(F.lit(1)).alias("c")) \
        .withColumn("p", F.bround(F.col("q"), 0))
    checkpoint_dir(pred.sparkSession)
    conf = conf.checkpoint()   # small, and read by every metric: the predictions are made once
    y, q, c = F.col("y"), F.col("q"), F.col("c")
    reg = conf.agg(F.sum(c).alias("n"), F.sum((y - q) * (y - q) * c).alias("sse"), F.sum(F.abs(y - q) * c).alias("sae"),
                   F.sum(y * c).alias("sy"), F.sum(y * y * c).alias("syy"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(sst <= 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("sse") / sst))
    reg = reg.select(F.col("n").cast("bigint").alias("n_test"), r2.alias("r2"),
                     F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"))
    per_true = conf.groupBy(F.col("y").alias("k")).agg(
        F.sum("c").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    per_pred = conf.groupBy(F.col("p").alias("k")).agg(F.sum("c").alias("predicted"))
    per = per_true.join(per_pred, on="k", how="left").fillna(0, subset=["predicted"])
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(F.lit(0.0))
    cls = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"), F.sum(f1 * F.col("support")).alias("wf1")) \
        .select((F.col("correct") / F.col("n")).alias("accuracy"), (F.col("wf1") / F.col("n")).alias("f1_score"))
    return with_row(reg, cls)


# ---------------------------------------------------------------------------- M27
def rank_models(results: DataFrame, kind: str, metric: str = "accuracy") -> DataFrame:
    """Rank results (one row per model, ``ord`` = training order, baseline first).

    classification: ``metric`` desc (null → 0), then RMSE asc; regression: RMSE asc;
    ties keep training order.  ``best`` marks rank 1.
    """
    if kind == "classification":
        order = [F.desc(F.coalesce(F.col(metric), F.lit(0.0))), F.asc("rmse"), F.asc("ord")]
    else:
        order = [F.asc("rmse"), F.asc("ord")]
    w = Window.orderBy(*order)
    return results.withColumn("rank", F.row_number().over(w).cast("int")).withColumn("best", F.col("rank") == 1)


# ---------------------------------------------------------------------------- M32-M34
def predicted_vs_actual(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                        bins: int | None = None) -> DataFrame:
    """M32 + M33: points (actual, predicted, residual), or 2-D bin counts when ``bins``."""
    pts = pred.select(F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
                      (F.col(label) - F.col(prediction)).alias("residual"))
    if not bins:
        return pts
    rng = pts.agg(F.least(F.min("actual"), F.min("predicted")).alias("lo"),
                  F.greatest(F.max("actual"), F.max("predicted")).alias("hi"))
    j = with_row(pts, rng)
    width = (F.col("hi") - F.col("lo")) / bins
    b = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / F.when(width > 0, width).otherwise(1.0)), F.lit(bins - 1))
    return j.groupBy(b("actual").alias("actual_bin"), b("predicted").alias("predicted_bin")).agg(
        F.count(F.lit(1)).alias("points"))


def comparison_table(results: DataFrame) -> DataFrame:
    """Long (model_key, metric, value) for RMSE and MAE."""
    return results.select("model_key", F.explode(F.array(
        F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value")),
        F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")))).alias("m")).select(
        "model_key", "m.metric", "m.value")
