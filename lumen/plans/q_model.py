"""Registered model queries (M1-M10, M24-M34) over orders, lineitem, customer, part.

Train/test split for the SQL-checkable ones: ``key % 4 = 0`` is test (the ``modulo``
rule of :func:`lumen.operators.model_prep.split_column`), reproducible in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.functions.rows import with_row
from lumen.operators import model_eval as ME
from lumen.operators import model_fit as MF
from lumen.operators import model_prep as MP
from lumen.plans.modeling import run_model_analysis
from lumen.plans.q_profile import lineitem_with_holes, _holes_sql
from lumen.plans.registry import register
from lumen.sources.tables import table


@register("problem_type", sql="""
SELECT 'l_linenumber' AS target, true AS is_numeric, count(l_linenumber)::BIGINT AS non_null,
  count(DISTINCT l_linenumber)::BIGINT AS "distinct",
  CASE WHEN count(DISTINCT l_linenumber) <= 10 AND count(DISTINCT l_linenumber) / greatest(count(l_linenumber), 1) <= 0.2
       THEN 'classification' ELSE 'regression' END AS problem_type
FROM lineitem
UNION ALL
SELECT 'l_extendedprice', true, count(l_extendedprice)::BIGINT, count(DISTINCT l_extendedprice)::BIGINT,
  CASE WHEN count(DISTINCT l_extendedprice) <= 10 AND count(DISTINCT l_extendedprice) / greatest(count(l_extendedprice), 1) <= 0.2
       THEN 'classification' ELSE 'regression' END
FROM lineitem
UNION ALL
SELECT 'l_returnflag', false, count(l_returnflag)::BIGINT, count(DISTINCT l_returnflag)::BIGINT, 'classification' FROM lineitem""")
def q_problem_type(spark, sf_dir):
    """M1: problem type of three candidate targets of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    parts = [MP.problem_type(li, t) for t in ("l_linenumber", "l_extendedprice", "l_returnflag")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("label_encode", sql="""
SELECT value, (dense_rank() OVER (ORDER BY value) - 1)::DOUBLE AS label
FROM (SELECT DISTINCT CAST(o_orderpriority AS VARCHAR) AS value FROM orders WHERE o_orderpriority IS NOT NULL)""")
def q_label_encode(spark, sf_dir):
    """M2: class codes of a text target (sorted values → 0..k-1)."""
    return MP.label_codes(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("feature_exclusion", sql="""
WITH c AS (SELECT * FROM customer WHERE c_mktsegment IS NOT NULL)
SELECT 0 AS position, 'c_custkey' AS "column", 'numeric' AS kind, false AS excluded, CAST(NULL AS VARCHAR) AS reason
UNION ALL
SELECT 1, 'c_name', 'categorical',
  count(DISTINCT c_name) >= 1000 AND count(DISTINCT c_name) / greatest(count(c_name), 1) >= 0.45,
  CASE WHEN count(c_name) = 0 THEN 'all_null'
       WHEN count(DISTINCT c_name) >= 1000 AND count(DISTINCT c_name) / greatest(count(c_name), 1) >= 0.45
       THEN 'high_cardinality_text' END FROM c
UNION ALL SELECT 2, 'c_nationkey', 'numeric', false, NULL
UNION ALL SELECT 3, 'c_acctbal', 'numeric', false, NULL""")
def q_feature_exclusion(spark, sf_dir):
    """M3: features kept or excluded (with reason) for target c_mktsegment."""
    return MP.feature_exclusion(table(spark, sf_dir, "customer"), "c_mktsegment")


_IMPUTE_COLS = ("l_quantity", "l_discount", "l_tax")


@register("impute_scale", sql="WITH src AS " + _holes_sql() + ", train AS (SELECT * FROM src WHERE l_orderkey % 4 <> 0)\n"
          + "\nUNION ALL\n".join(
              f"SELECT '{c}' AS \"column\", {R(f'quantile_cont({c}, 0.5)', 6)} AS median, "
              f"{R(f'avg(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM train)))', 6)} AS mean, "
              f"{R(f'stddev_pop(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM train)))', 6)} AS std FROM train"
              for c in _IMPUTE_COLS))
def q_impute_scale(spark, sf_dir):
    """M7: median imputation and standard-scaling statistics on the training rows."""
    train = lineitem_with_holes(spark, sf_dir).where(F.col("l_orderkey") % 4 != 0)
    s = MP.numeric_stats(train, list(_IMPUTE_COLS))
    return s.select("column", fround("median", 6).alias("median"), fround("mean", 6).alias("mean"),
                    fround("std", 6).alias("std"))


@register("onehot_map", sql="""
WITH h AS (
  SELECT 'p_name' AS "column", p_name AS category, count(*)::BIGINT AS count FROM part WHERE p_name IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'p_brand', p_brand, count(*)::BIGINT FROM part WHERE p_brand IS NOT NULL GROUP BY 2
),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, category) AS rn,
             count(*) OVER (PARTITION BY "column") AS k, sum(count) OVER (PARTITION BY "column") AS total FROM h)
SELECT "column", category, (rn - 1)::INTEGER AS slot, count, false AS is_infrequent, rn = 1 AS is_mode
FROM r WHERE k <= 32 OR rn < 32
UNION ALL
SELECT "column", NULL, 31, (max(total) - sum(count) FILTER (WHERE rn < 32))::BIGINT, true, false
FROM r WHERE k > 32 GROUP BY 1""")
def q_onehot_map(spark, sf_dir):
    """M8: one-hot slots capped at 32 outputs (31 most frequent + infrequent) and the mode."""
    return MP.category_maps(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


def _orders_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("is_test", F.col("o_orderkey") % 4 == 0)


_REG_METRICS_SQL = """
SELECT count(*)::BIGINT AS n_test,
  {r2} AS r2, {rmse} AS rmse, {mae} AS mae
FROM p"""


def _reg_sql(pred_cte: str) -> str:
    r2 = R("CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) = 0 THEN CASE WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END "
           "ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END", 6)
    return pred_cte + _REG_METRICS_SQL.format(r2=r2, rmse=R("sqrt(avg((y - p) * (y - p)))", 4),
                                              mae=R("avg(abs(y - p))", 4))


def _round_reg(m: DataFrame) -> DataFrame:
    return m.select("n_test", fround("r2", 6).alias("r2"), fround("rmse", 4).alias("rmse"), fround("mae", 4).alias("mae"))


@register("baseline_regression", sql=_reg_sql("""
WITH s AS (SELECT o_totalprice AS y, o_orderkey % 4 = 0 AS is_test FROM orders WHERE o_totalprice IS NOT NULL),
b AS (SELECT quantile_cont(y, 0.5) AS m FROM s WHERE NOT is_test),
p AS (SELECT y, m AS p FROM s, b WHERE is_test)"""))
def q_baseline_regression(spark, sf_dir):
    """M10 + M24: median baseline for o_totalprice scored on the test rows."""
    d = _orders_split(spark, sf_dir).select(F.col("o_totalprice").alias("label"), "is_test").where(F.col("label").isNotNull())
    base = ME.baseline_prediction(d.where(~F.col("is_test")), "regression")
    pred = with_row(d.where("is_test"), base)
    return _round_reg(ME.regression_metrics(pred))


def _clf_sql(pred_cte: str) -> str:
    return pred_cte + f""",
pr AS (SELECT y, round_even(p, 0) AS p FROM p),
c AS (SELECT y, p, count(*) AS n FROM pr GROUP BY 1, 2),
t AS (SELECT y AS k, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM c GROUP BY 1),
q AS (SELECT p AS k, sum(n) AS predicted FROM c GROUP BY 1),
f AS (SELECT t.*, coalesce(q.predicted, 0) AS predicted FROM t LEFT JOIN q USING (k)),
cls AS (SELECT sum(tp) / sum(support) AS accuracy,
               sum(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END * support) / sum(support) AS f1 FROM f),
reg AS ({_reg_sql("").strip()})
SELECT reg.*, {R('accuracy', 6)} AS accuracy, {R('f1', 6)} AS f1_score FROM reg, cls"""


def _round_clf(m: DataFrame) -> DataFrame:
    return m.select("n_test", fround("r2", 6).alias("r2"), fround("rmse", 4).alias("rmse"), fround("mae", 4).alias("mae"),
                    fround("accuracy", 6).alias("accuracy"), fround("f1_score", 6).alias("f1_score"))


_STATUS_CODES = """
codes AS (SELECT value, (dense_rank() OVER (ORDER BY value) - 1)::DOUBLE AS label
          FROM (SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus IS NOT NULL)),
s AS (SELECT codes.label AS y, o_orderpriority, o_orderkey % 4 = 0 AS is_test FROM orders JOIN codes ON codes.value = o_orderstatus)"""


@register("baseline_classification", sql=_clf_sql("WITH " + _STATUS_CODES + """,
b AS (SELECT y AS m FROM s WHERE NOT is_test GROUP BY y ORDER BY count(*) DESC, y LIMIT 1),
p AS (SELECT y, m AS p FROM s, b WHERE is_test)"""))
def q_baseline_classification(spark, sf_dir):
    """M9 + M25: most-frequent-class baseline for o_orderstatus scored on the test rows."""
    d = MP.encode_target(_orders_split(spark, sf_dir), "o_orderstatus", "classification")
    base = ME.baseline_prediction(d.where(~F.col("is_test")), "classification")
    pred = with_row(d.where("is_test").select("label"), base)
    return _round_clf(ME.classification_metrics(pred))


@register("clf_metrics", sql=_clf_sql("WITH " + _STATUS_CODES + """,
m AS (SELECT o_orderpriority, arg_min(y, struct_pack(a := -cnt, b := y)) AS m
      FROM (SELECT o_orderpriority, y, count(*) AS cnt FROM s WHERE NOT is_test GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT s.y, m.m AS p FROM s JOIN m USING (o_orderpriority) WHERE is_test)"""))
def q_clf_metrics(spark, sf_dir):
    """Accuracy / weighted F1 of a one-feature lookup classifier (majority class per priority)."""
    d = MP.encode_target(_orders_split(spark, sf_dir), "o_orderstatus", "classification")
    train = d.where(~F.col("is_test"))
    lookup = train.groupBy("o_orderpriority", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("o_orderpriority").agg(
        F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("prediction"))
    pred = d.where("is_test").select("label", "o_orderpriority").join(lookup, on="o_orderpriority")
    return _round_clf(ME.classification_metrics(pred))


_LINREG_CTE = """
WITH s AS (SELECT l_extendedprice AS y, {x} AS x, l_orderkey % 4 = 0 AS is_test FROM lineitem),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE NOT is_test),
p AS (SELECT y, a + b * x AS p FROM s, f WHERE is_test)"""


def _linreg_pred(spark, sf_dir, x: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), F.col(x).alias("x"),
                                                 (F.col("l_orderkey") % 4 == 0).alias("is_test"))
    fit = li.where(~F.col("is_test")).agg(F.regr_slope("label", "x").alias("b"), F.regr_intercept("label", "x").alias("a"))
    return with_row(li.where("is_test"), fit).select("label", (F.col("a") + F.col("b") * F.col("x")).alias("prediction"))


@register("linreg_1d", sql=_reg_sql(_LINREG_CTE.format(x="l_quantity")))
def q_linreg_1d(spark, sf_dir):
    """M11 (one feature) + M24: l_extendedprice on l_quantity, scored on the test rows."""
    return _round_reg(ME.regression_metrics(_linreg_pred(spark, sf_dir, "l_quantity")))


@register("linreg_2d", sql=_reg_sql("""
WITH s AS (SELECT l_extendedprice AS y, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_orderkey % 4 = 0 AS is_test FROM lineitem),
m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM s WHERE NOT is_test),
f AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb, * FROM m),
p AS (SELECT y, my + wa * (a - ma) + wb * (b - mb) AS p FROM s, f WHERE is_test)"""))
def q_linreg_2d(spark, sf_dir):
    """The library's linear regression on two features against its closed form."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").cast("double").alias("label"), "l_quantity", "l_discount", (F.col("l_orderkey") % 4 == 0).alias("is_test"))
    prep = MF.build_matrix(li, ["l_quantity", "l_discount"], [])
    _, pred, _ = MF.fit_and_predict(prep, "linear_regression", "regression")
    return _round_reg(ME.regression_metrics(pred))


@register("tree_depth_1", sql=_reg_sql("""
WITH s AS (SELECT l_extendedprice AS y, l_quantity::DOUBLE AS x, l_orderkey % 4 = 0 AS is_test FROM lineitem),
v AS (SELECT x, count(*) AS n, sum(y) AS sy FROM s WHERE NOT is_test GROUP BY x),
c AS (SELECT x, sum(n) OVER w AS n1, sum(sy) OVER w AS s1, sum(n) OVER () AS n, sum(sy) OVER () AS sy, lead(x) OVER (ORDER BY x) AS nx
      FROM v WINDOW w AS (ORDER BY x)),
b AS (SELECT x AS cut, s1 / n1 AS lo, (sy - s1) / (n - n1) AS hi FROM c WHERE nx IS NOT NULL
      ORDER BY s1 * s1 / n1 + (sy - s1) * (sy - s1) / (n - n1) DESC LIMIT 1),
p AS (SELECT y, CASE WHEN x <= cut THEN lo ELSE hi END AS p FROM s, b WHERE is_test)"""))
def q_tree_depth_1(spark, sf_dir):
    """A regression tree of one split against the best split over all cuts."""
    from pyspark.ml.regression import DecisionTreeRegressor
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").cast("double").alias("label"), "l_quantity", (F.col("l_orderkey") % 4 == 0).alias("is_test"))
    prep = MF.build_matrix(li, ["l_quantity"], [])
    model = DecisionTreeRegressor(maxDepth=1, maxBins=128, seed=MF.SEED).fit(prep.data.where(~F.col("is_test")))
    return _round_reg(ME.regression_metrics(model.transform(prep.data.where("is_test"))))


@register("best_model", sql=f"""
WITH s AS (SELECT l_extendedprice AS y, l_quantity AS xq, l_discount AS xd, l_orderkey % 4 = 0 AS is_test FROM lineitem),
fq AS (SELECT regr_slope(y, xq) AS b, regr_intercept(y, xq) AS a FROM s WHERE NOT is_test),
fd AS (SELECT regr_slope(y, xd) AS b, regr_intercept(y, xd) AS a FROM s WHERE NOT is_test),
md AS (SELECT quantile_cont(y, 0.5) AS m FROM s WHERE NOT is_test),
p AS (
  SELECT 'baseline_regressor' AS model_key, 0 AS ord, y, m AS p FROM s, md WHERE is_test
  UNION ALL SELECT 'linreg_quantity', 1, y, fq.a + fq.b * xq FROM s, fq WHERE is_test
  UNION ALL SELECT 'linreg_discount', 2, y, fd.a + fd.b * xd FROM s, fd WHERE is_test
),
r AS (SELECT model_key, ord, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae FROM p GROUP BY 1, 2)
SELECT model_key, ord, {R('rmse', 4)} AS rmse, {R('mae', 4)} AS mae,
       row_number() OVER (ORDER BY rmse, ord)::INTEGER AS rank, row_number() OVER (ORDER BY rmse, ord) = 1 AS best
FROM r""")
def q_best_model(spark, sf_dir):
    """M27 + M34 inputs: baseline and two one-feature regressions ranked by RMSE."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"),
                                                 (F.col("l_orderkey") % 4 == 0).alias("is_test"))
    base = ME.baseline_prediction(li.where(~F.col("is_test")), "regression")
    bp = with_row(li.where("is_test"), base)
    parts = [("baseline_regressor", 0, bp), ("linreg_quantity", 1, _linreg_pred(spark, sf_dir, "l_quantity")),
             ("linreg_discount", 2, _linreg_pred(spark, sf_dir, "l_discount"))]
    res = None
    for key, ord_, pred in parts:
        m = ME.regression_metrics(pred).select(F.lit(key).alias("model_key"), F.lit(ord_).alias("ord"), "rmse", "mae")
        res = m if res is None else res.unionByName(m)
    ranked = ME.rank_models(res, "regression")
    return ranked.select("model_key", "ord", fround("rmse", 4).alias("rmse"), fround("mae", 4).alias("mae"), "rank", "best")


@register("recommend_models_regression", sql="""
WITH sh AS (SELECT count(*) AS rows FROM lineitem)
SELECT ord::INTEGER AS ord, key FROM (
  SELECT 1 AS ord, 'decision_tree_regressor' AS key FROM sh WHERE rows > 1500
  UNION ALL SELECT 2, 'random_forest' FROM sh WHERE rows > 1500
  UNION ALL SELECT 3, 'extra_trees_regressor' FROM sh WHERE rows > 1500)""")
def q_recommend_models_regression(spark, sf_dir):
    """M28 + M29: recommended models for l_extendedprice from lineitem's shape."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                                 "l_extendedprice")
    return ME.recommend_models(ME.shape_summary(li, "l_extendedprice"), "regression")


@register("recommend_models_classification", sql="""
WITH sh AS (SELECT count(*) AS rows, count(DISTINCT o_orderstatus) AS td FROM orders)
SELECT ord::INTEGER AS ord, key FROM (
  SELECT 1 AS ord, 'logistic_regression' AS key FROM sh WHERE rows <= 80 OR td <= 5
  UNION ALL SELECT 2, 'decision_tree_classifier' FROM sh WHERE rows <= 80 OR td <= 5
  UNION ALL SELECT 3, 'random_forest_classifier' FROM sh WHERE rows <= 80 OR td <= 5
  UNION ALL SELECT 4, 'gradient_boosting_classifier' FROM sh WHERE rows <= 80 OR td <= 5
  UNION ALL SELECT 5, 'xgboost_classifier' FROM sh WHERE rows <= 80 OR td <= 5)""")
def q_recommend_models_classification(spark, sf_dir):
    """M28 + M29: recommended models for o_orderstatus (knn dropped: over 1,500 rows)."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    return ME.recommend_models(ME.shape_summary(o, "o_orderstatus"), "classification")


@register("model_comparison_regression")
def q_model_comparison_regression(spark, sf_dir):
    """MLlib models for l_extendedprice (rows-only check)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                                                 "l_linestatus", "l_extendedprice")
    run = run_model_analysis(li.drop("l_orderkey"), "l_extendedprice",
                             models=["linear_regression", "ridge", "lasso", "elastic_net", "decision_tree_regressor",
                                     "random_forest"])
    return run.results.select("model_key", "ord", "rank", "best")


@register("model_comparison_classification")
def q_model_comparison_classification(spark, sf_dir):
    """MLlib classifiers for o_orderstatus (rows-only check)."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    run = run_model_analysis(o, "o_orderstatus",
                             models=["logistic_regression", "decision_tree_classifier", "random_forest_classifier"])
    return run.results.select("model_key", "ord", "rank", "best")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Top features of the best model that exposes importances (rows-only check)."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
    run = run_model_analysis(li, "l_extendedprice", models=["decision_tree_regressor", "linear_regression"])
    return spark.createDataFrame(run.importance, "feature string, importance double")


@register("residuals_linreg", sql=_LINREG_CTE.format(x="l_quantity") + f"""
SELECT {R('y', 4)} AS actual, {R('p', 4)} AS predicted, {R('y - p', 4)} AS residual FROM p""")
def q_residuals_linreg(spark, sf_dir):
    """M32 + M33: predicted-vs-actual points and residuals of the one-feature regression."""
    pts = ME.predicted_vs_actual(_linreg_pred(spark, sf_dir, "l_quantity"))
    return pts.select(fround("actual", 4).alias("actual"), fround("predicted", 4).alias("predicted"),
                      fround("residual", 4).alias("residual"))


@register("model_comparison_table", sql=f"""
WITH s AS (SELECT l_extendedprice AS y, l_quantity AS xq, l_discount AS xd, l_orderkey % 4 = 0 AS is_test FROM lineitem),
fq AS (SELECT regr_slope(y, xq) AS b, regr_intercept(y, xq) AS a FROM s WHERE NOT is_test),
fd AS (SELECT regr_slope(y, xd) AS b, regr_intercept(y, xd) AS a FROM s WHERE NOT is_test),
md AS (SELECT quantile_cont(y, 0.5) AS m FROM s WHERE NOT is_test),
p AS (
  SELECT 'baseline_regressor' AS model_key, y, m AS p FROM s, md WHERE is_test
  UNION ALL SELECT 'linreg_quantity', y, fq.a + fq.b * xq FROM s, fq WHERE is_test
  UNION ALL SELECT 'linreg_discount', y, fd.a + fd.b * xd FROM s, fd WHERE is_test
),
r AS (SELECT model_key, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae FROM p GROUP BY 1)
SELECT model_key, 'rmse' AS metric, {R('rmse', 4)} AS value FROM r
UNION ALL SELECT model_key, 'mae', {R('mae', 4)} FROM r""")
def q_model_comparison_table(spark, sf_dir):
    """RMSE / MAE per model as a long table (chart data)."""
    res = q_best_model(spark, sf_dir)
    return ME.comparison_table(res).select("model_key", "metric", fround("value", 4).alias("value"))


@register("stratified_cap", sql="""
WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
q AS (SELECT o_orderstatus, n, n * 2000.0 / (SELECT sum(n) FROM c) AS ex, floor(n * 2000.0 / (SELECT sum(n) FROM c)) AS base FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY ex - base DESC, o_orderstatus) AS rk,
             2000 - sum(base) OVER () AS short FROM q)
SELECT o_orderstatus, (base + CASE WHEN rk <= short THEN 1 ELSE 0 END)::BIGINT AS rows FROM r""")
def q_stratified_cap(spark, sf_dir):
    """M5: opt-in stratified cap of 2,000 training rows keeping class shares (the sample
    itself is the feature); checked as rows per class."""
    o = table(spark, sf_dir, "orders")
    s = MP.stratified_sample(o, "o_orderstatus", ["o_orderkey"], 2000)
    return s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
