"""Registered rule queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.functions.rows import with_row
from lumen.operators import model_eval as ME
from lumen.operators import rules as N
from lumen.plans.dataset import analyze_dataset, brief_rows
from lumen.plans.q_model import q_best_model
from lumen.plans.q_profile import SCHEMAS, flags_sql, profile_sql
from lumen.plans.registry import register
from lumen.session import checkpoint_dir
from lumen.sources.tables import table

BRIEF_TABLES = ("orders", "customer", "events", "part")
_DATE_COLS = {"orders": ["o_orderdate"], "customer": [], "events": ["ts"], "part": []}


def _brief_sql_one(tbl: str) -> str:
    cols = SCHEMAS[tbl]
    names = " ".join(n.lower() for n, _ in cols)
    numeric = sum(1 for _, k in cols if k in "if")
    has_date = " OR ".join(f"(SELECT count({c}) >= 3 FROM src)" for c in _DATE_COLS[tbl]) or "false"
    kw = " OR ".join(f"contains(lower(trim(\"column\")), '{w}')" for w in __import__("lumen.operators.quality", fromlist=["x"]).TARGET_KEYWORDS)
    return f"""(WITH {profile_sql(tbl)}{flags_sql(tbl)}
SELECT '{tbl}' AS dataset, '{names}' AS names_text, {numeric} AS numeric_count, ({has_date}) AS has_date,
  (SELECT least(5, count(*)) FROM prof WHERE lower(trim("column")) NOT IN ('id', 'index', 'source_file', 'source_row_number')
     AND NOT suffix(lower(trim("column")), '_id') AND non_null > 0)::INTEGER AS target_count,
  (SELECT quality_score FROM scored) AS quality_score,
  (SELECT count(*) FROM issues)::INTEGER AS issue_rows,
  (SELECT arg_min("column", position) FROM prof WHERE missing > 0) AS first_missing_column,
  (SELECT arg_min(code, ord) FROM issues) AS first_issue_code)"""


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _cnt(col: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({col}, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


def _brief_sql() -> str:
    t = "lower(names_text)"
    kind = f"""CASE WHEN has_date AND {_any(t, N.FINANCE_WORDS)} THEN 'finance_or_time_series'
  WHEN {_cnt(t, N.VEHICLE_WORDS)} >= 2 THEN 'vehicle_sales'
  WHEN {_cnt(t, N.REAL_ESTATE_WORDS)} >= 2 THEN 'real_estate'
  WHEN {_any(t, N.MEDICAL_WORDS)} THEN 'medical_or_risk'
  WHEN {_any(t, N.SPORT_WORDS)} THEN 'sports'
  WHEN {_cnt(t, N.COMMERCE_WORDS)} >= 1 THEN 'commerce'
  WHEN {_any(t, N.PRICE_WORDS)} THEN 'price_table'
  WHEN has_date AND numeric_count > 0 THEN 'generic_time_series'
  WHEN numeric_count > 0 THEN 'generic_table'
  ELSE 'categorical_text' END"""
    rows = " UNION ALL ".join(f"SELECT * FROM {_brief_sql_one(t_)}" for t_ in BRIEF_TABLES)
    return f"""WITH b AS ({rows}),
k AS (SELECT *, {kind} AS kind FROM b),
tk AS (SELECT *, list_filter([
    CASE WHEN target_count > 0 THEN 'predict_target' END,
    CASE WHEN numeric_count >= 2 THEN 'correlation_and_distribution' END,
    CASE WHEN numeric_count >= 3 THEN 'importance_and_outliers' END,
    CASE WHEN has_date THEN 'time_series_trend' END,
    CASE WHEN kind IN ('finance_or_time_series', 'generic_time_series') THEN 'risk_and_volatility' END], lambda x: x IS NOT NULL) AS tasks FROM k)
SELECT dataset, kind,
  (CASE WHEN len(tasks) = 0 THEN ['quality_and_categories'] ELSE tasks END)[1:4] AS suitable_tasks,
  CASE WHEN quality_score < 70 THEN 'low_quality'
       WHEN first_missing_column IS NOT NULL THEN 'missing:' || first_missing_column
       WHEN first_issue_code IS NOT NULL THEN 'issue:' || first_issue_code ELSE 'none' END AS primary_risk,
  CASE WHEN quality_score >= 85 AND issue_rows <= 1 THEN 'high'
       WHEN quality_score >= 70 AND issue_rows <= 4 THEN 'medium' ELSE 'low' END AS confidence
FROM tk"""


@register("dataset_brief", sql=_brief_sql())
def q_dataset_brief(spark, sf_dir):
    """Dataset kind, suitable tasks, primary risk and data confidence for four tables."""
    return N.dataset_brief(reduce(DataFrame.unionByName, brief_rows({t: table(spark, sf_dir, t) for t in BRIEF_TABLES})))


@register("model_findings", sql="WITH " + profile_sql("lineitem") + flags_sql("lineitem") + f""",
s AS (SELECT l_extendedprice AS y, l_quantity AS xq, l_discount AS xd, l_orderkey % 4 = 0 AS is_test FROM lineitem),
fq AS (SELECT regr_slope(y, xq) AS b, regr_intercept(y, xq) AS a FROM s WHERE NOT is_test),
fd AS (SELECT regr_slope(y, xd) AS b, regr_intercept(y, xd) AS a FROM s WHERE NOT is_test),
md AS (SELECT quantile_cont(y, 0.5) AS m FROM s WHERE NOT is_test),
p AS (
  SELECT 'baseline_regressor' AS model_key, 0 AS ord, y, m AS p FROM s, md WHERE is_test
  UNION ALL SELECT 'linreg_quantity', 1, y, fq.a + fq.b * xq FROM s, fq WHERE is_test
  UNION ALL SELECT 'linreg_discount', 2, y, fd.a + fd.b * xd FROM s, fd WHERE is_test
),
r AS (SELECT model_key, ord, sqrt(avg((y - p) * (y - p))) AS rmse,
             1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (ORDER BY rmse, ord) AS rank FROM r),
j AS (SELECT (SELECT model_key FROM rk WHERE rank = 1) AS best_model, (SELECT r2 FROM rk WHERE rank = 1) AS r2,
             (SELECT rmse FROM rk WHERE rank = 1) AS best_rmse, (SELECT rmse FROM rk WHERE model_key LIKE 'baseline%') AS base_rmse,
             (SELECT quality_score FROM scored) AS q, (SELECT count(*) FROM issues) AS issue_rows,
             (SELECT issue_count FROM scored) AS issue_count),
l AS (SELECT *, CASE WHEN base_rmse IS NOT NULL AND base_rmse <> 0 THEN greatest(0.0, (base_rmse - best_rmse) / abs(base_rmse) * 100) END AS lift FROM j),
c AS (SELECT *, CASE WHEN q < 70 THEN 'low'
       WHEN r2 >= 0.7 AND (lift IS NULL OR lift > 10) THEN CASE WHEN q >= 85 THEN 'high' ELSE 'medium' END
       WHEN r2 >= 0.35 THEN 'medium' ELSE 'low' END AS lvl FROM l)
SELECT 'lineitem_price' AS run_id, best_model, {R('lift', 6)} AS rmse_lift_pct,
  CASE WHEN q >= 70 AND issue_rows > 0 AND lvl = 'high' THEN 'medium' ELSE lvl END AS model_confidence,
  CASE WHEN q < 70 OR issue_count >= 4 THEN 'fix_data_quality' ELSE 'prediction_baseline' END AS next_action,
  CASE WHEN r2 >= 0.7 THEN 'explains_target' WHEN r2 >= 0.35 THEN 'some_signal' ELSE 'weak_signal' END AS result_interpretation
FROM c""")
def q_model_findings(spark, sf_dir):
    """Model confidence, lift over baseline, next action and interpretation."""
    from lumen.plans.q_model import _linreg_pred
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"),
                                                 (F.col("l_orderkey") % 4 == 0).alias("is_test"))
    base = ME.baseline_prediction(li.where(~F.col("is_test")), "regression")
    bp = with_row(li.where("is_test"), base)
    res = None
    for key, ord_, pred in [("baseline_regressor", 0, bp),
                            ("linreg_quantity", 1, _linreg_pred(spark, sf_dir, "l_quantity")),
                            ("linreg_discount", 2, _linreg_pred(spark, sf_dir, "l_discount"))]:
        m = ME.regression_metrics(pred).select(F.lit(key).alias("model_key"), F.lit(ord_).alias("ord"), "r2", "rmse",
                                               F.lit(None).cast("double").alias("accuracy"),
                                               F.lit(None).cast("double").alias("f1_score"))
        res = m if res is None else res.unionByName(m)
    ranked = ME.rank_models(res, "regression").withColumn("run_id", F.lit("lineitem_price"))
    a = analyze_dataset(table(spark, sf_dir, "lineitem"), "lineitem")
    run = a.summary.select(F.lit("lineitem_price").alias("run_id"), F.lit("regression").alias("problem_type"),
                           "quality_score", "issue_count", F.lit(False).alias("has_finance_label")) \
        .transform(lambda s: with_row(s, a.issues.agg(F.count(F.lit(1)).alias("issue_rows"))))
    checkpoint_dir(spark)
    f = N.model_findings(ranked.checkpoint(), run.checkpoint())   # a row per model, a row per run
    return f.select("run_id", "best_model", fround("rmse_lift_pct", 6).alias("rmse_lift_pct"), "model_confidence",
                    "next_action", "result_interpretation")


@register("recommendation_scores", sql="""
WITH sh AS (SELECT count(*) AS rows FROM lineitem),
k AS (SELECT 1 AS ord, 'decision_tree_regressor' AS key, 'tree' AS family, 'medium' AS complexity FROM sh WHERE rows > 1500
      UNION ALL SELECT 2, 'random_forest', 'ensemble', 'medium' FROM sh WHERE rows > 1500
      UNION ALL SELECT 3, 'extra_trees_regressor', 'ensemble', 'medium' FROM sh WHERE rows > 1500)
SELECT ord::INTEGER AS ord, key, greatest(1, least(5, 3
   + CASE WHEN family IN ('ensemble', 'boosting') AND (5 >= 5 OR 0 > 0) THEN 1 ELSE 0 END
   + CASE WHEN family = 'linear' AND rows < 120 THEN 1 ELSE 0 END
   - CASE WHEN complexity = 'high' AND rows < 50 THEN 1 ELSE 0 END))::INTEGER AS score
FROM k, sh""")
def q_recommendation_scores(spark, sf_dir):
    """1-5 recommendation score of each recommended model (lineitem, target l_extendedprice)."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                                                 "l_extendedprice")
    shape = ME.shape_summary(li, "l_extendedprice")
    rec = ME.recommend_models(shape, "regression")
    cat = ME.catalog_df(spark).select("key", "family", "complexity")
    j = with_row(rec.join(cat, on="key"), shape)
    return j.select("ord", "key", N.recommendation_score(F.col("family"), F.col("complexity"), F.col("rows"),
                                                          F.col("feature_count"), F.lit(0)).alias("score"))


@register("metric_bands", sql="""
WITH RECURSIVE""" + __import__("lumen.plans.q_finance", fromlist=["x"])._DAILY_ORDERS + "," + __import__(
    "lumen.plans.q_finance", fromlist=["x"])._ind_sql() + f""",
m AS (
  SELECT 'rsi' AS metric, arg_max(rsi, idx) FILTER (WHERE rsi IS NOT NULL) AS value FROM ind
  UNION ALL SELECT 'volatility', arg_max(volatility, idx) FILTER (WHERE volatility IS NOT NULL) FROM ind
)
SELECT metric, {R('value', 6)} AS value,
  CASE WHEN metric = 'rsi' THEN CASE WHEN value >= 70 THEN 'overheated' WHEN value > 30 + 1e-12 THEN 'neutral' ELSE 'oversold' END
       ELSE CASE WHEN value >= 0.05 THEN 'high' WHEN value >= 0.02 THEN 'moderate' ELSE 'low' END END AS band
FROM m""")
def q_metric_bands(spark, sf_dir):
    """Interpretation bands of the latest RSI and volatility of the daily order price."""
    from lumen.operators import series as S
    from lumen.plans.q_finance import orders_indicators
    lm = S.latest_metrics(orders_indicators(spark, sf_dir))
    metrics = lm.select(F.explode(F.array(
        F.struct(F.lit("rsi").alias("metric"), F.col("latest_rsi").alias("value")),
        F.struct(F.lit("volatility").alias("metric"), F.col("latest_volatility").alias("value")))).alias("m")).select("m.*")
    b = N.metric_bands(metrics, N.bands_df(spark))
    return b.select("metric", fround("value", 6).alias("value"), "band")


@register("metric_bands_all", sql=f"""
WITH m AS (
  SELECT DISTINCT ['data_completeness', 'r2', 'accuracy', 'f1_score', 'rsi', 'volatility', 'rmse', 'mae', 'var', 'forecast', 'other'][(l_orderkey % 11 + 1)::INT] AS metric,
         CASE WHEN l_orderkey % 11 = 4 THEN l_quantity * 2 WHEN l_orderkey % 11 = 5 THEN l_discount ELSE l_discount * 10 END AS value
  FROM lineitem)
SELECT metric, {R('value', 6)} AS value, CASE metric
  WHEN 'data_completeness' THEN CASE WHEN value >= 0.95 THEN 'complete' WHEN value >= 0.8 THEN 'usable' ELSE 'sparse' END
  WHEN 'r2' THEN CASE WHEN value >= 0.7 THEN 'strong' WHEN value >= 0.35 THEN 'moderate' ELSE 'weak' END
  WHEN 'accuracy' THEN CASE WHEN value >= 0.8 THEN 'high' ELSE 'needs_work' END
  WHEN 'f1_score' THEN CASE WHEN value >= 0.75 THEN 'balanced' ELSE 'weak' END
  WHEN 'rsi' THEN CASE WHEN value >= 70 THEN 'overheated' WHEN value > 30 THEN 'neutral' ELSE 'oversold' END
  WHEN 'volatility' THEN CASE WHEN value >= 0.05 THEN 'high' WHEN value >= 0.02 THEN 'moderate' ELSE 'low' END
  WHEN 'rmse' THEN 'typical_error' WHEN 'mae' THEN 'typical_error' WHEN 'var' THEN 'downside_risk'
  WHEN 'forecast' THEN 'baseline_estimate' ELSE 'read_with_context' END AS band
FROM m""")
def q_metric_bands_all(spark, sf_dir):
    """Every metric's bands over the values that line items give."""
    li = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(x) for x in ("data_completeness", "r2", "accuracy", "f1_score", "rsi", "volatility", "rmse", "mae", "var", "forecast", "other")])
    kind = F.col("l_orderkey") % 11
    value = (F.when(kind == 4, F.col("l_quantity") * 2).when(kind == 5, F.col("l_discount")).otherwise(F.col("l_discount") * 10)).cast("double")
    metrics = li.select(F.element_at(names, (kind + 1).cast("int")).alias("metric"), value.alias("value")).distinct()
    return N.metric_bands(metrics, N.bands_df(spark)).select("metric", fround("value", 6).alias("value"), "band")


@register("prerun_advice", sql="""
SELECT c AS "column", task AS suggested_task, (SELECT (count(*) - count(l_discount)) + (count(*) - count(l_tax))
  + (count(*) - count(l_returnflag)) FROM (SELECT CASE WHEN l_partkey % 13 <> 0 THEN l_discount END AS l_discount,
  CASE WHEN l_partkey % 29 <> 0 THEN l_tax END AS l_tax, CASE WHEN l_partkey % 7 <> 0 THEN l_returnflag END AS l_returnflag
  FROM lineitem))::BIGINT AS missing_cells, 11::BIGINT AS candidates
FROM (VALUES ('l_orderkey', 'regression'), ('l_partkey', 'regression'), ('l_suppkey', 'regression'),
             ('l_linenumber', 'regression'), ('l_quantity', 'regression'), ('l_extendedprice', 'regression'),
             ('l_discount', 'regression'), ('l_tax', 'regression'), ('l_returnflag', 'classification'),
             ('l_linestatus', 'classification'), ('l_shipdate', 'classification')) t(c, task)""")
def q_prerun_advice(spark, sf_dir):
    """Suggested task per candidate target, missing cells and candidate count."""
    from lumen.operators import profile as P
    from lumen.plans.q_profile import lineitem_with_holes
    return N.prerun_advice(P.missing_counts(lineitem_with_holes(spark, sf_dir)))
