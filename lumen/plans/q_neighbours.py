"""Registered queries of the nearest neighbours (M20); the twins compare all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.operators import neighbours as NB
from lumen.plans.registry import register
from lumen.sources.tables import table

K = 5


def _nearest_sql(rows: str) -> str:
    return f"""
WITH rows AS ({rows}),
pairs AS (
  SELECT q.id AS query, t.id, t.y, (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) AS square
  FROM rows q JOIN rows t ON q.id % 4 = 0 AND t.id % 4 <> 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY square, id) AS place FROM pairs QUALIFY place <= {K})"""


def _found(rows, kind):
    points = rows.select("id", F.array("a", "b").alias("x"), "y")
    cells = NB.Cells(points.where(F.col("id") % 4 != 0), K)
    found, _ = cells.nearest(points.where(F.col("id") % 4 == 0).select(F.col("id").alias("query"), "x"))
    return NB.predict(found, kind)


@register("knn_regression", sql=_nearest_sql(
    "SELECT p_partkey AS id, p_size::DOUBLE AS a, length(p_name)::DOUBLE AS b, p_retailprice::DOUBLE AS y FROM part")
    + f"SELECT query AS p_partkey, {R('avg(y)', 4)} AS prediction FROM best GROUP BY 1")
def q_knn_regression(spark, sf_dir):
    """p_retailprice as the mean of the 5 nearest parts by size and length of the name."""
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"),
        F.length("p_name").cast("double").alias("b"), F.col("p_retailprice").cast("double").alias("y"))
    return _found(rows, "regression").select(F.col("query").alias("p_partkey"), fround("prediction", 4).alias("prediction"))


@register("knn_classification", sql=_nearest_sql("""
  SELECT c_custkey AS id, c_acctbal::DOUBLE / 1000 AS a, c_nationkey::DOUBLE AS b,
         (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS y FROM customer WHERE c_mktsegment IS NOT NULL""")
    + """SELECT query AS c_custkey, y AS prediction FROM best GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, y) = 1""")
def q_knn_classification(spark, sf_dir):
    """c_mktsegment by vote of the 5 nearest customers by balance and nation."""
    from lumen.operators import model_prep as MP
    coded = MP.encode_target(table(spark, sf_dir, "customer"), "c_mktsegment", "classification")
    rows = coded.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal").cast("double") / 1000).alias("a"),
                        F.col("c_nationkey").cast("double").alias("b"), F.col("label").alias("y"))
    return _found(rows, "classification").select(F.col("query").alias("c_custkey"), "prediction")
