"""Registered multi-table queries (U1-U8): the TPC-style tables with their one-letter
column prefix removed, so that shared attributes (name, nationkey, custkey...) meet by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.operators import combine as C
from lumen.plans.registry import register
from lumen.sources.tables import table


def stripped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    prefix = df.columns[0].split("_")[0] + "_"
    return df.select(*[F.col(c).alias(c[len(prefix):]) for c in df.columns])


def people(spark, sf_dir):
    return [(n, stripped(spark, sf_dir, n)) for n in ("customer", "supplier", "nation")]


_ORDER = {"customer": ["custkey"], "supplier": ["suppkey"], "nation": ["nationkey"]}

_STRIP_SQL = """
c AS (SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer),
s AS (SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier),
n AS (SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation)"""


@register("union_by_name", sql="WITH " + _STRIP_SQL + """
SELECT * FROM (SELECT *, 'customer' AS source_file, row_number() OVER (ORDER BY custkey) AS source_row_number FROM c)
UNION ALL BY NAME (SELECT *, 'supplier' AS source_file, row_number() OVER (ORDER BY suppkey) AS source_row_number FROM s)
UNION ALL BY NAME (SELECT *, 'nation' AS source_file, row_number() OVER (ORDER BY nationkey) AS source_row_number FROM n)""")
def q_union_by_name(spark, sf_dir):
    """Union of customer, supplier and nation by column name with provenance."""
    return C.union_by_name(people(spark, sf_dir), order_by=_ORDER)


@register("union_row_counts", sql="""
SELECT 'customer' AS source_file, count(*)::BIGINT AS rows FROM customer
UNION ALL SELECT 'supplier', count(*)::BIGINT FROM supplier
UNION ALL SELECT 'nation', count(*)::BIGINT FROM nation""")
def q_union_row_counts(spark, sf_dir):
    """Rows per source in the union."""
    return C.source_row_counts(C.union_by_name(people(spark, sf_dir), order_by=_ORDER))


_JOIN_KEYS_SQL = "WITH " + _STRIP_SQL + """,
r AS (
  SELECT 'name' AS "column", count(DISTINCT name) / greatest(count(name), 1) AS ratio FROM c
  UNION ALL SELECT 'name', count(DISTINCT name) / greatest(count(name), 1) FROM s
  UNION ALL SELECT 'name', count(DISTINCT name) / greatest(count(name), 1) FROM n
  UNION ALL SELECT 'nationkey', count(DISTINCT nationkey) / greatest(count(nationkey), 1) FROM c
  UNION ALL SELECT 'nationkey', count(DISTINCT nationkey) / greatest(count(nationkey), 1) FROM s
  UNION ALL SELECT 'nationkey', count(DISTINCT nationkey) / greatest(count(nationkey), 1) FROM n
),
k AS (
  SELECT "column", least(1.0, avg(ratio)
     + CASE WHEN lower("column") = 'id' OR lower("column") LIKE '%\\_id' ESCAPE '\\' THEN 0.25 ELSE 0 END
     + CASE WHEN contains(lower("column"), 'date') OR contains(lower("column"), 'time') THEN 0.15 ELSE 0 END) AS confidence
  FROM r GROUP BY 1
)"""


@register("join_key_candidates", sql=_JOIN_KEYS_SQL + f"""
SELECT "column", {R('confidence', 6)} AS confidence FROM k WHERE confidence >= 0.65
ORDER BY confidence DESC, "column" LIMIT 5""")
def q_join_key_candidates(spark, sf_dir):
    """Ranked join-key candidates among the common columns."""
    k = C.join_key_candidates(spark, people(spark, sf_dir))
    return k.select("column", fround("confidence", 6).alias("confidence"))


@register("merge_plan", sql=_JOIN_KEYS_SQL + """
SELECT 3 AS source_file_count, ['name', 'nationkey'] AS common_columns, 7 AS union_column_count,
  5 AS unique_column_count, 2 / 7 AS common_column_ratio,
  CASE WHEN 2 / 7 >= 0.45 THEN 'append' ELSE 'separate_analysis' END AS recommended_strategy,
  true AS append_enabled, (SELECT count(*) FROM k WHERE confidence >= 0.65) > 0 AS join_enabled,
  true AS separate_enabled""")
def q_merge_plan(spark, sf_dir):
    """Merge strategy advice for customer, supplier and nation."""
    return C.merge_plan(spark, people(spark, sf_dir))


_OC_SQL = """
o AS (SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS orderstatus, o_totalprice AS totalprice,
             o_orderdate AS orderdate, o_orderpriority AS orderpriority FROM orders),
c AS (SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer)"""


@register("join_orders_customer", sql="WITH " + _OC_SQL + """
SELECT * FROM o LEFT JOIN c USING (custkey)""")
def q_join_orders_customer(spark, sf_dir):
    """U8: orders left-joined to customers on the shared key."""
    return C.join_on_key(stripped(spark, sf_dir, "orders"), stripped(spark, sf_dir, "customer"), "custkey", "left")


@register("customers_without_orders", sql="WITH " + _OC_SQL + """
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.custkey = c.custkey)""")
def q_customers_without_orders(spark, sf_dir):
    """U8 (anti join): customers with no order."""
    return C.join_on_key(stripped(spark, sf_dir, "customer"), stripped(spark, sf_dir, "orders"), "custkey", "left_anti")


@register("union_documents_pages", sql="""
SELECT doc_id, text, lang, source, NULL::BIGINT AS page_id, NULL AS url, NULL AS html, 'documents' AS source_file,
       row_number() OVER (ORDER BY doc_id) AS source_row_number FROM documents
UNION ALL
SELECT NULL, NULL, NULL, NULL, page_id, url, html, 'pages', row_number() OVER (ORDER BY page_id) FROM pages""")
def q_union_documents_pages(spark, sf_dir):
    """Two tables of long texts under each other, numbered in the order of their ids."""
    docs = table(spark, sf_dir, "documents").drop("n_chars")
    return C.union_by_name([("documents", docs), ("pages", table(spark, sf_dir, "pages"))],
                           order_by={"documents": ["doc_id"], "pages": ["page_id"]})


@register("union_clashing_types", sql="""
SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(c_acctbal AS DOUBLE) AS amount, NULL AS note FROM customer
UNION ALL SELECT 'S' || s_suppkey, CAST(s_suppkey AS DOUBLE), NULL FROM supplier
UNION ALL SELECT NULL, NULL, n_name FROM nation""")
def q_union_clashing_types(spark, sf_dir):
    """A column that is a number in one input, text in another and not in the third."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("amount"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("code"), F.col("s_suppkey").alias("amount"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("note"))
    return C.union_by_name([("c", c), ("s", s), ("n", n)], provenance=False)
