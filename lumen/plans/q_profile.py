"""Registered profile and quality queries (P1-P20) over lineitem, customer, orders, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.operators import profile as P
from lumen.operators import quality as Q
from lumen.plans.registry import register
from lumen.sources.tables import table

# column lists of the given tables (kind: i = integer, f = float, s = text, t = timestamp)
SCHEMAS = {
    "lineitem": [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"),
                 ("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
    "customer": [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "f"),
                 ("c_mktsegment", "s")],
    "events": [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "f"),
               ("props", "s")],
    "part": [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"),
             ("p_retailprice", "f")],
    "documents": [("doc_id", "i"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "i")],
    "embeddings": [("vec_id", "i"), ("embedding", "a"), ("label", "i")],
    "supplier": [("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "f")],
    "orders": [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "f"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
}
_LTYPE = {"i": "int64", "f": "float64", "s": "object", "t": "datetime64[ns]", "a": "array"}
_FAMILY = {"i": "Numeric", "f": "Numeric", "s": "Text", "t": "Date-time", "a": "Text"}

# lineitem with deterministic holes, so that missing-value rules have something to count
LINEITEM_HOLES = {"l_discount": 13, "l_tax": 29, "l_returnflag": 7}


def lineitem_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = []
    for name, _ in SCHEMAS["lineitem"]:
        if name in LINEITEM_HOLES:
            cols.append(F.when(F.col("l_partkey") % LINEITEM_HOLES[name] != 0, F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return li.select(*cols)


def _holes_sql() -> str:
    cols = []
    for name, _ in SCHEMAS["lineitem"]:
        if name in LINEITEM_HOLES:
            cols.append(f"CASE WHEN l_partkey % {LINEITEM_HOLES[name]} <> 0 THEN {name} END AS {name}")
        else:
            cols.append(name)
    return f"(SELECT {', '.join(cols)} FROM lineitem)"


def _text_sql(name: str, kind: str) -> str:
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({name} AS VARCHAR)"


def _top_value_sql(name: str, kind: str) -> str:
    """Most frequent value, ties to the smallest grouping key; texts over 256 characters
    are keyed by chr(0) || 'sha256:' || digest and reported as their text."""
    v = _text_sql(name, kind)
    if kind != "s":
        return (f"(SELECT min(v) FROM (SELECT {v} AS v, count(*) AS n FROM src WHERE {name} IS NOT NULL GROUP BY 1 "
                f"QUALIFY n = max(n) OVER ()))")
    key = f"CASE WHEN length({v}) > 256 THEN chr(0) || 'sha256:' || sha256({v}) ELSE {v} END"
    return (f"(SELECT arg_min(v, k) FROM (SELECT {key} AS k, min({v}) AS v, count(*) AS n FROM src "
            f"WHERE {name} IS NOT NULL GROUP BY 1 QUALIFY n = max(n) OVER ()))")


def profile_sql(tbl: str, source: str | None = None) -> str:
    """CTE ``prof`` with the same columns as :func:`lumen.operators.profile.column_profile`."""
    src = source or tbl
    parts = []
    for pos, (name, kind) in enumerate(SCHEMAS[tbl]):
        numeric = kind in "if"
        num = (lambda e: f"CAST({e} AS DOUBLE)") if numeric else (lambda e: "CAST(NULL AS DOUBLE)")
        parts.append(f"""
  SELECT {pos} AS position, '{name}' AS "column", '{_LTYPE[kind]}' AS logical_type,
    '{_FAMILY[kind]}' AS type_family, {str(numeric).lower()} AS is_numeric,
    count(*)::BIGINT AS row_count, count({name})::BIGINT AS non_null,
    (count(*) - count({name}))::BIGINT AS missing, count(DISTINCT {name})::BIGINT AS "distinct",
    coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM src WHERE {name} IS NOT NULL GROUP BY {name})), 0)::BIGINT AS top_count,
    {_top_value_sql(name, kind)} AS top_value,
    {num(f'avg({name})')} AS mean, {num(f'stddev_samp({name})')} AS std,
    {num(f'min({name})')} AS min, {num(f'max({name})')} AS max,
    {num(f'quantile_cont({name}, 0.25)')} AS p25, {num(f'quantile_cont({name}, 0.5)')} AS p50,
    {num(f'quantile_cont({name}, 0.75)')} AS p75
  FROM src""")
    return f"src AS (SELECT * FROM {src}),\nprof AS ({' UNION ALL '.join(parts)})"


def _round_profile(df: DataFrame) -> DataFrame:
    return df.select(
        "position", "column", "logical_type", "type_family", "is_numeric", "row_count", "non_null", "missing",
        "distinct", "top_count", "top_value", fround("mean", 4).alias("mean"), fround("std", 4).alias("std"),
        fround("min", 6).alias("min"), fround("max", 6).alias("max"), fround("p25", 6).alias("p25"),
        fround("p50", 6).alias("p50"), fround("p75", 6).alias("p75"))


_ROUND_PROFILE_SQL = f"""
SELECT position, "column", logical_type, type_family, is_numeric, row_count, non_null, missing, "distinct",
  top_count, top_value, {R('mean', 4)} AS mean, {R('std', 4)} AS std, {R('min', 6)} AS min, {R('max', 6)} AS max,
  {R('p25', 6)} AS p25, {R('p50', 6)} AS p50, {R('p75', 6)} AS p75
FROM prof"""


def _profile(spark, sf_dir, name):
    df = table(spark, sf_dir, name)
    return P.column_profile(df)


@register("profile_lineitem", sql="WITH " + profile_sql("lineitem") + _ROUND_PROFILE_SQL)
def q_profile_lineitem(spark, sf_dir):
    """Per-column profile of lineitem (one aggregate + one histogram)."""
    return _round_profile(_profile(spark, sf_dir, "lineitem"))


@register("profile_customer", sql="WITH " + profile_sql("customer") + _ROUND_PROFILE_SQL)
def q_profile_customer(spark, sf_dir):
    """Per-column profile of customer."""
    return _round_profile(_profile(spark, sf_dir, "customer"))


@register("profile_missing", sql="WITH " + profile_sql("lineitem", _holes_sql()) + """
SELECT position, "column", missing, round(missing / greatest(row_count, 1), 4) AS missing_ratio
FROM prof WHERE missing > 0""")
def q_profile_missing(spark, sf_dir):
    """Missing counts and ratios (columns with any missing cell)."""
    p = P.missing_counts(lineitem_with_holes(spark, sf_dir))
    return p.where(F.col("missing") > 0).select(
        "position", "column", "missing",
        F.round(F.col("missing") / F.greatest(F.col("row_count"), F.lit(1)), 4).alias("missing_ratio"))


@register("duplicate_rows", sql="""
SELECT coalesce(sum(c - 1), 0)::BIGINT AS duplicate_rows
FROM (SELECT count(*) AS c FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0) GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""")
def q_duplicate_rows(spark, sf_dir):
    """Duplicates among whole rows of lineitem, some of which are there twice."""
    li = table(spark, sf_dir, "lineitem")
    return P.duplicate_rows(li.union(li.where(F.col("l_orderkey") % 7 == 0)))


_EVENTS_IQR_SQL = f"""
WITH q AS (SELECT quantile_cont(event_id, 0.25) AS a1, quantile_cont(event_id, 0.75) AS a3,
                  quantile_cont(user_id, 0.25) AS b1, quantile_cont(user_id, 0.75) AS b3,
                  quantile_cont(value, 0.25) AS c1, quantile_cont(value, 0.75) AS c3 FROM events),
b AS (
  SELECT 0 AS position, 'event_id' AS "column", a1 - 1.5 * (a3 - a1) AS lo, a3 + 1.5 * (a3 - a1) AS hi, a3 - a1 AS iqr FROM q
  UNION ALL SELECT 2, 'user_id', b1 - 1.5 * (b3 - b1), b3 + 1.5 * (b3 - b1), b3 - b1 FROM q
  UNION ALL SELECT 4, 'value', c1 - 1.5 * (c3 - c1), c3 + 1.5 * (c3 - c1), c3 - c1 FROM q
),
c AS (
  SELECT b.position, b."column", b.lo, b.hi, b.iqr, count(v) AS n,
         count(*) FILTER (WHERE v < b.lo OR v > b.hi) AS cnt
  FROM b JOIN (SELECT 0 AS position, CAST(event_id AS DOUBLE) AS v FROM events
               UNION ALL SELECT 2, CAST(user_id AS DOUBLE) FROM events
               UNION ALL SELECT 4, value FROM events) x ON x.position = b.position
  GROUP BY ALL
)
SELECT position, "column", cnt::BIGINT AS count, {R('cnt / n', 6)} AS ratio,
       {R('lo', 6)} AS lower_bound, {R('hi', 6)} AS upper_bound
FROM c WHERE n >= 4 AND iqr <> 0 AND cnt > 0"""


@register("iqr_outliers", sql=_EVENTS_IQR_SQL)
def q_iqr_outliers(spark, sf_dir):
    """IQR outliers of every numeric column of events."""
    o = P.iqr_outliers(table(spark, sf_dir, "events"))
    return o.select("position", "column", "count", fround("ratio", 6).alias("ratio"),
                    fround("lower_bound", 6).alias("lower_bound"), fround("upper_bound", 6).alias("upper_bound"))


@register("date_frequency", sql=f"""
WITH x AS (SELECT 1 AS position, 'ts' AS "column", ts AS v FROM events),
g AS (SELECT position, epoch_us(v) - lag(epoch_us(v)) OVER (PARTITION BY position ORDER BY v) AS gap FROM x)
SELECT x.position, x."column", count(v) / count(*) AS valid_ratio,
       {R('(SELECT median(gap) FROM g) / 1e6', 2)} AS median_interval_seconds, min(v) AS start, max(v) AS "end"
FROM x GROUP BY ALL""")
def q_date_frequency(spark, sf_dir):
    """Date-like columns of events: valid ratio, median gap, start, end."""
    d = P.date_frequency(table(spark, sf_dir, "events"))
    return d.select("position", "column", "valid_ratio",
                    fround("median_interval_seconds", 2).alias("median_interval_seconds"), "start", "end")


def _quality_parts(spark, sf_dir):
    from lumen.plans.dataset import analyze_dataset
    a = analyze_dataset(lineitem_with_holes(spark, sf_dir), "lineitem")
    return a.profile, a.flags, a.summary


def flags_sql(tbl: str) -> str:
    """CTEs ``outl``, ``flags``, ``summ``, ``scored``, ``issues`` on top of ``src`` / ``prof``."""
    cols = SCHEMAS[tbl]
    numeric_union = " UNION ALL ".join(
        f"SELECT {i} AS position, CAST({n} AS DOUBLE) AS v FROM src" for i, (n, k) in enumerate(cols) if k in "if")
    leak = " OR ".join(f"contains(lower(trim(p.\"column\")), '{w}')" for w in Q.LEAKAGE_KEYWORDS)
    group_all = ", ".join(n for n, _ in cols)
    issue_sum = ("(constant_columns + high_cardinality_columns + outlier_columns + imbalanced_columns"
                 " + leakage_columns + CASE WHEN duplicate_rows > 0 THEN 1 ELSE 0 END"
                 " + CASE WHEN missing_total > 0 THEN 1 ELSE 0 END)")
    return f""",
outl AS (
  SELECT p.position FROM prof p JOIN ({numeric_union}) x ON x.position = p.position
  WHERE p.is_numeric AND v IS NOT NULL
  GROUP BY p.position, p.p25, p.p75, p.non_null
  HAVING p.non_null >= 4 AND p.p75 - p.p25 <> 0
     AND count(*) FILTER (WHERE v < p.p25 - 1.5 * (p.p75 - p.p25) OR v > p.p75 + 1.5 * (p.p75 - p.p25)) > 0
),
flags AS (
  SELECT p.position, p."column",
    (p.non_null = 0 OR p."distinct" <= 1) AS is_constant,
    (p.non_null > 0 AND p."distinct" / greatest(p.non_null, 1) >= 0.9 AND p.non_null >= 10) AS is_high_cardinality,
    (p.non_null > 0 AND (lower(trim(p."column")) = 'id' OR suffix(lower(trim(p."column")), '_id')
                         OR p."distinct" / greatest(p.non_null, 1) >= 0.98)) AS is_id_like,
    (p.non_null > 0 AND p."distinct" <= least(20, greatest(2, floor(p.row_count / 2))) AND p."distinct" >= 2
       AND p.top_count / p.non_null >= 0.8) AS is_imbalanced,
    ({leak}) AS is_leakage,
    (o.position IS NOT NULL) AS has_outliers
  FROM prof p LEFT JOIN outl o ON o.position = p.position
),
summ AS (
  SELECT
    count(*) FILTER (WHERE is_constant)::BIGINT AS constant_columns,
    count(*) FILTER (WHERE is_high_cardinality)::BIGINT AS high_cardinality_columns,
    count(*) FILTER (WHERE is_id_like)::BIGINT AS id_like_columns,
    count(*) FILTER (WHERE has_outliers)::BIGINT AS outlier_columns,
    count(*) FILTER (WHERE is_imbalanced)::BIGINT AS imbalanced_columns,
    count(*) FILTER (WHERE is_leakage)::BIGINT AS leakage_columns,
    (SELECT max(row_count) FROM prof)::BIGINT AS row_count,
    (SELECT count(*) FROM prof)::BIGINT AS column_count,
    (SELECT sum(missing) FROM prof)::BIGINT AS missing_total,
    (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM src GROUP BY {group_all}))::BIGINT AS duplicate_rows
  FROM flags
),
scored AS (
  SELECT *, {issue_sum}::BIGINT AS issue_count,
    greatest(0, 100 - least(35, round_even(missing_total / greatest(row_count * column_count, 1) * 100, 0))
              - least(20, round_even(duplicate_rows / greatest(row_count, 1) * 100, 0))
              - least(30, {issue_sum} * 3))::INTEGER AS quality_score
  FROM summ
),
issues AS (
  SELECT 2 AS ord, 'warning' AS severity, 'missing_values' AS code FROM scored WHERE missing_total > 0
  UNION ALL SELECT 3, 'warning', 'duplicate_rows' FROM scored WHERE duplicate_rows > 0
  UNION ALL SELECT 4, 'info', 'constant_columns' FROM scored WHERE constant_columns > 0
  UNION ALL SELECT 5, 'info', 'high_cardinality' FROM scored WHERE high_cardinality_columns > 0
  UNION ALL SELECT 6, 'warning', 'outliers' FROM scored WHERE outlier_columns > 0
  UNION ALL SELECT 7, 'warning', 'class_imbalance' FROM scored WHERE imbalanced_columns > 0
  UNION ALL SELECT 8, 'danger', 'target_leakage' FROM scored WHERE leakage_columns > 0
)"""


_FLAGS_SQL = flags_sql("lineitem")



@register("quality_flags", sql="WITH " + profile_sql("lineitem", _holes_sql()) + _FLAGS_SQL + """
SELECT position, "column", is_constant, is_high_cardinality, is_id_like, is_imbalanced, is_leakage, has_outliers FROM flags""")
def q_quality_flags(spark, sf_dir):
    """Per-column quality flags of lineitem (with holes)."""
    _, flags, _ = _quality_parts(spark, sf_dir)
    return flags.select("position", "column", "is_constant", "is_high_cardinality", "is_id_like",
                        "is_imbalanced", "is_leakage", "has_outliers")


@register("quality_score", sql="WITH " + profile_sql("lineitem", _holes_sql()) + _FLAGS_SQL + """
SELECT constant_columns, high_cardinality_columns, id_like_columns, outlier_columns, imbalanced_columns,
  leakage_columns, row_count, column_count, missing_total, duplicate_rows, issue_count, quality_score,
  false AS is_profiled_sample
FROM scored""")
def q_quality_score(spark, sf_dir):
    """Quality score of lineitem (with holes)."""
    return _quality_parts(spark, sf_dir)[2]


@register("quality_issues", sql="WITH " + profile_sql("lineitem", _holes_sql()) + _FLAGS_SQL + """
SELECT * FROM issues""")
def q_quality_issues(spark, sf_dir):
    """Issue list of lineitem (with holes), fixed order and severity."""
    return Q.quality_issues(_quality_parts(spark, sf_dir)[2])


def _targets_sql(tbl: str) -> str:
    kw = " OR ".join(f"contains(lower(trim(\"column\")), '{w}')" for w in Q.TARGET_KEYWORDS)
    return "WITH " + profile_sql(tbl) + f"""
SELECT "column", score, rank FROM (
  SELECT "column", score, row_number() OVER (ORDER BY score DESC, "column")::INTEGER AS rank FROM (
    SELECT "column", (CASE WHEN is_numeric OR logical_type = 'bool'
                   THEN 30 + CASE WHEN "distinct" > least(10, greatest(3, floor(non_null * 0.3))) THEN 20 ELSE 0 END
                   ELSE 8 + CASE WHEN "distinct" BETWEEN 2 AND 20 THEN 15 ELSE 0 END END
              + CASE WHEN ({kw}) OR lower(trim("column")) = 'y' THEN 30 ELSE 0 END)::INTEGER AS score
    FROM prof
    WHERE lower(trim("column")) NOT IN ('id', 'index', 'source_file', 'source_row_number')
      AND NOT lower(trim("column")) LIKE '%\\_id' ESCAPE '\\' AND non_null > 0))
WHERE rank <= 5"""


@register("recommend_targets", sql=_targets_sql("lineitem"))
def q_recommend_targets(spark, sf_dir):
    """Recommended target columns of lineitem."""
    return Q.recommend_targets(P.column_profile(table(spark, sf_dir, "lineitem"), quantiles=False))


@register("recommend_targets_events", sql=_targets_sql("events"))
def q_recommend_targets_events(spark, sf_dir):
    """Recommended target columns of events."""
    return Q.recommend_targets(P.column_profile(table(spark, sf_dir, "events"), quantiles=False))


@register("profile_decimals", sql="""
SELECT 0 AS position, count(*)::BIGINT AS non_null, count(DISTINCT (o_orderkey, o_custkey))::BIGINT AS "distinct" FROM orders
UNION ALL
SELECT 1, count(*)::BIGINT, count(DISTINCT CAST(o_totalprice AS DECIMAL(12, 2)))::BIGINT FROM orders""")
def q_profile_decimals(spark, sf_dir):
    """P5: distinct decimals, also such as differ beyond a double's digits."""
    o = table(spark, sf_dir, "orders")
    wide = F.col("o_orderkey").cast("decimal(17,0)") * F.lit("1000000000000000000000").cast("decimal(22,0)")
    df = o.select((wide.cast("decimal(38,0)") + F.col("o_custkey").cast("decimal(10,0)")).cast("decimal(38,0)").alias("big"),
                  F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return P.column_profile(df, quantiles=False).select("position", "non_null", "distinct")


@register("type_distribution", sql="WITH " + profile_sql("events") + """
SELECT type_family, count(*)::BIGINT AS columns FROM prof GROUP BY 1""")
def q_type_distribution(spark, sf_dir):
    """Columns per type family (events)."""
    return P.type_distribution(P.type_families(table(spark, sf_dir, "events")))


@register("top_missing", sql="WITH " + profile_sql("lineitem", _holes_sql()) + """
SELECT rank, "column", missing FROM (
  SELECT row_number() OVER (ORDER BY missing DESC, position)::INTEGER AS rank, "column", missing FROM prof WHERE missing > 0)
WHERE rank <= 3""")
def q_top_missing(spark, sf_dir):
    """The three columns with most missing cells."""
    p = P.missing_counts(lineitem_with_holes(spark, sf_dir))
    return P.top_missing(p).withColumn("rank", F.col("rank").cast("int"))


@register("completeness", sql="WITH " + profile_sql("lineitem", _holes_sql()) + f"""
SELECT {R('greatest(0.0, least(1.0, 1 - sum(missing) / (max(row_count) * count(*))))', 6)} AS completeness,
       round(100 * greatest(0.0, least(1.0, 1 - sum(missing) / (max(row_count) * count(*)))))::INTEGER AS completeness_pct
FROM prof""")
def q_completeness(spark, sf_dir):
    """Dataset completeness (lineitem with holes)."""
    c = P.completeness(P.missing_counts(lineitem_with_holes(spark, sf_dir)))
    return c.select(fround("completeness", 6).alias("completeness"), "completeness_pct")


@register("profile_documents", sql="WITH " + profile_sql("documents") + _ROUND_PROFILE_SQL)
def q_profile_documents(spark, sf_dir):
    """P1-P3, P5, P20 over whole texts (distinct and top value of full documents)."""
    return _round_profile(_profile(spark, sf_dir, "documents"))


@register("profile_embeddings", sql="WITH " + profile_sql("embeddings") + """
SELECT position, "column", logical_type, type_family, is_numeric, row_count, non_null, missing, "distinct", top_count
FROM prof""")
def q_profile_embeddings(spark, sf_dir):
    """P1, P2, P5 with an array column: arrays are grouped and counted whole (the
    reference rejected such tables).  The top value's text form is left out of the check
    because engines print floats inside arrays differently."""
    p = _profile(spark, sf_dir, "embeddings")
    return p.select("position", "column", "logical_type", "type_family", "is_numeric", "row_count", "non_null",
                    "missing", "distinct", "top_count")
