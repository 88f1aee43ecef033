"""Quality rules over the per-column profile.

All inputs are one row per column (from :mod:`lumen.operators.profile`), so the rules
are plain column expressions; a catalogue of many tables can be judged in one job by
unioning their profiles with a table key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.rows import with_row

# fixed values: name keywords
LEAKAGE_KEYWORDS = ("target", "label", "result", "outcome", "答案", "結果")
TARGET_KEYWORDS = ("target", "label", "price", "close", "sales", "revenue", "profit", "return",
                   "risk", "score", "amount", "value")
TARGET_EXCLUDED_NAMES = ("id", "index", "source_file", "source_row_number")

# fixed values: issue order and severity
ISSUE_ORDER = (
    (1, "info", "profile_sample"),
    (2, "warning", "missing_values"),
    (3, "warning", "duplicate_rows"),
    (4, "info", "constant_columns"),
    (5, "info", "high_cardinality"),
    (6, "warning", "outliers"),
    (7, "warning", "class_imbalance"),
    (8, "danger", "target_leakage"),
)


def _contains_any(c: Column, words) -> Column:
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else out | t
    return out


def column_flags(profile: DataFrame, outliers: DataFrame) -> DataFrame:
    """Per-column flags: constant (P7), high cardinality (P8), id-like (P9),
    class imbalance (P10), outliers (P11), leakage by name (P13), unique and top ratios."""
    name = F.lower(F.trim(F.col("column")))
    unique_ratio = F.col("distinct") / F.greatest(F.col("non_null"), F.lit(1))
    top_ratio = F.when(F.col("non_null") > 0, F.col("top_count") / F.col("non_null"))
    imb_cap = F.least(F.lit(20), F.greatest(F.lit(2), F.floor(F.col("row_count") / 2)))
    out = profile.select(
        "position", "column", "row_count", "non_null", "distinct",
        unique_ratio.alias("unique_ratio"), top_ratio.alias("top_ratio"),
        ((F.col("non_null") == 0) | (F.col("distinct") <= 1)).alias("is_constant"),
        ((F.col("non_null") > 0) & (unique_ratio >= 0.9) & (F.col("non_null") >= 10)).alias("is_high_cardinality"),
        ((F.col("non_null") > 0) & ((name == "id") | name.endswith("_id") | (unique_ratio >= 0.98))).alias("is_id_like"),
        ((F.col("non_null") > 0) & (F.col("distinct") <= imb_cap) & (F.col("distinct") >= 2)
         & (top_ratio >= 0.8)).alias("is_imbalanced"),
        _contains_any(name, LEAKAGE_KEYWORDS).alias("is_leakage"),
    )
    flagged = outliers.select("position", F.lit(True).alias("has_outliers"))
    return out.join(flagged, on="position", how="left").withColumn(
        "has_outliers", F.coalesce("has_outliers", F.lit(False)))


def quality_summary(flags: DataFrame, duplicates: DataFrame, profile: DataFrame,
                    profiled_sample: bool = False) -> DataFrame:
    """One row with counts, issue count and the 0-100 quality score."""
    def cnt(flag: str) -> Column:
        return F.count_if(F.col(flag)).cast("bigint")

    f = flags.agg(
        cnt("is_constant").alias("constant_columns"), cnt("is_high_cardinality").alias("high_cardinality_columns"),
        cnt("is_id_like").alias("id_like_columns"), cnt("has_outliers").alias("outlier_columns"),
        cnt("is_imbalanced").alias("imbalanced_columns"), cnt("is_leakage").alias("leakage_columns"),
    )
    p = profile.agg(F.max("row_count").cast("bigint").alias("row_count"),
                    F.count(F.lit(1)).cast("bigint").alias("column_count"),
                    F.sum("missing").cast("bigint").alias("missing_total"))
    s = _one_row_join([f, p, duplicates])
    issues = (F.col("constant_columns") + F.col("high_cardinality_columns") + F.col("outlier_columns")
              + F.col("imbalanced_columns") + F.col("leakage_columns")
              + F.when(F.col("duplicate_rows") > 0, 1).otherwise(0)
              + F.when(F.col("missing_total") > 0, 1).otherwise(0))
    cells = F.greatest(F.col("row_count") * F.col("column_count"), F.lit(1))
    rows = F.greatest(F.col("row_count"), F.lit(1))
    pen_missing = F.least(F.lit(35), F.bround(F.col("missing_total") / cells * 100, 0))
    pen_dup = F.least(F.lit(20), F.bround(F.col("duplicate_rows") / rows * 100, 0))
    pen_issues = F.least(F.lit(30), issues * 3)
    s = s.withColumn("issue_count", issues.cast("bigint"))
    s = s.withColumn("quality_score", F.greatest(F.lit(0), 100 - pen_missing - pen_dup - pen_issues).cast("int"))
    return s.withColumn("is_profiled_sample", F.lit(profiled_sample))


def _one_row_join(frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = with_row(out, f)
    return out


def quality_issues(summary: DataFrame) -> DataFrame:
    """Present issues, in fixed order, with severity and code."""
    present = {
        "profile_sample": F.col("is_profiled_sample"),
        "missing_values": F.col("missing_total") > 0,
        "duplicate_rows": F.col("duplicate_rows") > 0,
        "constant_columns": F.col("constant_columns") > 0,
        "high_cardinality": F.col("high_cardinality_columns") > 0,
        "outliers": F.col("outlier_columns") > 0,
        "class_imbalance": F.col("imbalanced_columns") > 0,
        "target_leakage": F.col("leakage_columns") > 0,
    }
    rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(sev).alias("severity"), F.lit(code).alias("code"),
                              present[code].alias("present")) for o, sev, code in ISSUE_ORDER])
    return summary.select(F.explode(rows).alias("i")).select("i.*").where("present").drop("present")


def recommend_targets(profile: DataFrame, top: int = 5) -> DataFrame:
    """Score candidate target columns; top ``top`` by score desc, name asc."""
    name = F.lower(F.trim(F.col("column")))
    numeric_like = F.col("is_numeric") | (F.col("logical_type") == "bool")
    many = F.col("distinct") > F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.col("non_null") * 0.3)))
    score = (F.when(numeric_like, 30 + F.when(many, 20).otherwise(0))
             .otherwise(8 + F.when((F.col("distinct") >= 2) & (F.col("distinct") <= 20), 15).otherwise(0))
             + F.when(_contains_any(name, TARGET_KEYWORDS) | (name == "y"), 30).otherwise(0))
    cands = profile.where(~name.isin(*TARGET_EXCLUDED_NAMES) & ~name.endswith("_id") & (F.col("non_null") > 0))
    w = Window.orderBy(F.desc("score"), "column")
    return cands.select("column", score.cast("int").alias("score")) \
        .withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= top)
