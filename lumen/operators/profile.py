"""Dataset profile.

Missing counts need one plain aggregate (:func:`missing_counts`).  The full profile reads
the raw table for

* the value histogram — the table unpivoted to ``(position, value)`` and grouped to
  ``(position, value, cnt)``: one shuffle, map-side combined, so a value holding a third
  of all rows becomes one row per map task; long texts travel as digests.  Non-null and
  distinct counts, top values, mean / std (two passes over the histogram), min / max,
  exact quantiles and IQR outlier counts are all read off this histogram, which is
  written once to the checkpoint folder;
* the duplicate-row count (a group-by over whole rows).

Results are one row per column (or per column and statistic).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.casts import is_numeric_type, logical_type, type_family  # noqa: F401
from lumen.functions.quantiles import sorted_gaps_from_hist
from lumen.functions.ranks import exact_quantiles
from lumen.functions.rows import with_row
from lumen.session import checkpoint_dir

_FLOAT_TYPES = (T.FloatType, T.DoubleType)


def _is_float(dt: T.DataType) -> bool:
    return isinstance(dt, _FLOAT_TYPES)


def _clean(df: DataFrame, name: str) -> Column:
    """Column with NaN mapped to null (pandas treats NaN as missing)."""
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType
    if _is_float(dt):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return c


def _as_text(df: DataFrame, name: str) -> Column:
    """Value as text for distinct / frequency counts (arrays and structs as JSON)."""
    dt = df.schema[name].dataType
    c = _clean(df, name)
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def schema_rows(df: DataFrame) -> list[tuple[int, str, T.DataType]]:
    return [(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]


DIGEST_MARK = "\u0000sha256:"


def text_key(t: Column, digest_over: int | None) -> Column:
    """Grouping key of a text value: the text itself, or — for texts longer than
    ``digest_over`` characters — a NUL-prefixed SHA-256 digest of the whole text, so that
    long documents are counted exactly without moving them through the shuffle."""
    if digest_over is None:
        return t
    return F.when(F.length(t) > digest_over, F.concat(F.lit(DIGEST_MARK), F.sha2(t, 256))).otherwise(t)


def value_histogram(df: DataFrame, materialize: bool = False, digest_over: int | None = 256) -> DataFrame:
    """``(position, value_i, value_d, value_t, cnt, value, num)`` over all columns, nulls dropped.

    Values keep their type through the shuffle (integers as bigint, floats as double with
    NaN → null, everything else as text — texts longer than ``digest_over`` as their
    digest, see :func:`text_key`); the text form ``value`` and the numeric form ``num``
    are derived after aggregation, on distinct values only.  With ``materialize`` the
    histogram is written once to the checkpoint folder.
    """
    cols = schema_rows(df)
    groups: dict[str, list[tuple[int, Column]]] = {"value_i": [], "value_d": [], "value_t": []}
    for pos, name, dt in cols:
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            groups["value_i"].append((pos, F.col(f"`{name}`").cast("bigint")))
        elif _is_float(dt):
            groups["value_d"].append((pos, _clean(df, name).cast("double")))
        else:
            # decimals too: as text no digit is lost, and one column's share a scale
            groups["value_t"].append((pos, text_key(_as_text(df, name), digest_over)))
    types = {"value_i": "bigint", "value_d": "double", "value_t": "string"}
    hist = None
    # one branch per value type: simpler grouping keys, and each scan reads only its columns
    for out_col, members in groups.items():
        if not members:
            continue
        long = df.select(F.explode(F.array(*[F.struct(F.lit(pos).alias("position"), v.alias("v"))
                                              for pos, v in members])).alias("kv")).select("kv.*")
        part = long.where(F.col("v").isNotNull()).groupBy("position", "v").agg(F.count(F.lit(1)).alias("cnt"))
        part = part.select("position", *[(F.col("v") if c == out_col else F.lit(None).cast(t)).alias(c)
                                          for c, t in types.items()], "cnt")
        hist = part if hist is None else hist.unionByName(part)
    if hist is None:
        hist = df.sparkSession.createDataFrame(
            [], "position int, value_i bigint, value_d double, value_t string, cnt bigint")
    decimals = [pos for pos, _, dt in cols if isinstance(dt, T.DecimalType)]
    decimal = F.when(F.col("position").isin(decimals), F.col("value_t").try_cast("double"))
    hist = hist.select("*", F.coalesce(F.col("value_i").cast("string"), F.col("value_d").cast("string"),
                                       F.col("value_t")).alias("value"),
                       F.coalesce(F.col("value_d"), F.col("value_i").cast("double"), decimal).alias("num"))
    if materialize:
        from lumen.session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        hist = hist.checkpoint(eager=True)
    return hist


def missing_counts(df: DataFrame) -> DataFrame:
    """Position, column, type family, row, non-null and missing count per column, from
    one aggregate without a shuffle of values."""
    cols = schema_rows(df)
    meta = df.sparkSession.createDataFrame(
        [(pos, name, logical_type(dt), type_family(dt), is_numeric_type(dt)) for pos, name, dt in cols],
        "position int, column string, logical_type string, type_family string, is_numeric boolean")
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(_clean(df, name)).alias(f"c{pos}") for pos, name, _ in cols])
    counts = with_row(meta, one.select("rows", F.array(*[F.col(f"c{pos}") for pos, _, _ in cols]).alias("counts")))
    non_null = F.element_at("counts", F.col("position") + 1).cast("bigint")
    return counts.select("position", "column", "logical_type", "type_family", "is_numeric", F.col("rows").cast("bigint").alias("row_count"),
                         non_null.alias("non_null"), (F.col("rows") - non_null).alias("missing"))


def type_families(df: DataFrame) -> DataFrame:
    """P18's input: a row per column, from the schema alone."""
    return df.sparkSession.createDataFrame([(type_family(dt),) for _, _, dt in schema_rows(df)], "type_family string")


def _numeric_positions(df: DataFrame) -> list[int]:
    return [pos for pos, _, dt in schema_rows(df) if is_numeric_type(dt)]


def column_profile(df: DataFrame, hist: DataFrame | None = None, quantiles: bool = True) -> DataFrame:
    """P1-P3, P5, P20 per column.

    Everything per column is read off the value histogram (non-null count, distinct
    count, top value, mean, sample std with a second centered pass, min, max, exact
    quantiles); the raw table is touched only for its row count, which reads no column.

    Columns: position, column, logical_type, type_family, is_numeric, row_count,
    non_null, missing, distinct, top_count, top_value, mean, std, min, max, p25, p50, p75.
    """
    spark = df.sparkSession
    cols = schema_rows(df)
    numeric = sorted(_numeric_positions(df))
    hist = hist if hist is not None else value_histogram(df, materialize=True)
    row_count = df.count()
    # one row per column each: small results, put together here
    weight = F.col("num") * F.col("cnt")
    stats = {r["position"]: r for r in hist.groupBy("position").agg(
        F.sum("cnt").alias("non_null"), F.count(F.lit(1)).alias("distinct"), F.max("cnt").alias("top_count"),
        # most frequent value; ties go to the smallest text (of long texts: the smallest digest)
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top_value"),
        (F.sum(weight) / F.sum(F.when(F.col("num").isNotNull(), F.col("cnt")))).alias("mean"),
        F.min("num").alias("min"), F.max("num").alias("max")).collect()}
    top = _texts_of_digests(df, {p: r["top_value"] for p, r in stats.items()})
    means = [(p, stats[p]["mean"]) for p in numeric if p in stats]
    std, quartiles = {}, {}
    if means:
        mean = F.create_map(*[F.lit(x) for pair in means for x in pair])[F.col("position")]
        away = F.col("num") - mean
        squares = hist.where(F.col("position").isin([p for p, _ in means])).groupBy("position").agg(
            F.sum(F.col("cnt") * away * away).alias("ss")).collect()
        std = {r["position"]: math.sqrt(r["ss"] / (stats[r["position"]]["non_null"] - 1)) for r in squares
               if stats[r["position"]]["non_null"] > 1}
    if means and quantiles:
        found = numeric_quantiles(hist, [p for p, _ in means], [0.25, 0.5, 0.75]).collect()
        quartiles = {(r["position"], r["prob"]): r["value"] for r in found}
    rows = []
    for pos, name, dt in cols:
        r = stats.get(pos)
        is_num = r is not None and pos in numeric
        rows.append((pos, name, logical_type(dt), type_family(dt), pos in numeric, row_count, r["non_null"] if r else 0,
                     row_count - (r["non_null"] if r else 0), r["distinct"] if r else 0, r["top_count"] if r else 0, top.get(pos),
                     r["mean"] if is_num else None, std.get(pos) if is_num else None, r["min"] if is_num else None,
                     r["max"] if is_num else None, *[quartiles.get((pos, q)) for q in (0.25, 0.5, 0.75)]))
    return spark.createDataFrame(
        rows, "position int, column string, logical_type string, type_family string, is_numeric boolean, row_count bigint, "
              "non_null bigint, missing bigint, distinct bigint, top_count bigint, top_value string, mean double, std double, "
              "min double, max double, p25 double, p50 double, p75 double")


def _texts_of_digests(df: DataFrame, top: dict[int, str | None]) -> dict[int, str | None]:
    """Top values with digests turned back into their texts, by one filtered scan of the
    columns that have any."""
    marked = {p: v for p, v in top.items() if v is not None and v.startswith(DIGEST_MARK)}
    if not marked:
        return top
    names = {pos: name for pos, name, _ in schema_rows(df)}
    texts = [F.max(F.when(F.sha2(_as_text(df, names[p]), 256) == v[len(DIGEST_MARK):], _as_text(df, names[p]))).alias(f"t{p}")
             for p, v in marked.items()]
    row = df.agg(*texts).first()
    return top | {p: row[f"t{p}"] for p in marked}


def numeric_quantiles(hist: DataFrame, positions: list[int], probs: list[float]) -> DataFrame:
    """Exact quantiles of numeric columns from the value histogram: (position, prob, value)."""
    h = hist.where(F.col("position").isin(positions)).select("position", F.col("num").alias("v"), "cnt")
    return exact_quantiles(h, ["position"], "v", "cnt", probs)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (null equals null; NaN equals NaN).

    Rows are grouped by their columns, with texts longer than 256 characters (and nested
    values, as JSON) replaced by their SHA-256 digest: the count stays exact while whole
    documents do not cross the shuffle.
    """
    keys = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            keys.append(text_key(c, 256).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            keys.append(text_key(F.to_json(c), 256).alias(f.name))
        else:
            keys.append(c)
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    return grouped.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def iqr_outliers(df: DataFrame, hist: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """Per numeric column with >= 4 values and IQR > 0, values strictly outside
    [q1 - 1.5 iqr, q3 + 1.5 iqr]; only columns with at least one outlier are returned.
    Output: position, column, count, ratio, lower_bound, upper_bound.
    """
    numeric = _numeric_positions(df)
    names = {pos: name for pos, name, _ in schema_rows(df)}
    hist = hist if hist is not None else value_histogram(df, materialize=True)
    if profile is not None:
        bounds = profile.where(F.col("is_numeric")).select("position", F.col("p25").alias("q1"), F.col("p75").alias("q3"))
    else:
        q = numeric_quantiles(hist, numeric, [0.25, 0.75])
        bounds = q.groupBy("position").agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    bounds = bounds.withColumn("iqr", F.col("q3") - F.col("q1")).select(
        "position", "iqr", (F.col("q1") - 1.5 * F.col("iqr")).alias("lower_bound"),
        (F.col("q3") + 1.5 * F.col("iqr")).alias("upper_bound"))
    h = hist.where(F.col("position").isin(numeric)).select("position", F.col("num").alias("v"), "cnt")
    counted = h.join(bounds, on="position").groupBy("position", "iqr", "lower_bound", "upper_bound").agg(
        F.sum("cnt").alias("n"),
        F.sum(F.when((F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound")), F.col("cnt"))
              .otherwise(0)).cast("bigint").alias("count"))
    name_map = F.create_map(*[x for pos in numeric for x in (F.lit(pos), F.lit(names[pos]))])
    return counted.where((F.col("n") >= 4) & (F.col("iqr") != 0) & (F.col("count") > 0)).select(
        "position", name_map[F.col("position")].alias("column"), "count",
        (F.col("count") / F.col("n")).alias("ratio"), "lower_bound", "upper_bound")


def date_frequency(df: DataFrame) -> DataFrame:
    """For columns named like date/time or of datetime type with >= 3 valid values:
    valid ratio (over non-null), median gap between sorted values in seconds, start, end.
    """
    from lumen.functions.casts import to_timestamp_any

    cands = [(pos, name) for pos, name, dt in schema_rows(df)
             if "date" in name.lower() or "time" in name.lower()
             or isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if not cands:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, valid_ratio double, median_interval_seconds double, "
                "start timestamp, `end` timestamp")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(pos).alias("position"), F.col(f"`{name}`").isNotNull().alias("nn"),
                 F.unix_micros(to_timestamp_any(df, name)).alias("us"))
        for pos, name in cands])).alias("kv")).select("kv.*")
    # one histogram of parsed instants (unparseable values land in the null instant), read
    # once from the table and written to the checkpoint folder; stats and gaps come from it
    hist = long.groupBy("position", "us").agg(F.count(F.lit(1)).alias("cnt"), F.count_if("nn").alias("nn_cnt"))
    checkpoint_dir(df.sparkSession)
    hist = hist.checkpoint(eager=True)
    valid = F.col("us").isNotNull()
    stats = hist.groupBy("position").agg(
        F.sum("nn_cnt").alias("non_null"), F.sum(F.when(valid, F.col("cnt")).otherwise(0)).alias("valid"),
        F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    gaps = sorted_gaps_from_hist(hist.where(valid).select("position", "us", "cnt"), ["position"], "us", "cnt")
    med = exact_quantiles(gaps, ["position"], "gap", "cnt", [0.5]).select(
        "position", (F.col("value") / 1e6).alias("median_interval_seconds"))
    names = F.create_map(*[x for pos, name in cands for x in (F.lit(pos), F.lit(name))])
    return stats.where(F.col("valid") >= 3).join(med, on="position", how="left").select(
        "position", names[F.col("position")].alias("column"),
        (F.col("valid") / F.greatest(F.col("non_null"), F.lit(1))).alias("valid_ratio"),
        "median_interval_seconds",
        F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"))


def type_distribution(profile: DataFrame) -> DataFrame:
    """Columns per type family, most common first."""
    return profile.groupBy("type_family").agg(F.count(F.lit(1)).cast("bigint").alias("columns")) \
        .orderBy(F.desc("columns"), "type_family")


def top_missing(profile: DataFrame, k: int = 3) -> DataFrame:
    """Columns with most missing cells (ties by position), top k."""
    w = Window.orderBy(F.desc("missing"), "position")
    return profile.where(F.col("missing") > 0).withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= k).select("rank", "column", "missing")


def completeness(profile: DataFrame) -> DataFrame:
    """1 - missing / cells, clamped to [0, 1]; UI percent rounds half up."""
    agg = profile.agg(F.sum("missing").alias("m"), F.max("row_count").alias("r"), F.count(F.lit(1)).alias("c"))
    cells = F.col("r") * F.col("c")
    ratio = F.when(cells > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("m") / cells))).otherwise(F.lit(1.0))
    return agg.select(ratio.alias("completeness"), F.round(ratio * 100).cast("int").alias("completeness_pct"))
