"""Finance plan (the reference's finance run): detect date and price columns, build the
per-date series, indicators, forecast, latest metrics, trend label, reliability and
chart data.  The raw table is read by two aggregates (column detection, series build);
everything after works on the per-date series, written once to the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.operators import series as S
from lumen.session import checkpoint_dir

MIN_POINTS = 6


@dataclass
class FinanceRun:
    date_column: str
    price_column: str
    series: DataFrame
    indicators: DataFrame
    metrics: DataFrame
    forecast: DataFrame
    reliability: DataFrame
    charts: DataFrame
    notes: list[str]


def resolve_date_column(df: DataFrame, requested: str | None = None) -> str:
    """F1: requested column must exist and parse for >= 50 % of rows; else best score."""
    if requested:
        if requested not in df.columns:
            raise ValueError(f"date column {requested!r} does not exist")
        from lumen.functions.casts import to_timestamp_any
        ratio = df.agg(F.try_divide(F.count(to_timestamp_any(df, requested)), F.count(F.lit(1)))).collect()[0][0]
        if ratio is None or ratio < 0.5:
            raise ValueError(f"date column {requested!r} does not parse as dates")
        return requested
    best = S.detect_date_columns(df).where(F.col("rank") == 1).collect()
    if not best:
        raise ValueError("no date column detected; name one explicitly")
    return best[0]["column"]


def resolve_price_column(df: DataFrame, date_col: str, requested: str | None = None) -> str:
    """F2: requested column needs >= 6 numeric values and >= 50 %; else best score."""
    if requested:
        if requested not in df.columns:
            raise ValueError(f"price column {requested!r} does not exist")
        from lumen.functions.casts import to_number
        r = df.agg(F.count(to_number(df, requested)).alias("c"), F.count(F.lit(1)).alias("n")).collect()[0]
        if r["c"] < MIN_POINTS or r["c"] / max(r["n"], 1) < 0.5:
            raise ValueError(f"price column {requested!r} is not numeric enough")
        return requested
    best = S.detect_price_columns(df, date_col).where(F.col("rank") == 1).collect()
    if not best:
        raise ValueError("no price column detected; name one explicitly")
    return best[0]["column"]


def run_financial_analysis(df: DataFrame, date_column: str | None = None, price_column: str | None = None,
                           keys: list[str] | None = None, grain: str = "instant", horizon: int = 5) -> FinanceRun:
    keys = list(keys or [])
    notes: list[str] = []
    date_col = resolve_date_column(df, date_column)
    price_col = resolve_price_column(df, date_col, price_column)
    series = S.build_series(df, date_col, price_col, keys=keys, grain=grain)
    checkpoint_dir(df.sparkSession)
    series = series.checkpoint(eager=True)
    dup = S.duplicate_dates(series, keys).agg(F.min("n_rows").alias("rows"), F.min("n_dates").alias("dates"),
                                             F.sum("duplicate_dates").alias("dups")).collect()[0]
    if (dup["rows"] or 0) < MIN_POINTS:
        raise ValueError("at least 6 rows with a valid date and price are needed")
    if (dup["dates"] or 0) < MIN_POINTS:
        raise ValueError("at least 6 distinct dates are needed after averaging per date")
    if dup["dups"]:
        notes.append("several prices on one date were averaged")
    ind = S.add_indicators(series.drop("n_obs"), keys)
    fc = S.forecast(ind, keys, horizon)
    metrics = S.latest_metrics(ind, keys)
    rel = S.forecast_reliability(metrics, fc, keys)
    charts = S.chart_series(ind, fc, keys)
    return FinanceRun(date_col, price_col, series, ind, metrics, fc, rel, charts, notes)
