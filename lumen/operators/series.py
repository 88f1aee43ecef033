"""Time-series / price indicators.

A *series* is ``(keys..., date, price)`` with one row per key and date (F3 builds it by
averaging the price of rows sharing a date).  Indicators are window functions
partitioned by the series keys and ordered by date.  The raw input is touched once,
by the F3 aggregate (partial aggregation before the shuffle); every later step runs on
the per-date table, whose size is bounded by the calendar (days x keys), not by the
raw row count.  A series without keys is one window partition of at most one row per
day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions.casts import to_number, to_timestamp_any
from lumen.functions.ranks import beside, exact_quantiles
from lumen.functions.rows import with_row
from lumen.operators.scan import ema
from lumen.session import checkpoint_dir

# fixed values: column-name hints used to pick the date and price columns
DATE_NAME_HINTS = ("date", "datetime", "timestamp", "time", "day", "日期", "時間", "交易日")
PRICE_NAME_HINTS = ("close", "adj_close", "adjusted_close", "adjusted close", "price", "last",
                    "settle", "nav", "收盤", "價格", "股價", "淨值")
VOLUME_HINTS = ("volume", "成交量")

# trend label codes (F16), in rule order
TREND_OVERHEATED, TREND_OVERSOLD, TREND_BULLISH, TREND_BEARISH, TREND_SIDEWAYS = (
    "overheated", "oversold", "bullish", "bearish", "sideways")

INDICATOR_COLUMNS = ("ma_short", "ma_long", "return", "volatility", "rsi",
                     "macd", "macd_signal", "macd_histogram")


# ---------------------------------------------------------------------------- F3, F4
def build_series(df: DataFrame, date_col: str, price_col: str, keys: list[str] | None = None,
                 grain: str = "instant") -> DataFrame:
    """parse date and price, drop rows missing either, mean price per (keys, date).

    ``grain='instant'`` keeps the parsed instant; ``grain='day'`` cuts it to a calendar date.
    Output: keys..., date, price, n_obs (raw rows behind the mean).
    """
    keys = list(keys or [])
    date_expr = to_timestamp_any(df, date_col)
    if grain == "day":
        date_expr = F.to_date(date_expr)
    price_expr = to_number(df, price_col)
    return (
        df.select(*[F.col(f"`{k}`") for k in keys], date_expr.alias("date"), price_expr.alias("price"))
        .where(F.col("date").isNotNull() & F.col("price").isNotNull())
        .groupBy(*[F.col(f"`{k}`") for k in keys], "date")
        .agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("n_obs"))
    )


def duplicate_dates(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """raw rows that share a date with an earlier row, per key."""
    keys = list(keys or [])
    return series.groupBy(*keys).agg(
        F.sum(F.col("n_obs") - 1).cast("bigint").alias("duplicate_dates"),
        F.count(F.lit(1)).cast("bigint").alias("n_dates"),
        F.sum("n_obs").cast("bigint").alias("n_rows"),
    )


# ---------------------------------------------------------------------------- F5
def window_params(n: Column) -> dict[str, Column]:
    """adaptive window lengths from the number of dates n."""
    half, third = F.floor(n / 2), F.floor(n / 3)
    short = F.least(F.lit(5), F.greatest(F.lit(2), half))
    fast = F.least(F.lit(12), F.greatest(F.lit(3), third))
    return {
        "w_short": short,
        "w_long": F.least(F.lit(10), F.greatest(short + 1, n)),
        "w_rsi": F.least(F.lit(14), F.greatest(F.lit(5), half)),
        "w_fast": fast,
        "w_slow": F.least(F.lit(26), F.greatest(fast + 2, n)),
        "w_signal": F.least(F.lit(9), F.greatest(F.lit(3), third)),
    }


def _rolling(expr: Column, base: Window, width: int, how: str) -> Column:
    frame = base.rowsBetween(-(width - 1), Window.currentRow)
    agg = F.avg(expr) if how == "avg" else F.stddev_samp(expr)
    return F.when(F.count(expr).over(frame) >= 2, agg.over(frame))


# Rolling windows reach back 14 rows at most (and one more for a difference).
WINDOW_ROWS = 4096
WINDOW_HALO = 32
DAYS_A_BUCKET = 4096
MICROS_A_BUCKET = 3_600_000_000


def _numbered(series: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``idx`` (place in the series, from 0) and ``n`` (its length) without a window over a
    series: rows are numbered within stretches of time, whose sizes give the offsets."""
    if isinstance(series.schema["date"].dataType, T.DateType):
        stretch = F.floor(F.unix_date("date") / DAYS_A_BUCKET)
    else:
        stretch = F.floor(F.unix_micros(F.col("date").cast("timestamp")) / MICROS_A_BUCKET)
    named = [F.col(f"`{k}`") for k in keys]
    staged = series.withColumn("__stretch", stretch)
    sizes = staged.groupBy(*named, "__stretch").agg(F.count(F.lit(1)).alias("__size"))
    of_key = Window.partitionBy(*named)
    before = of_key.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*named, "__stretch", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"),
                           F.sum("__size").over(of_key).alias("n"))
    within = F.row_number().over(Window.partitionBy(*named, "__stretch").orderBy("date"))
    placed = staged.withColumn("__within", within).alias("s").join(
        offsets.alias("o"), [F.col(f"s.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in [*keys, "__stretch"]])
    return placed.select(*[F.col(f"s.`{c}`") for c in series.columns],
                         (F.col("__before") + F.col("__within") - 1).alias("idx"), F.col("n"))


def add_indicators(series: DataFrame, keys: list[str] | None = None, materialize: bool = True) -> DataFrame:
    """F5-F11 over a series ``(keys..., date, price)``.

    Adds idx (0-based position), ma_short, ma_long, return, volatility, rsi, macd,
    macd_signal, macd_histogram.  Window lengths depend on each series' length; the
    distinct length-parameter combinations (at most ~30, all series of 28+ dates share
    one) are read from a small aggregate, and each gets literal window frames.
    """
    out_keys = list(keys or [])
    keys = out_keys or ["__series"]
    if not out_keys:
        # one constant key: every later window, block aggregate and join clusters on a
        # superset of it, so the partitioning made here is reused instead of re-shuffled
        series = series.withColumn("__series", F.lit(0))
    base = _numbered(series.select(*[F.col(f"`{k}`") for k in keys], "date", "price"), keys)
    params = window_params(F.col("n"))
    base = base.select("*", *[c.alias(name) for name, c in params.items()])
    if materialize:
        # one row per (key, date): written once to the checkpoint folder, so the window,
        # block-table and join branches below all read it instead of re-running the scan
        checkpoint_dir(series.sparkSession)
        base = base.checkpoint(eager=True)

    combos = [r.asDict() for r in base.select(*params.keys()).distinct().collect()]  # <= ~30 rows

    def per_combo(build) -> Column:
        expr = None
        for p in combos:
            cond = None
            for name, val in p.items():
                term = F.col(name) == val
                cond = term if cond is None else cond & term
            v = build(p)
            expr = F.when(cond, v) if expr is None else expr.when(cond, v)
        return expr

    # windows see a block of the series and the last rows of the block before it
    own = F.floor(F.col("idx") / WINDOW_ROWS)
    last = F.col("idx") % WINDOW_ROWS >= WINDOW_ROWS - WINDOW_HALO
    blocked = base.withColumn("__window", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    ordered = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "__window").orderBy("idx")
    ret = F.try_divide(F.col("price"), F.lag("price").over(ordered)) - 1
    delta = F.col("price") - F.lag("price").over(ordered)
    out = blocked.withColumn("return", ret).withColumn("__delta", delta)
    out = out.withColumn("__gain", F.when(F.col("__delta").isNotNull(), F.greatest("__delta", F.lit(0.0))))
    out = out.withColumn("__loss", F.when(F.col("__delta").isNotNull(), -F.least("__delta", F.lit(0.0))))
    out = out.select(
        "*",
        per_combo(lambda p: _rolling(F.col("price"), ordered, p["w_short"], "avg")).alias("ma_short"),
        per_combo(lambda p: _rolling(F.col("price"), ordered, p["w_long"], "avg")).alias("ma_long"),
        per_combo(lambda p: _rolling(F.col("return"), ordered, p["w_short"], "std")
                  * F.sqrt(F.lit(float(p["w_short"])))).alias("volatility"),
        per_combo(lambda p: _rolling(F.col("__gain"), ordered, p["w_rsi"], "avg")).alias("__avg_gain"),
        per_combo(lambda p: _rolling(F.col("__loss"), ordered, p["w_rsi"], "avg")).alias("__avg_loss"),
    ).where(F.col("__window") == own).drop("__window")
    g, l_ = F.col("__avg_gain"), F.col("__avg_loss")
    out = out.withColumn(
        "rsi",
        F.when((l_ == 0) & (g > 0), F.lit(100.0))
        .when((l_ == 0) & (g == 0), F.lit(50.0))
        .otherwise(100 - 100 / (1 + F.try_divide(g, F.when(l_ != 0, l_)))),
    )
    fasts = sorted({p["w_fast"] for p in combos})
    slows = sorted({p["w_slow"] for p in combos})
    signals = sorted({p["w_signal"] for p in combos})
    out = ema(out, [("price", "__ema_fast", F.col("w_fast"), fasts),
                    ("price", "__ema_slow", F.col("w_slow"), slows)], keys)
    out = out.withColumn("macd", F.col("__ema_fast") - F.col("__ema_slow"))
    out = ema(out, [("macd", "macd_signal", F.col("w_signal"), signals)], keys)
    out = out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return out.select(*out_keys, "date", "idx", "price", *INDICATOR_COLUMNS)


# ---------------------------------------------------------------------------- F12, F13, F16
def latest_metrics(indicators: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F12 + F13: last valid value of each indicator, historical VaR 95/99, per key.

    The columns it needs are written once; the quantiles of the returns come from bins of
    all series together, so no series is held by a task.
    """
    checkpoint_dir(indicators.sparkSession)
    keyed, keys, out_keys = _with_key(indicators, keys)
    indicators = keyed.select(*[F.col(f"`{k}`") for k in keys], "idx", "price", "return", "volatility", "rsi", "macd",
                              "macd_signal").checkpoint()

    def last_valid(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("idx")))

    var = exact_quantiles(indicators.withColumn("__one", F.lit(1)), keys, "return", "__one", [0.05, 0.01])
    var = var.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[
        F.max(F.when(F.col("prob") == p, F.greatest(F.lit(0.0), -F.col("value")))).alias(name)
        for p, name in ((0.05, "var_95"), (0.01, "var_99"))])
    out = indicators.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count(F.lit(1)).cast("bigint").alias("row_count_used"),
        F.max_by("price", "idx").alias("latest_price"),
        last_valid("return").alias("latest_return"),
        last_valid("volatility").alias("latest_volatility"),
        last_valid("rsi").alias("latest_rsi"),
        last_valid("macd").alias("latest_macd"),
        last_valid("macd_signal").alias("latest_macd_signal"),
    )
    out = beside(out, var, keys, "left").withColumn("trend_label", trend_label())
    return out if out_keys else out.drop(*keys)


def _with_key(indicators: DataFrame, keys: list[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    """A series without keys gets a constant one: (rows, keys to group by, keys to return)."""
    out_keys = list(keys or [])
    return (indicators, out_keys, out_keys) if out_keys else (indicators.withColumn("__series", F.lit(0)), ["__series"], [])


def trend_label() -> Column:
    """F16: first matching rule wins."""
    rsi, ret = F.col("latest_rsi"), F.col("latest_return")
    macd, sig = F.col("latest_macd"), F.col("latest_macd_signal")
    return (
        F.when(rsi.isNotNull() & (rsi >= 70), F.lit(TREND_OVERHEATED))
        .when(rsi.isNotNull() & (rsi <= 30), F.lit(TREND_OVERSOLD))
        .when(ret.isNotNull() & (ret > 0) & macd.isNotNull() & sig.isNotNull() & (macd >= sig),
              F.lit(TREND_BULLISH))
        .when(ret.isNotNull() & (ret < 0) & macd.isNotNull() & sig.isNotNull() & (macd < sig),
              F.lit(TREND_BEARISH))
        .otherwise(F.lit(TREND_SIDEWAYS))
    )


# ---------------------------------------------------------------------------- F14, F15
def forecast(indicators: DataFrame, keys: list[str] | None = None, horizon: int = 5,
             digits: int | None = 6) -> DataFrame:
    """OLS of price on position, ``horizon`` steps ahead; step = median date gap.

    Series with fewer than 6 points get no forecast rows.  Gaps are taken within blocks of
    the series that begin with the last row of the block before.
    """
    checkpoint_dir(indicators.sparkSession)
    keyed, keys, out_keys = _with_key(indicators, keys)
    of_keys = [F.col(f"`{k}`") for k in keys]
    own = F.floor(F.col("idx") / WINDOW_ROWS)
    last = F.col("idx") % WINDOW_ROWS == WINDOW_ROWS - 1
    blocked = keyed.select(*of_keys, "idx", "date", "price").withColumn(
        "__window", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    ordered = Window.partitionBy(*of_keys, "__window").orderBy("idx")
    at = F.unix_micros(F.col("date").cast("timestamp"))
    gaps = blocked.withColumn("gap_us", (at - F.lag(at).over(ordered)).cast("double")).where(
        F.col("__window") == own).drop("__window").checkpoint()
    median = exact_quantiles(gaps.withColumn("__one", F.lit(1)), keys, "gap_us", "__one", [0.5])
    fit = gaps.groupBy(*of_keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("price", "idx").alias("slope"),
        F.regr_intercept("price", "idx").alias("intercept"),
        F.max("date").alias("last_date"),
    ).where(F.col("n") >= 6)
    fit = beside(fit, median.select(*of_keys, F.col("value").alias("step_us")), keys, "left")
    step = F.when(F.col("step_us").isNull() | (F.col("step_us") <= 0), F.lit(86400.0 * 1e6)) \
        .otherwise(F.col("step_us"))
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    future_us = F.unix_micros(F.col("last_date").cast("timestamp")) + F.floor(step * F.col("step")).cast("bigint")
    return out.select(
        *out_keys,
        F.col("step").cast("int").alias("step"),
        F.timestamp_micros(future_us).cast(indicators.schema["date"].dataType).alias("date"),
        _maybe_round(F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1), digits)
        .alias("predicted_price"),
    )


def _maybe_round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.bround(c, digits)


def forecast_reliability(metrics: DataFrame, forecasts: DataFrame, keys: list[str] | None = None,
                         digits: int | None = 6) -> DataFrame:
    """level from the largest relative gap between forecast and latest price.

    Both inputs hold one row (metrics) or ``horizon`` rows (forecasts) per key.
    """
    keys = list(keys or [])
    latest = metrics.select(*keys, _maybe_round(F.col("latest_price"), digits).alias("latest"), "row_count_used")
    last = latest.select(*keys, "latest")
    beside = forecasts.join(last, on=keys) if keys else with_row(forecasts, last)
    dev = beside.groupBy(*keys).agg(
        F.max(F.abs(F.col("predicted_price") - F.col("latest")) / F.abs(F.col("latest"))).alias("max_dev"))
    full = latest.join(dev, on=keys, how="left") if keys else with_row(latest, dev)
    bad = F.col("latest").isNull() | (F.col("latest") == 0) | F.col("max_dev").isNull()
    level = (F.when(bad, F.lit("low"))
             .when(F.col("max_dev") > 0.2, F.lit("low"))
             .otherwise(F.lit("medium")))
    reason = (F.when(bad, F.lit("no_comparable_points"))
              .when(F.col("max_dev") > 0.2, F.lit("deviation_over_20pct"))
              .when((F.col("max_dev") > 0.08) | (F.col("row_count_used") < 30), F.lit("deviation_or_short_history"))
              .otherwise(F.lit("linear_baseline_only")))
    return full.select(
        *keys, "row_count_used",
        level.alias("level"), reason.alias("reason"),
        F.when(~bad, _maybe_round(F.col("max_dev"), digits)).alias("max_deviation_ratio"),
        ((F.col("row_count_used") > 3650) & (level != "low")).alias("long_history_note"),
    )


# ---------------------------------------------------------------------------- F19
def chart_series(indicators: DataFrame, forecasts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """long table (keys..., chart, date, series, value) behind the four charts."""
    keys = list(keys or [])
    spec = [
        ("price_moving_average", "price", F.col("price")),
        ("price_moving_average", "ma_short", F.col("ma_short")),
        ("price_moving_average", "ma_long", F.col("ma_long")),
        ("return_volatility", "return_pct", F.col("return") * 100),
        ("return_volatility", "volatility_pct", F.col("volatility") * 100),
        ("rsi_macd", "rsi", F.col("rsi")),
        ("rsi_macd", "macd", F.col("macd")),
        ("rsi_macd", "macd_signal", F.col("macd_signal")),
        ("rsi_macd", "macd_histogram", F.col("macd_histogram")),
        ("time_series_forecast", "history", F.col("price")),
    ]
    long = indicators.select(
        *keys, "date",
        F.explode(F.array(*[F.struct(F.lit(c).alias("chart"), F.lit(n).alias("series"),
                                     v.cast("double").alias("value")) for c, n, v in spec])).alias("p"),
    ).select(*keys, "p.chart", "date", "p.series", "p.value").where(F.col("value").isNotNull())
    fc = forecasts.select(*keys, F.lit("time_series_forecast").alias("chart"), "date",
                          F.lit("forecast").alias("series"), F.col("predicted_price").alias("value"))
    return long.unionByName(fc)


# ---------------------------------------------------------------------------- F1, F2, F20
def _has_any(name: str, hints) -> bool:
    low = name.lower()
    return any(h in low for h in hints)


def detect_date_columns(df: DataFrame) -> DataFrame:
    """F1 (+F20 name/type score): one aggregate over all candidate columns.

    Output per candidate: column, position, valid_ratio, has_hint, is_datetime, score,
    ui_score (F20), rank (1 = chosen; ties → first column).
    """
    cands = []
    for pos, f in enumerate(df.schema.fields):
        hint = _has_any(f.name, DATE_NAME_HINTS)
        is_dt = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if isinstance(f.dataType, T.NumericType) and not hint and not is_dt:
            continue
        cands.append((pos, f.name, hint, is_dt))
    if not cands:
        raise ValueError("no date column candidate")
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count(to_timestamp_any(df, name)).alias(f"__v{pos}") for pos, name, _, _ in cands]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(name).alias("column"), F.lit(pos).alias("position"),
                        F.try_divide(F.col(f"__v{pos}"), F.col("__n")).alias("valid_ratio"),
                        F.lit(hint).alias("has_hint"), F.lit(is_dt).alias("is_datetime"),
                        F.lit((5 if hint else 0) + (4 if is_dt else 0)
                              + (1 if ("created" in name.lower() or "updated" in name.lower()) else 0))
                        .alias("ui_score"))
               for pos, name, hint, is_dt in cands]
    out = row.select(F.explode(F.array(*structs)).alias("c")).select("c.*")
    out = out.where((F.col("valid_ratio") >= 0.5) | F.col("has_hint"))
    out = out.withColumn("score", F.col("valid_ratio") * 4 + F.when(F.col("has_hint"), 3).otherwise(0)
                         + F.when(F.col("is_datetime"), 2).otherwise(0))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "position")))


def detect_price_columns(df: DataFrame, date_col: str) -> DataFrame:
    """F2 (+F20): candidates with >= 6 numeric values; score, ui_score and rank."""
    cands = [(pos, f.name) for pos, f in enumerate(df.schema.fields) if f.name != date_col]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for pos, name in cands:
        v = to_number(df, name)
        aggs += [F.count(v).alias(f"__c{pos}"), F.stddev_samp(v).alias(f"__s{pos}")]
    row = df.agg(*aggs)
    structs = []
    for pos, name in cands:
        hint = _has_any(name, PRICE_NAME_HINTS)
        vol = _has_any(name, VOLUME_HINTS)
        numeric = isinstance(df.schema[name].dataType, T.NumericType)
        ui = max((1 + (5 if hint else 0) - (3 if vol else 0)) if numeric else 0, 0)
        structs.append(F.struct(
            F.lit(name).alias("column"), F.lit(pos).alias("position"),
            F.col(f"__c{pos}").cast("bigint").alias("valid_count"),
            F.try_divide(F.col(f"__c{pos}"), F.col("__n")).alias("valid_ratio"),
            F.coalesce(F.col(f"__s{pos}"), F.lit(0.0)).alias("std"),
            F.lit(hint).alias("has_hint"), F.lit(vol).alias("has_volume"), F.lit(ui).alias("ui_score")))
    out = row.select(F.explode(F.array(*structs)).alias("c")).select("c.*").where(F.col("valid_count") >= 6)
    out = out.withColumn(
        "score", F.col("valid_ratio") * 3 + F.least(F.col("std"), F.lit(1000.0)) / 1000
        + F.when(F.col("has_hint"), 5).otherwise(0) - F.when(F.col("has_volume"), 3).otherwise(0))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "position")))
