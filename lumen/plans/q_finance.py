"""Registered finance queries (F1-F20) over ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.operators import series as S
from lumen.plans.registry import register
from lumen.sources.tables import table


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", grain="day")


def orders_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.add_indicators(orders_series(spark, sf_dir))


def _round_indicators(df: DataFrame, keys=()) -> DataFrame:
    return df.select(
        *keys, "date", F.col("idx").cast("bigint").alias("idx"),
        fround("price", 2).alias("price"), fround("ma_short", 2).alias("ma_short"),
        fround("ma_long", 2).alias("ma_long"), fround("return", 6).alias("return"),
        fround("volatility", 6).alias("volatility"), fround("rsi", 6).alias("rsi"),
        fround("macd", 2).alias("macd"), fround("macd_signal", 2).alias("macd_signal"),
        fround("macd_histogram", 2).alias("macd_histogram"),
    )


# The SQL twins hard-code the saturated window lengths (5, 10, 14, 12, 26, 9): every
# series in the given tables has 28+ dates, where F5's adaptive rule reaches its caps.
_DAILY_ORDERS = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS price
  FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1
)"""

_IND_SQL = """
s AS (
  SELECT {k}date, price, row_number() OVER (PARTITION BY {pk} ORDER BY date) - 1 AS idx,
         lag(price) OVER (PARTITION BY {pk} ORDER BY date) AS prev
  FROM daily
),
r AS (
  SELECT *, price / prev - 1 AS ret,
         CASE WHEN prev IS NOT NULL THEN greatest(price - prev, 0) END AS gain,
         CASE WHEN prev IS NOT NULL THEN -least(price - prev, 0) END AS loss
  FROM s
),
w AS (
  SELECT *,
    CASE WHEN count(price) OVER w5 >= 2 THEN avg(price) OVER w5 END AS ma_short,
    CASE WHEN count(price) OVER w10 >= 2 THEN avg(price) OVER w10 END AS ma_long,
    CASE WHEN count(ret) OVER w5 >= 2 THEN stddev_samp(ret) OVER w5 * sqrt(5) END AS volatility,
    CASE WHEN count(gain) OVER w14 >= 2 THEN avg(gain) OVER w14 END AS ag,
    CASE WHEN count(loss) OVER w14 >= 2 THEN avg(loss) OVER w14 END AS al
  FROM r
  WINDOW w5 AS (PARTITION BY {pk} ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w10 AS (PARTITION BY {pk} ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
         w14 AS (PARTITION BY {pk} ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
),
rec AS (
  SELECT {k}idx, price AS ef, price AS es, 0.0::DOUBLE AS sg FROM s WHERE idx = 0
  UNION ALL
  SELECT {sk}s.idx,
         rec.ef * (1 - {af}) + {af} * s.price,
         rec.es * (25.0 / 27.0) + (2.0 / 27.0) * s.price,
         rec.sg * 0.8 + 0.2 * ((rec.ef * (1 - {af}) + {af} * s.price)
                               - (rec.es * (25.0 / 27.0) + (2.0 / 27.0) * s.price))
  FROM rec JOIN s ON s.idx = rec.idx + 1 {join_k}
),
ind AS (
  SELECT {wk}w.date, w.idx, w.price, w.ma_short, w.ma_long, w.ret, w.volatility,
    CASE WHEN w.al = 0 AND w.ag > 0 THEN 100.0
         WHEN w.al = 0 AND w.ag = 0 THEN 50.0
         ELSE 100 - 100 / (1 + w.ag / nullif(w.al, 0)) END AS rsi,
    rec.ef - rec.es AS macd, rec.sg AS macd_signal
  FROM w JOIN rec ON rec.idx = w.idx {join_rec}
)"""


def _ind_sql(keys: tuple[str, ...] = (), fast: int = 12) -> str:
    k = "".join(f"{c}, " for c in keys)
    return _IND_SQL.format(
        af=f"(2.0 / {fast + 1}.0)",
        k=k, pk=", ".join(keys) if keys else "NULL",
        sk="".join(f"s.{c}, " for c in keys), wk="".join(f"w.{c}, " for c in keys),
        join_k="".join(f"AND s.{c} = rec.{c} " for c in keys),
        join_rec="".join(f"AND rec.{c} = w.{c} " for c in keys),
    )


_ROUND_SQL = f"""
SELECT {{k}}date, idx::BIGINT AS idx, {R('price', 2)} AS price, {R('ma_short', 2)} AS ma_short,
       {R('ma_long', 2)} AS ma_long, {R('ret', 6)} AS "return", {R('volatility', 6)} AS volatility,
       {R('rsi', 6)} AS rsi, {R('macd', 2)} AS macd, {R('macd_signal', 2)} AS macd_signal,
       {R('macd - macd_signal', 2)} AS macd_histogram
FROM ind"""


@register("finance_indicators", sql="WITH RECURSIVE " + _DAILY_ORDERS + "," + _ind_sql() + _ROUND_SQL.format(k=""))
def q_finance_indicators(spark, sf_dir):
    """Daily mean order price and its indicators."""
    return _round_indicators(orders_indicators(spark, sf_dir))


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_series(table(spark, sf_dir, "events"), "ts", "value", keys=["event_type"], grain="day")


_DAILY_EVENTS = """
daily AS (
  SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS price
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2
)"""


# 30 dates per event type: F5 gives fast = min(12, max(3, 30 // 3)) = 10, the rest saturate.
@register("events_indicators_by_type",
          sql="WITH RECURSIVE " + _DAILY_EVENTS + "," + _ind_sql(("event_type",), fast=10)
          + _ROUND_SQL.format(k="event_type, "))
def q_events_indicators(spark, sf_dir):
    """F3, F5-F11 for many series at once: daily mean event value per event type."""
    return _round_indicators(S.add_indicators(events_series(spark, sf_dir), keys=["event_type"]),
                             keys=("event_type",))


_INSTANT_EVENTS = """
daily AS (
  SELECT event_type, ts AS date, avg(value) AS price
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2
)"""


@register("events_instant_indicators",
          sql="WITH RECURSIVE " + _INSTANT_EVENTS + "," + _ind_sql(("event_type",), fast=12)
          + _ROUND_SQL.format(k="event_type, "))
def q_events_instant_indicators(spark, sf_dir):
    """F3, F5-F11 on the instants of the raw events, per event type."""
    series = S.build_series(table(spark, sf_dir, "events"), "ts", "value", keys=["event_type"])
    out = _round_indicators(S.add_indicators(series, keys=["event_type"]), keys=("event_type",))
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


def _round_metrics(df: DataFrame, keys=()) -> DataFrame:
    return df.select(
        *keys, "row_count_used", fround("latest_price", 2).alias("latest_price"),
        fround("latest_return", 6).alias("latest_return"),
        fround("latest_volatility", 6).alias("latest_volatility"),
        fround("latest_rsi", 6).alias("latest_rsi"), fround("latest_macd", 2).alias("latest_macd"),
        fround("latest_macd_signal", 2).alias("latest_macd_signal"),
        fround("var_95", 6).alias("var_95"), fround("var_99", 6).alias("var_99"), "trend_label")


_METRICS_SQL = f"""
, m AS (
  SELECT {{k}}count(*)::BIGINT AS row_count_used,
    arg_max(price, idx) AS latest_price,
    arg_max(ret, idx) FILTER (WHERE ret IS NOT NULL) AS latest_return,
    arg_max(volatility, idx) FILTER (WHERE volatility IS NOT NULL) AS latest_volatility,
    arg_max(rsi, idx) FILTER (WHERE rsi IS NOT NULL) AS latest_rsi,
    arg_max(macd, idx) FILTER (WHERE macd IS NOT NULL) AS latest_macd,
    arg_max(macd_signal, idx) FILTER (WHERE macd_signal IS NOT NULL) AS latest_macd_signal,
    greatest(0, -quantile_cont(ret, 0.05)) AS var_95,
    greatest(0, -quantile_cont(ret, 0.01)) AS var_99
  FROM ind {{g}}
)
SELECT {{k}}row_count_used, {R('latest_price', 2)} AS latest_price, {R('latest_return', 6)} AS latest_return,
  {R('latest_volatility', 6)} AS latest_volatility, {R('latest_rsi', 6)} AS latest_rsi,
  {R('latest_macd', 2)} AS latest_macd, {R('latest_macd_signal', 2)} AS latest_macd_signal,
  {R('var_95', 6)} AS var_95, {R('var_99', 6)} AS var_99,
  CASE WHEN latest_rsi >= 70 THEN 'overheated'
       WHEN latest_rsi <= 30 THEN 'oversold'
       WHEN latest_return > 0 AND latest_macd >= latest_macd_signal THEN 'bullish'
       WHEN latest_return < 0 AND latest_macd < latest_macd_signal THEN 'bearish'
       ELSE 'sideways' END AS trend_label
FROM m"""


@register("finance_latest", sql="WITH RECURSIVE " + _DAILY_ORDERS + "," + _ind_sql()
          + _METRICS_SQL.format(k="", g=""))
def q_finance_latest(spark, sf_dir):
    """Latest indicator values, historical VaR 95/99 and trend label."""
    return _round_metrics(S.latest_metrics(orders_indicators(spark, sf_dir)))


@register("events_latest_by_type", sql="WITH RECURSIVE " + _DAILY_EVENTS + ","
          + _ind_sql(("event_type",), fast=10) + _METRICS_SQL.format(k="event_type, ", g="GROUP BY event_type"))
def q_events_latest(spark, sf_dir):
    """F12, F13, F16 per event type."""
    ind = S.add_indicators(events_series(spark, sf_dir), keys=["event_type"])
    return _round_metrics(S.latest_metrics(ind, keys=["event_type"]), keys=("event_type",))


_FORECAST_SQL = """
s AS (SELECT date, price, row_number() OVER (ORDER BY date) - 1 AS idx,
             epoch_us(CAST(date AS TIMESTAMP)) - lag(epoch_us(CAST(date AS TIMESTAMP))) OVER (ORDER BY date) AS gap
      FROM daily),
fit AS (SELECT count(*) AS n, regr_slope(price, idx) AS slope, regr_intercept(price, idx) AS intercept,
               median(gap) AS step_us, max(date) AS last_date FROM s),
f AS (
  SELECT k::INTEGER AS step,
    CAST(make_timestamp(CAST(epoch_us(CAST(last_date AS TIMESTAMP))
         + floor(CASE WHEN step_us IS NULL OR step_us <= 0 THEN 86400000000.0 ELSE step_us END * k) AS BIGINT)) AS DATE) AS date,
    intercept + slope * (n + k - 1) AS predicted_price
  FROM fit, range(1, 6) t(k) WHERE n >= 6
)"""


@register("forecast_linear", sql="WITH " + _DAILY_ORDERS + "," + _FORECAST_SQL
          + f"\nSELECT step, date, {R('predicted_price', 2)} AS predicted_price FROM f")
def q_forecast_linear(spark, sf_dir):
    """five-step linear baseline forecast of the daily order price."""
    f = S.forecast(orders_indicators(spark, sf_dir), digits=None)
    return f.select("step", "date", fround("predicted_price", 2).alias("predicted_price"))


@register("forecast_reliability", sql="WITH " + _DAILY_ORDERS + "," + _FORECAST_SQL + f""",
lat AS (SELECT count(*)::BIGINT AS row_count_used, arg_max(price, date) AS latest FROM daily),
d AS (SELECT max(abs(predicted_price - latest) / abs(latest)) AS max_dev FROM f, lat)
SELECT row_count_used,
  CASE WHEN latest IS NULL OR latest = 0 OR max_dev IS NULL THEN 'low' WHEN max_dev > 0.2 THEN 'low' ELSE 'medium' END AS level,
  CASE WHEN latest IS NULL OR latest = 0 OR max_dev IS NULL THEN 'no_comparable_points'
       WHEN max_dev > 0.2 THEN 'deviation_over_20pct'
       WHEN max_dev > 0.08 OR row_count_used < 30 THEN 'deviation_or_short_history'
       ELSE 'linear_baseline_only' END AS reason,
  {R('max_dev', 6)} AS max_deviation_ratio,
  (row_count_used > 3650 AND NOT (latest IS NULL OR latest = 0 OR max_dev IS NULL OR max_dev > 0.2)) AS long_history_note
FROM lat, d""")
def q_forecast_reliability(spark, sf_dir):
    """forecast reliability level."""
    ind = orders_indicators(spark, sf_dir)
    rel = S.forecast_reliability(S.latest_metrics(ind), S.forecast(ind, digits=None), digits=None)
    return rel.select("row_count_used", "level", "reason",
                      fround("max_deviation_ratio", 6).alias("max_deviation_ratio"), "long_history_note")


@register("chart_series", sql="WITH RECURSIVE " + _DAILY_ORDERS + "," + _ind_sql() + "," + _FORECAST_SQL.replace(
    "s AS (SELECT date", "s2 AS (SELECT date").replace("FROM s),", "FROM s2),") + f""",
long AS (
  SELECT 'price_moving_average' AS chart, date, 'price' AS series, price AS value FROM ind
  UNION ALL SELECT 'price_moving_average', date, 'ma_short', ma_short FROM ind
  UNION ALL SELECT 'price_moving_average', date, 'ma_long', ma_long FROM ind
  UNION ALL SELECT 'return_volatility', date, 'return_pct', ret * 100 FROM ind
  UNION ALL SELECT 'return_volatility', date, 'volatility_pct', volatility * 100 FROM ind
  UNION ALL SELECT 'rsi_macd', date, 'rsi', rsi FROM ind
  UNION ALL SELECT 'rsi_macd', date, 'macd', macd FROM ind
  UNION ALL SELECT 'rsi_macd', date, 'macd_signal', macd_signal FROM ind
  UNION ALL SELECT 'rsi_macd', date, 'macd_histogram', macd - macd_signal FROM ind
  UNION ALL SELECT 'time_series_forecast', date, 'history', price FROM ind
  UNION ALL SELECT 'time_series_forecast', date, 'forecast', predicted_price FROM f
)
SELECT chart, date, series, {R('value', 2)} AS value FROM long WHERE value IS NOT NULL""")
def q_chart_series(spark, sf_dir):
    """long table behind the price, return/volatility, RSI/MACD and forecast charts."""
    ind = orders_indicators(spark, sf_dir)
    cs = S.chart_series(ind, S.forecast(ind, digits=None))
    return cs.select("chart", "date", "series", fround("value", 2).alias("value"))


@register("duplicate_dates", sql="""
SELECT sum(n_obs - 1)::BIGINT AS duplicate_dates, count(*)::BIGINT AS n_dates, sum(n_obs)::BIGINT AS n_rows
FROM (SELECT CAST(o_orderdate AS DATE) d, count(*) AS n_obs FROM orders
      WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1)""")
def q_duplicate_dates(spark, sf_dir):
    """rows sharing a date, averaged into one point."""
    return S.duplicate_dates(orders_series(spark, sf_dir))


_TS_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%Y/%m/%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y', '%d.%m.%Y', '%Y%m%d']"


@register("detect_date_column", sql=f"""
WITH a AS (SELECT count(*) AS n, count(try_strptime(trim(l_returnflag), {_TS_FORMATS})) AS v8,
                  count(try_strptime(trim(l_linestatus), {_TS_FORMATS})) AS v9, count(l_shipdate) AS v10 FROM lineitem),
c AS (
  SELECT 'l_returnflag' AS "column", 8 AS position, v8 / n AS valid_ratio, false AS has_hint, false AS is_datetime, 0 AS ui_score FROM a
  UNION ALL SELECT 'l_linestatus', 9, v9 / n, false, false, 0 FROM a
  UNION ALL SELECT 'l_shipdate', 10, v10 / n, true, true, 9 FROM a
)
SELECT *, valid_ratio * 4 + CASE WHEN has_hint THEN 3 ELSE 0 END + CASE WHEN is_datetime THEN 2 ELSE 0 END AS score,
       row_number() OVER (ORDER BY valid_ratio * 4 + CASE WHEN has_hint THEN 3 ELSE 0 END + CASE WHEN is_datetime THEN 2 ELSE 0 END DESC, position) AS rank
FROM c WHERE valid_ratio >= 0.5 OR has_hint""")
def q_detect_date(spark, sf_dir):
    """F1 + F20: date-column candidates of lineitem, scored and ranked."""
    d = S.detect_date_columns(table(spark, sf_dir, "lineitem"))
    return d.withColumn("rank", F.col("rank").cast("bigint"))


_NUM_TXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_PRICE_COLS = [("l_orderkey", 0, False, False, 1), ("l_partkey", 1, False, False, 1),
               ("l_suppkey", 2, False, False, 1), ("l_linenumber", 3, False, False, 1),
               ("l_quantity", 4, False, False, 1), ("l_extendedprice", 5, True, False, 6),
               ("l_discount", 6, False, False, 1), ("l_tax", 7, False, False, 1)]


def _price_sql() -> str:
    parts, unions = [], []
    for name, pos, hint, vol, ui in _PRICE_COLS:
        parts.append(f"count({name}) AS c{pos}, stddev_samp({name}) AS s{pos}")
        unions.append(f"SELECT '{name}' AS \"column\", {pos} AS position, c{pos}::BIGINT AS valid_count, "
                      f"c{pos} / n AS valid_ratio, coalesce(s{pos}, 0.0) AS std, {str(hint).lower()} AS has_hint, "
                      f"{str(vol).lower()} AS has_volume, {ui} AS ui_score FROM a")
    for name, pos in (("l_returnflag", 8), ("l_linestatus", 9)):
        v = f"CASE WHEN regexp_matches(trim({name}), '{_NUM_TXT}') THEN try_cast(trim({name}) AS DOUBLE) END"
        parts.append(f"count({v}) AS c{pos}, stddev_samp({v}) AS s{pos}")
        unions.append(f"SELECT '{name}', {pos}, c{pos}::BIGINT, c{pos} / n, coalesce(s{pos}, 0.0), false, false, 0 FROM a")
    score = ("valid_ratio * 3 + least(std, 1000.0) / 1000 + CASE WHEN has_hint THEN 5 ELSE 0 END"
             " - CASE WHEN has_volume THEN 3 ELSE 0 END")
    return (f"WITH a AS (SELECT count(*) AS n, {', '.join(parts)} FROM lineitem),\n"
            f"c AS ({' UNION ALL '.join(unions)})\n"
            f"SELECT \"column\", position, valid_count, {R('valid_ratio', 6)} AS valid_ratio, {R('std', 6)} AS std, "
            f"has_hint, has_volume, ui_score, {R(score, 6)} AS score, "
            f"row_number() OVER (ORDER BY {score} DESC, position) AS rank FROM c WHERE valid_count >= 6")


@register("detect_price_column", sql=_price_sql())
def q_detect_price(spark, sf_dir):
    """F2 + F20: price-column candidates of lineitem, scored and ranked."""
    d = S.detect_price_columns(table(spark, sf_dir, "lineitem"), "l_shipdate")
    return d.select("column", "position", "valid_count", fround("valid_ratio", 6).alias("valid_ratio"),
                    fround("std", 6).alias("std"), "has_hint", "has_volume", "ui_score",
                    fround("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def finance_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: daily order price → indicators → latest metrics, VaR and trend label."""
    return _round_metrics(S.latest_metrics(orders_indicators(spark, sf_dir)))
