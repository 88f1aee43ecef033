"""Registered streaming queries (W1-W4): ``events`` replayed as a file stream and run to
completion (availableNow) into a sink table under the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.plans.q_runlog import RATE_QUERY_LIMIT, RATE_QUERY_SECONDS, rate_limit_sql
from lumen.plans.registry import register
from lumen.streaming import streams as W


@register("stream_daily_series", sql=f"""
SELECT event_type, CAST(ts AS DATE) AS date, {R('avg(value)', 6)} AS price, count(*)::BIGINT AS n_obs
FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY 1, 2""")
def q_stream_daily_series(spark, sf_dir):
    """Daily mean value per event type, emitted when the watermark closes the day."""
    s = W.daily_series_stream(W.table_stream(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    out = W.run_to_table(s, "append", "daily_series")
    return out.select("event_type", "date", fround("price", 6).alias("price"), "n_obs")


@register("stream_window_counters", sql="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*)::BIGINT AS rows,
       count(*) FILTER (WHERE value IS NULL)::BIGINT AS missing
FROM events GROUP BY 1""")
def q_stream_window_counters(spark, sf_dir):
    """Hourly row / missing / distinct-user counters (update mode)."""
    s = W.window_counters(W.table_stream(spark, sf_dir, "events"), "ts", "value", "user_id")
    out = W.run_to_table(s, "update", "window_counters", key=["window_start"])
    # approx_users (HyperLogLog) is checked against the exact count in tests/test_streaming.py
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rows", "missing")


@register("stream_latest_state", sql="""
SELECT user_id, event_type, value, count(*) OVER (PARTITION BY user_id)::BIGINT AS events FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_stream_latest_state(spark, sf_dir):
    """Latest event type and value per user (update mode)."""
    s = W.latest_state_stream(W.table_stream(spark, sf_dir, "events"), "user_id", ["ts", "event_id"],
                              ["event_type", "value"])
    return W.run_to_table(s, "update", "latest_state", key=["user_id"]).drop("__batch")


@register("stream_rate_limit", sql=rate_limit_sql("user_id, event_type, event_id, admitted, false AS late"))
def q_stream_rate_limit(spark, sf_dir):
    """Admitted / late flag per request, at most 3 a user and type in 10 days."""
    s = W.rate_limit_stream(W.table_stream(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id",
                            limit=RATE_QUERY_LIMIT, window_seconds=RATE_QUERY_SECONDS)
    return W.run_to_table(s, "append", "rate_limit", state_store=W.ROCKS_DB).drop("__batch")


def _stream_ind_sql() -> str:
    from lumen.plans.q_finance import _ROUND_SQL, _ind_sql
    daily = """
daily AS (
  SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS price FROM events
  WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
  GROUP BY 1, 2
)"""
    # 29 closed days per type: F5 gives fast = min(12, max(3, 29 // 3)) = 9
    return "WITH RECURSIVE " + daily + "," + _ind_sql(("event_type",), fast=9) + _ROUND_SQL.format(k="event_type, ")


@register("stream_indicators", sql=_stream_ind_sql())
def q_stream_indicators(spark, sf_dir):
    """W2 + F5-F11: indicators over the days a watermarked stream has closed."""
    from lumen.operators import series as S
    from lumen.plans.q_finance import _round_indicators
    s = W.daily_series_stream(W.table_stream(spark, sf_dir, "events"), "ts", "value", ["event_type"])
    daily = W.run_to_table(s, "append", "daily_for_indicators").select("event_type", "date", "price")
    return _round_indicators(S.add_indicators(daily, ["event_type"]), keys=("event_type",))
