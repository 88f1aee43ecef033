import random

from pyspark.sql import functions as F

from lumen.streaming import streams as W
from tests.conftest import SF01


def test_window_counters_approx_users_close_to_exact(spark):
    out = W.run_to_table(W.window_counters(W.table_stream(spark, SF01, "events"), "ts", "value", "user_id"),
                         "complete", "counters_test")
    exact = (spark.read.parquet(f"{SF01}/events.parquet")
             .groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"))
             .agg(F.count_distinct("user_id").alias("exact")).select(F.col("w.start").alias("window_start"), "exact"))
    rows = out.join(exact, on="window_start").collect()
    assert len(rows) == out.count() > 0
    # rsd 0.05 is a standard error: the mean relative error stays within it and no window
    # is off by more than a few standard errors
    rel = [abs(r["approx_users"] - r["exact"]) / r["exact"] for r in rows]
    assert sum(rel) / len(rel) <= 0.05
    assert max(rel) <= 0.2


def test_latest_state_stream_matches_batch(spark):
    from lumen.operators import runlog as G
    s = W.latest_state_stream(W.table_stream(spark, SF01, "events"), "user_id", ["ts", "event_id"],
                              ["event_type", "value"])
    got = {r["user_id"]: (r["event_type"], r["value"]) for r in W.run_to_table(s, "update", "latest_test", key=["user_id"]).collect()}
    batch = G.latest_state(spark.read.parquet(f"{SF01}/events.parquet"), ["user_id"], ["ts", "event_id"],
                           ["event_type", "value"])
    assert got == {r["user_id"]: (r["event_type"], r["value"]) for r in batch.collect()}


def _admitted(rows, limit, window_us, batches):
    """The rule, request by request: rows are (client, us, order); a batch is handled sorted."""
    state, out = {}, {}
    for batch in batches:
        for c, t, o in sorted((r for r in rows if r[2] in batch), key=lambda r: (r[1], r[2])):
            held, last = state.get(c, ([], None))
            late = last is not None and t < last - window_us
            held = held if late else [x for x in held if x >= t - window_us]
            ok = not late and len(held) < limit
            state[c] = (held + [t] if ok else held, last if late else max(last or t, t))
            out[o] = (ok, late)
    return out


def test_rate_limit_of_a_busy_client_is_sorted_outside_memory_and_survives_a_restart(spark, tmp_path, monkeypatch):
    from lumen.streaming import admission
    monkeypatch.setattr(admission, "PAGE", 256)
    r, second = random.Random(7), 1_000_000
    # the second batch begins within the window before the first one's end, some of it late
    stamps = [1_700_000_000 * second + r.randrange(*((0, 900 * second) if i < 20_000 or i % 50 == 0 else (880 * second, 1500 * second)))
              for i in range(30_000)]
    rows = [("busy" if i % 20 else r.choice(["a", "b", None]), t, i) for i, t in enumerate(stamps)]
    rows += [("busy", stamps[0] + 400 * second, 40_000 + i) for i in range(500)]   # ties
    rows += [("a", None, 50_000)]                                                     # without a stamp or a client: left out
    schema = "client string, ts timestamp, request bigint"
    frame = spark.createDataFrame(rows, "client string, us bigint, request bigint").select(
        "client", F.timestamp_micros("us").alias("ts"), "request")
    early = F.col("request") < 20_000
    source, location = str(tmp_path / "in"), str(tmp_path / "stream")

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        return W.run_to_table(W.rate_limit_stream(stream, ["client"], "ts", "request", limit=40, window_seconds=30,
                                                  delay="30 minutes"),
                              location=location, state_store=W.ROCKS_DB)

    frame.where(early).coalesce(1).write.parquet(source)
    run()
    frame.where(~early).coalesce(1).write.mode("append").parquet(source)
    got = {x["request"]: (x["admitted"], x["late"]) for x in run().collect()}
    known = [x for x in rows if None not in x]
    want = _admitted(known, 40, 30 * second, [range(20_000), range(20_000, 60_000)])
    assert len(got) == len(known) and got == want
    assert 0 < sum(ok for ok, _ in want.values()) < len(known) and any(late for _, late in want.values())
    assert spark.conf.get(W.STATE_STORE) != W.ROCKS_DB
