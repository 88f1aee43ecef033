import datetime as dt
import random

import numpy as np
import pytest

from lumen.operators import runlog as G


def _burst(spark):
    rng = np.random.default_rng(1)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    # one hot client sends 600 requests in 90 s (a third of all rows), others are sparse
    for t in np.sort(rng.uniform(0, 90, 600)):
        rows.append((eid, base + dt.timedelta(seconds=float(t)), 1, "/api/x")); eid += 1
    for c in range(2, 40):
        for t in np.sort(rng.uniform(0, 4000, 30)):
            rows.append((eid, base + dt.timedelta(seconds=float(t)), c, "/api/x")); eid += 1
    return spark.createDataFrame(rows, "event_id long, ts timestamp, client long, path string"), rows


def _brute(rows, limit=180, win=60.0):
    out = {}
    by = {}
    for eid, ts, c, p in sorted(rows, key=lambda r: (r[2], r[3], r[1], r[0])):
        kept = by.setdefault((c, p), [])
        t = ts.timestamp()
        live = [s for s in kept if s >= t - win]
        ok = len(live) < limit
        if ok:
            live.append(t)
        by[(c, p)] = live
        out[eid] = ok
    return out


def test_admitted_matches_brute_force(spark):
    df, rows = _burst(spark)
    got = {r["event_id"]: r["admitted"] for r in
           G.admitted_requests(df, ["client", "path"], "ts", "event_id").select("event_id", "admitted").collect()}
    exp = _brute(rows)
    assert got == exp
    assert sum(1 for v in exp.values() if not v) > 0


def test_sliding_counts_match_brute_force(spark):
    df, rows = _burst(spark)
    got = {r["event_id"]: r["calls_in_window"] for r in
           G.sliding_counts(df, ["client"], "ts", window_seconds=60, bucket_seconds=30).collect()}
    ts = {}
    for eid, t, c, _ in rows:
        ts.setdefault(c, []).append((t.timestamp(), eid))
    for c, lst in ts.items():
        arr = np.array([t for t, _ in lst])
        for t, eid in lst:
            assert got[eid] == int(((arr >= t - 60) & (arr <= t)).sum())


def test_job_fold_and_artifacts(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        ("j1", t, 1, "model", None, "queued", False),
        ("j1", t + dt.timedelta(seconds=5), 2, "finance", "run_a", "running", True),
        ("j1", t + dt.timedelta(seconds=9), 3, "model", None, "completed", False),
    ], "job_id string, event_time timestamp, seq int, kind string, run_id string, status string, "
       "cancel_requested boolean")
    j = G.fold_jobs(ev).collect()[0]
    assert (j["kind"], j["run_id"], j["status"], j["cancel_requested"]) == ("model", "run_a", "completed", False)
    assert spark.createDataFrame([("a.PNG",), ("m.joblib",), ("x.bin",)], "p string") \
        .select(G.artifact_type(__import__("pyspark.sql.functions", fromlist=["col"]).col("p"))).collect() \
        == [("chart",), ("model",), ("artifact",)]


def test_stream_rate_limit_across_batches(spark, tmp_path):
    from lumen.streaming import streams as W

    df, rows = _burst(spark)
    # time-ordered files, one micro-batch each: state must carry admitted stamps over
    ordered = sorted(rows, key=lambda r: r[1])
    chunk = len(ordered) // 4 + 1
    src = tmp_path / "src"
    for i in range(4):
        part = ordered[i * chunk:(i + 1) * chunk]
        spark.createDataFrame(part, "event_id long, ts timestamp, client long, path string") \
            .coalesce(1).write.parquet(str(src / f"part{i}"))
    import glob, shutil
    flat = tmp_path / "flat"
    flat.mkdir()
    import os
    for i, f in enumerate(sorted(glob.glob(str(src / "part*" / "*.parquet")))):
        dst = flat / f"events_{i}.parquet"
        shutil.copy(f, dst)
        os.utime(dst, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))  # file order = time order
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    out = W.run_to_table(W.rate_limit_stream(stream, ["client", "path"], "ts", "event_id"), "append", "rl_test")
    got = {r["event_id"]: (r["admitted"], r["late"]) for r in out.collect()}
    exp = _brute(rows)
    assert all(not late for _, late in got.values())
    assert {k: a for k, (a, _) in got.items()} == exp


@pytest.mark.parametrize("limit, window, rate", [(3, 60, 2), (180, 60, 0.2), (1, 30, 5), (12, 60, 5.2)])
def test_a_client_that_never_pauses(spark, limit, window, rate):
    """One unbroken burst in many blocks, always, mostly or hardly ever at the limit."""
    r = random.Random(limit)
    start, t, rows = dt.datetime(2024, 1, 1), 0.0, []
    for i in range(3000):
        t += min(r.expovariate(1 / rate), window * 0.9) if i % 500 else 0.0
        rows.append((2**60 + i, start + dt.timedelta(seconds=round(t, 3)), "c", "x" if i % 3 else None))
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, client string, note string").repartition(7)
    live, exp = [], {}
    for eid, when, _, _ in rows:
        live = [x for x in live if x >= when - dt.timedelta(seconds=window)]
        exp[eid] = len(live) < limit
        if exp[eid]:
            live.append(when)
    out = G.admitted_requests(df, ["client"], "ts", "event_id", limit, window, bucket_seconds=window)
    assert out.columns == [*df.columns, "admitted"]
    assert {x["event_id"]: x["admitted"] for x in out.collect()} == exp
    assert G.admitted_requests(df.limit(0), ["client"], "ts", "event_id").collect() == []


def test_a_full_window_is_skipped_not_walked():
    class Seen(list):
        reads = 0

        def __getitem__(self, i):
            Seen.reads += 1
            return super().__getitem__(i)

    stamps = Seen(range(100_000))
    assert G._Admission(3, 10_000).admits(stamps) == [n for a in range(0, 100_000, 10_001) for n in (a, a + 1, a + 2)]
    assert Seen.reads < 2_000
    assert G._Admission(0, 10).admits([1, 2]) == []


def test_bursts_of_equal_stamps_in_many_pieces_match_a_walk(spark, monkeypatch):
    monkeypatch.setattr(G, "PIECE", 4)
    r = random.Random(4)
    rows, n = [], 0
    for client in ("a", "b", "c", None):
        t = 0
        for _ in range(400):
            t += r.choice((0, 0, 0, 1, 1, 7, 25) if client != "c" else (0, 1, 40))
            rows.append((client, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), n))
            n += 1
    df = spark.createDataFrame(rows, "client string, ts timestamp, n int")
    got = {x["n"]: x["admitted"] for x in G.admitted_requests(df, ["client"], "ts", "n", 5, 30, bucket_seconds=30).collect()}
    expected = {}
    for client in ("a", "b", "c"):
        held = []
        for _, t, n in sorted((c, t, n) for c, t, n in rows if c == client):
            expected[n] = sum((t - h).total_seconds() <= 30 for h in held) < 5
            held += [t] if expected[n] else []
    assert got == expected
