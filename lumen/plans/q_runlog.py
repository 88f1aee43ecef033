"""Registered run-log queries (G1, G3-G7, G10-G13, G15, G18) with ``events`` as the log:
``user_id`` is the client / job / run, ``event_type`` the route or status, ``ts`` the
event time, ``event_id`` the arrival order and ``props.k`` a small payload number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.functions.rows import with_row
from lumen.operators import runlog as G
from lumen.plans.registry import register
from lumen.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_K_SQL = "CAST(json_extract(props, '$.k') AS INTEGER)"


@register("job_latest_state", sql="""
SELECT user_id, event_type, value, count(*) OVER (PARTITION BY user_id)::BIGINT AS events FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_job_latest_state(spark, sf_dir):
    """Latest state per key (max_by over the event order)."""
    return G.latest_state(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


def _job_events(spark, sf_dir):
    e = _events(spark, sf_dir)
    status = (F.when(F.col("event_type") == "signup", "queued")
              .when(F.col("event_type").isin("click", "view"), "running")
              .when(F.col("event_type") == "purchase", "completed")
              .when(F.col("event_type") == "error", "failed"))
    return e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("event_time"), F.col("event_id").alias("seq"),
                    F.col("event_type").alias("kind"),
                    F.when(F.col("event_type") == "purchase", F.concat(F.lit("run_"), F.col("event_id"))).alias("run_id"),
                    status.alias("status"),
                    ((F.col("event_type") == "view") & (F.col("k") > 90)).alias("cancel_requested"))


_JOB_EVENTS_SQL = f"""
je AS (
  SELECT user_id AS job_id, ts AS event_time, event_id AS seq, event_type AS kind,
    CASE WHEN event_type = 'purchase' THEN 'run_' || event_id END AS run_id,
    CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type IN ('click', 'view') THEN 'running'
         WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' END AS status,
    (event_type = 'view' AND {_K_SQL} > 90) AS cancel_requested
  FROM events
),
jobs AS (
  SELECT job_id,
    arg_min(kind, (event_time, seq)) AS kind, min(event_time) AS created_at,
    arg_max(run_id, (event_time, seq)) FILTER (WHERE run_id IS NOT NULL) AS run_id,
    arg_max(status, (event_time, seq)) AS status,
    min(event_time) FILTER (WHERE status = 'running') AS started_at,
    max(event_time) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS finished_at,
    bool_or(coalesce(cancel_requested, false)) AS cancel_any,
    max(event_time) AS updated_at, count(*)::BIGINT AS events
  FROM je GROUP BY job_id
)"""


@register("job_upsert", sql="WITH " + _JOB_EVENTS_SQL + """
SELECT job_id, kind, created_at, run_id, status, started_at, finished_at, updated_at, events,
  cancel_any AND status NOT IN ('completed', 'failed', 'cancelled') AS cancel_requested
FROM jobs""")
def q_job_upsert(spark, sf_dir):
    """G4 + G18: job rows folded from upsert events (run_id coalesced, kind/created kept)."""
    return G.fold_jobs(_job_events(spark, sf_dir))


@register("job_elapsed", sql="WITH " + _JOB_EVENTS_SQL + """
SELECT job_id, round(greatest(0.0, (epoch_us(coalesce(finished_at, (SELECT max(ts) FROM events)))
   - epoch_us(coalesce(started_at, created_at))) / 1e6), 2) AS elapsed_seconds
FROM jobs""")
def q_job_elapsed(spark, sf_dir):
    """Elapsed seconds per job, open jobs measured to the log's last event."""
    jobs = G.fold_jobs(_job_events(spark, sf_dir))
    now = jobs.agg(F.max("updated_at").alias("__now"))
    j = with_row(jobs, now)
    return j.select("job_id", G.job_elapsed(j, F.col("__now")).alias("elapsed_seconds"))


@register("ttl_cleanup", sql="WITH " + _JOB_EVENTS_SQL + """
SELECT job_id FROM jobs
WHERE epoch_us(coalesce(finished_at, created_at)) >= epoch_us((SELECT max(ts) FROM events)) - 4 * 3600 * 1000000::BIGINT""")
def q_ttl_cleanup(spark, sf_dir):
    """Jobs kept by the 4-hour TTL, measured at the log's last event."""
    jobs = G.fold_jobs(_job_events(spark, sf_dir))
    now = jobs.agg(F.max("updated_at").alias("__now"))
    j = with_row(jobs, now)
    return G.ttl_cleanup(j, F.col("__now")).select("job_id")


def _registrations(spark, sf_dir):
    e = _events(spark, sf_dir)
    ext = F.when(F.col("k") % 3 == 0, ".csv").when(F.col("k") % 3 == 1, ".png").otherwise(".joblib")
    return e.select(F.concat(F.lit("run_"), F.col("user_id")).alias("run_id"),
                    F.concat(F.lit("project_"), F.col("user_id") % 7).alias("project_id"),
                    F.concat(F.lit("outputs/"), F.col("event_type"), F.lit("_"), F.col("k") % 5, ext).alias("relative_path"),
                    F.col("ts").alias("registered_at"),
                    (F.unix_seconds(F.col("ts").cast("timestamp")) + 86400).alias("expires_at"),
                    "event_type", "event_id", "k", "user_id", "ts")


_REG_SQL = f"""
reg AS (
  SELECT 'run_' || user_id AS run_id, 'project_' || (user_id % 7) AS project_id,
    'outputs/' || event_type || '_' || ({_K_SQL} % 5) ||
      CASE WHEN {_K_SQL} % 3 = 0 THEN '.csv' WHEN {_K_SQL} % 3 = 1 THEN '.png' ELSE '.joblib' END AS relative_path,
    ts AS registered_at, floor(epoch(ts))::BIGINT + 86400 AS expires_at, event_type, event_id, {_K_SQL} AS k, user_id, ts
  FROM events
),
rv AS (SELECT run_id, max(registered_at) AS rv FROM reg WHERE event_type = 'error' GROUP BY 1),
art AS (
  SELECT run_id, relative_path, min(registered_at) AS created_at, max(registered_at) AS last_registered_at,
    arg_max(expires_at, registered_at) AS expires_at, arg_max(project_id, registered_at) AS project_id
  FROM reg GROUP BY 1, 2
),
art2 AS (
  SELECT art.*, 'artifact_' || substr(sha256(run_id || ':' || relative_path), 1, 24) AS artifact_id,
    CASE WHEN lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) IN ('.png', '.jpg', '.jpeg', '.webp', '.svg') THEN 'chart'
         WHEN lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) IN ('.py', '.ipynb') THEN 'code'
         WHEN lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) IN ('.docx', '.pdf', '.html') THEN 'report'
         WHEN lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) IN ('.joblib', '.pkl') THEN 'model'
         WHEN lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) IN ('.csv', '.xlsx') THEN 'data'
         ELSE 'artifact' END AS artifact_type,
    CASE WHEN rv.rv > art.last_registered_at THEN rv.rv END AS revoked_at
  FROM art LEFT JOIN rv USING (run_id)
)"""


def _artifacts(spark, sf_dir):
    reg = _registrations(spark, sf_dir)
    revs = reg.where(F.col("event_type") == "error").select("run_id", F.col("registered_at").alias("revoked_at"))
    return G.artifact_registry(reg.select("run_id", "project_id", "relative_path", "registered_at", "expires_at"), revs)


@register("artifact_registry", sql="WITH " + _REG_SQL + """
SELECT run_id, relative_path, created_at, last_registered_at, expires_at, project_id, artifact_id, artifact_type, revoked_at
FROM art2""")
def q_artifact_registry(spark, sf_dir):
    """Artifacts per (run, path): re-registration refreshes expiry and clears
    an earlier revocation; error events revoke the run's artifacts; type from suffix."""
    return _artifacts(spark, sf_dir)


@register("artifact_validity", sql="WITH " + _REG_SQL + f""",
req AS (
  SELECT event_id AS request_id, 'artifact_' || substr(sha256(run_id || ':' || relative_path), 1, 24) AS artifact_id,
    CASE WHEN k % 17 = 0 THEN relative_path || '.bak' ELSE relative_path END AS relative_path,
    run_id, 'project_' || ((user_id + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) % 7) AS project_id,
    floor(epoch(ts))::BIGINT + 3600 * (k % 40) AS at_epoch
  FROM reg WHERE event_type = 'view'
)
SELECT req.request_id, req.artifact_id,
  CASE WHEN a.artifact_id IS NULL THEN 'unknown' WHEN a.revoked_at IS NOT NULL THEN 'revoked'
       WHEN a.expires_at <= req.at_epoch THEN 'expired' WHEN a.relative_path <> req.relative_path THEN 'path_mismatch'
       WHEN req.run_id IS NOT NULL AND a.run_id <> req.run_id THEN 'run_mismatch'
       WHEN req.project_id IS NOT NULL AND a.project_id <> req.project_id THEN 'project_mismatch'
       ELSE 'ok' END AS reason
FROM req LEFT JOIN art2 a ON a.artifact_id = req.artifact_id""")
def q_artifact_validity(spark, sf_dir):
    """Reason code for artifact access requests (view events)."""
    reg = _registrations(spark, sf_dir).where(F.col("event_type") == "view")
    req = reg.select(
        F.col("event_id").alias("request_id"),
        G.stable_id("artifact", F.col("run_id"), F.col("relative_path")).alias("artifact_id"),
        F.when(F.col("k") % 17 == 0, F.concat("relative_path", F.lit(".bak"))).otherwise(F.col("relative_path"))
        .alias("relative_path"),
        "run_id",
        F.concat(F.lit("project_"), (F.col("user_id") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)) % 7).alias("project_id"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + 3600 * (F.col("k") % 40)).alias("at_epoch"))
    return G.artifact_validity(req, _artifacts(spark, sf_dir))


@register("sliding_rate", sql="""
SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts
                                RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS calls_in_window
FROM events""")
def q_sliding_rate(spark, sf_dir):
    """G13 (all calls): requests of the same (client, route) within the last 60 s."""
    e = table(spark, sf_dir, "events")
    return G.sliding_counts(e, ["user_id", "event_type"], "ts").select("event_id", "calls_in_window")


@register("sliding_rate_hourly", sql="""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
                                RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND CURRENT ROW)::BIGINT AS calls_in_window
FROM events""")
def q_sliding_rate_hourly(spark, sf_dir):
    """G13 (all calls) with a 3-hour window per client: the halo crosses bucket edges."""
    e = table(spark, sf_dir, "events")
    return G.sliding_counts(e, ["user_id"], "ts", window_seconds=3 * 3600).select("event_id", "calls_in_window")


RATE_QUERY_LIMIT = 3
RATE_QUERY_SECONDS = 10 * 86_400


def rate_limit_sql(columns: str, limit: int = RATE_QUERY_LIMIT, seconds: int = RATE_QUERY_SECONDS, user: str = "user_id") -> str:
    """The sequential rule as a recursion over each key's calls, with the admitted instants."""
    return f"""
WITH RECURSIVE numbered AS (
  SELECT {user} AS user_id, event_type, event_id, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY {user}, event_type ORDER BY ts, event_id) AS n FROM events),
step AS (
  SELECT user_id, event_type, event_id, n, [us] AS held, true AS admitted FROM numbered WHERE n = 1
  UNION ALL
  SELECT c.user_id, c.event_type, c.event_id, c.n,
         CASE WHEN len(list_filter(s.held, lambda x: x >= c.us - {seconds}::BIGINT * 1000000)) < {limit}
              THEN list_append(list_filter(s.held, lambda x: x >= c.us - {seconds}::BIGINT * 1000000), c.us)
              ELSE list_filter(s.held, lambda x: x >= c.us - {seconds}::BIGINT * 1000000) END,
         len(list_filter(s.held, lambda x: x >= c.us - {seconds}::BIGINT * 1000000)) < {limit}
  FROM step s JOIN numbered c ON c.user_id = s.user_id AND c.event_type = s.event_type AND c.n = s.n + 1)
SELECT {columns} FROM step"""


@register("rate_limit_admitted", sql=rate_limit_sql("event_id, admitted"))
def q_rate_limit_admitted(spark, sf_dir):
    """G13 (reference semantics, rejected calls not counted), at most 3 a user and type in 10 days."""
    e = table(spark, sf_dir, "events")
    return G.admitted_requests(e, ["user_id", "event_type"], "ts", "event_id", RATE_QUERY_LIMIT,
                               RATE_QUERY_SECONDS).select("event_id", "admitted")


@register("rate_limit_unbroken", sql=rate_limit_sql("event_id, admitted", 40, 12 * 3600, "0"))
def q_rate_limit_unbroken(spark, sf_dir):
    """At most 40 calls of an event type in 12 hours, whoever calls: clients that never pause
    for as long, so every burst is replayed in many blocks."""
    e = table(spark, sf_dir, "events")
    return G.admitted_requests(e, ["event_type"], "ts", "event_id", 40, 12 * 3600).select("event_id", "admitted")


@register("dedupe_links", sql=f"""
SELECT url, arg_max(event_type, event_id) AS kind, arg_max(event_id, event_id) AS ord
FROM (SELECT '/api/artifacts/' || event_type || '/' || ({_K_SQL} % 13) AS url, event_type, event_id FROM events)
GROUP BY url""")
def q_dedupe_links(spark, sf_dir):
    """Artifact links deduplicated by URL, last one wins."""
    e = _events(spark, sf_dir)
    links = e.select(F.concat(F.lit("/api/artifacts/"), F.col("event_type"), F.lit("/"), F.col("k") % 13).alias("url"),
                     F.col("event_type").alias("kind"), F.col("event_id").alias("ord"))
    return G.dedupe_links(links)


@register("insert_if_absent", sql="""
WITH u AS (SELECT DISTINCT user_id FROM events),
existing AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-16')
SELECT 'user_' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 24) AS id, user_id
FROM u WHERE user_id NOT IN (SELECT user_id FROM existing)""")
def q_insert_if_absent(spark, sf_dir):
    """G1: users to insert — those not already known (signed up before mid-month)."""
    e = table(spark, sf_dir, "events")
    existing = e.where((F.col("event_type") == "signup") & (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))) \
        .select("user_id").distinct()
    incoming = e.select("user_id").distinct()
    fresh = G.insert_if_absent(existing, incoming, "user_id")
    return fresh.select(G.stable_id("user", F.col("user_id").cast("string")).alias("id"), "user_id")


@register("run_manifest", sql=r"""
WITH f AS (SELECT regexp_extract(filename, '([^/]+)$', 1) AS name, sha256(content) AS hash, size
           FROM read_blob('/root/testdata/sf0.01/*.parquet'))
SELECT 'run_lineitem_price' AS run_id, 'model' AS run_type,
       sha256(string_agg(name || chr(0) || hash, chr(0) ORDER BY name)) AS combined_input_hash,
       '{"split":"l_orderkey % 4 = 0","target":"l_extendedprice"}' AS parameters_json,
       count(*)::INT AS n_files, sum(size)::BIGINT AS input_bytes, 3::INT AS n_models FROM f""")
def q_run_manifest(spark, sf_dir):
    """Run manifest over the input table files and a model run's results (without its
    clock columns)."""
    from lumen.plans.q_model import q_best_model
    from lumen.sources import files as S
    hashes = S.file_hashes(spark, f"{sf_dir.rstrip('/')}/*.parquet")
    m = G.run_manifest("run_lineitem_price", "model", hashes, S.batch_hash(hashes),
                          {"target": "l_extendedprice", "split": "l_orderkey % 4 = 0"}, q_best_model(spark, sf_dir))
    return m.select("run_id", "run_type", "combined_input_hash", "parameters_json", F.size("input_files").alias("n_files"),
                    F.aggregate("input_files", F.lit(0).cast("bigint"), lambda a, f: a + f["size_bytes"]).alias("input_bytes"),
                    F.size("models").alias("n_models"))
