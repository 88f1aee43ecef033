"""Run, job and artifact logs as tables.

The reference keeps these in a transactional store.  Here every change is an
appended event row (Parquet), and current state is a *view*: the latest row per key
by event time.  Reads are aggregates and joins, so a log of any size is folded in one
job; no row-level update is ever needed.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.rows import with_row
from lumen.session import checkpoint_dir, ship_package

JOB_TTL_SECONDS = 4 * 3600
RATE_LIMIT = 180
RATE_WINDOW_SECONDS = 60
PIECE = 256   # stamps that a row of the replay holds at most

# fixed values: artifact type by file suffix
ARTIFACT_SUFFIXES = (
    ("chart", (".png", ".jpg", ".jpeg", ".webp", ".svg")),
    ("code", (".py", ".ipynb")),
    ("report", (".docx", ".pdf", ".html")),
    ("model", (".joblib", ".pkl")),
    ("data", (".csv", ".xlsx")),
)
FINAL_JOB_STATES = ("completed", "failed", "cancelled")


# ---------------------------------------------------------------------------- G19, G1
def new_id(prefix: str) -> Column:
    """``prefix_`` + 32 hex characters (random)."""
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(F.expr("uuid()"), "-", ""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """G1: ``prefix_`` + first 24 hex characters of sha256 of the parts joined by ':'."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """G1: rows of ``incoming`` whose key is not in ``existing``, to append: the first per key
    by ``order_col`` (rows that tie, or all without one, in the order of their columns)."""
    fresh = incoming.join(existing.select(key), on=key, how="left_anti").select(*incoming.columns)
    lead = ([order_col] if order_col else []) + [c for c in incoming.columns if c not in (key, order_col)]
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in lead])).alias("row")
    return fresh.groupBy(key).agg(row).select(key, "row.*").select(*incoming.columns) if lead else fresh.distinct()


# ---------------------------------------------------------------------------- G3, G4, G18
def latest_state(log: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """The value columns of the latest event per key (``max_by`` on a struct, one pass)."""
    order = F.struct(*[F.col(f"`{c}`") for c in order_cols])
    vals = F.struct(*[F.col(f"`{c}`") for c in value_cols])
    return log.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(vals, order).alias("__v"), F.count(F.lit(1)).alias("events")) \
        .select(*[F.col(f"`{k}`") for k in keys], "__v.*", "events")


def fold_jobs(events: DataFrame, key: str = "job_id", time_col: str = "event_time") -> DataFrame:
    """G4 + G18: fold job upserts into the current job row.

    Later events replace earlier ones, except: ``run_id`` keeps the last non-null value
    (``COALESCE(new, old)``), ``kind`` and ``created_at`` keep the first, and a cancel
    request only counts while the job is not in a final state.
    """
    order = F.struct(F.col(time_col), F.col("seq"))
    agg = events.groupBy(key).agg(
        F.min_by("kind", order).alias("kind"),
        F.min(time_col).alias("created_at"),
        F.max_by("run_id", F.when(F.col("run_id").isNotNull(), order)).alias("run_id"),
        F.max_by("status", order).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col(time_col))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*FINAL_JOB_STATES), F.col(time_col))).alias("finished_at"),
        F.max(F.coalesce(F.col("cancel_requested"), F.lit(False))).alias("__cancel"),
        F.max(time_col).alias("updated_at"),
        F.count(F.lit(1)).alias("events"),
    )
    return agg.withColumn("cancel_requested", F.col("__cancel") & ~F.col("status").isin(*FINAL_JOB_STATES)) \
        .drop("__cancel")


def job_elapsed(jobs: DataFrame, now: Column) -> Column:
    """max(0, (finished or now) - (started or created)) in seconds, 2 decimals."""
    end = F.coalesce(F.col("finished_at"), now)
    start = F.coalesce(F.col("started_at"), F.col("created_at"))
    return F.round(F.greatest(F.lit(0.0), (epoch_us(end) - epoch_us(start)) / 1e6), 2)


def ttl_cleanup(jobs: DataFrame, now: Column, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Jobs still kept: (finished or created) not older than the TTL."""
    ref = F.coalesce(F.col("finished_at"), F.col("created_at"))
    return jobs.where(epoch_us(ref) >= epoch_us(now) - ttl_seconds * 1_000_000)


# ---------------------------------------------------------------------------- G6, G7, G10, G11
def epoch_us(c: Column) -> Column:
    """Microseconds since epoch of a timestamp with or without time zone (session zone UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def artifact_type(path: Column) -> Column:
    """Artifact type from the file suffix."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = None
    for kind, sufs in ARTIFACT_SUFFIXES:
        cond = suffix.isin(*sufs)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out.otherwise(F.lit("artifact"))


def artifact_registry(registrations: DataFrame, revocations: DataFrame | None = None) -> DataFrame:
    """G6 (+G10): one row per (run_id, relative_path).

    ``registrations``: run_id, project_id, relative_path, registered_at, expires_at.
    Re-registering refreshes the expiry and clears an earlier revocation.
    ``revocations``: run_id, revoked_at — revokes every artifact of the run registered
    before that moment.
    """
    # rows registered at one moment: the later expiry, then the larger project id
    order = F.struct("registered_at", "expires_at", "project_id")
    reg = registrations.groupBy("run_id", "relative_path").agg(
        F.min("registered_at").alias("created_at"),
        F.max("registered_at").alias("last_registered_at"),
        F.max_by("expires_at", order).alias("expires_at"),
        F.max_by("project_id", order).alias("project_id"),
    )
    reg = reg.withColumn("artifact_id", stable_id("artifact", F.col("run_id"), F.col("relative_path"))) \
        .withColumn("artifact_type", artifact_type(F.col("relative_path")))
    if revocations is None:
        return reg.withColumn("revoked_at", F.lit(None).cast("timestamp"))
    # latest revocation of the run after the last registration wins
    rv = revocations.groupBy("run_id").agg(F.max("revoked_at").alias("__rv"))
    j = reg.join(rv, on="run_id", how="left")
    return j.withColumn("revoked_at", F.when(F.col("__rv") > F.col("last_registered_at"), F.col("__rv"))).drop("__rv")


def artifact_validity(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Reason code per access request, first failing rule wins: unknown, revoked,
    expired (expires_at <= request epoch), path, run, project; else ok.

    ``requests``: request_id, artifact_id, relative_path, run_id, project_id, at_epoch.
    """
    a = artifacts.select(F.col("artifact_id"), F.col("relative_path").alias("a_path"), F.col("run_id").alias("a_run"),
                         F.col("project_id").alias("a_project"), "expires_at", "revoked_at", F.lit(True).alias("__known"))
    j = requests.join(a, on="artifact_id", how="left")
    reason = (F.when(F.col("__known").isNull(), F.lit("unknown"))
              .when(F.col("revoked_at").isNotNull(), F.lit("revoked"))
              .when(F.col("expires_at") <= F.col("at_epoch"), F.lit("expired"))
              .when(F.col("a_path") != F.col("relative_path"), F.lit("path_mismatch"))
              .when(F.col("run_id").isNotNull() & (F.col("a_run") != F.col("run_id")), F.lit("run_mismatch"))
              .when(F.col("project_id").isNotNull() & (F.col("a_project") != F.col("project_id")),
                    F.lit("project_mismatch"))
              .otherwise(F.lit("ok")))
    return j.select("request_id", "artifact_id", reason.alias("reason"))


def revoke_run(artifacts: DataFrame, run_id: Column | str, at: Column) -> DataFrame:
    """Mark live artifacts of a run revoked; the count is ``count_if(newly_revoked)``."""
    rid = F.lit(run_id) if isinstance(run_id, str) else run_id
    newly = (F.col("run_id") == rid) & F.col("revoked_at").isNull()
    return artifacts.withColumn("newly_revoked", newly).withColumn(
        "revoked_at", F.when(newly, at).otherwise(F.col("revoked_at")))


# ---------------------------------------------------------------------------- G8
def replace_model_results(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Drop every stored row of the runs present in ``new`` (anti join), append
    ``new`` with rank = list position (``ord``, baseline first) and a metric rank."""
    kept = existing.join(new.select("run_id").distinct(), on="run_id", how="left_anti")
    w = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("rmse"), "ord")
    fresh = new.withColumn("rank", (F.col("ord") + 1).cast("int")) \
        .withColumn("metric_rank", F.row_number().over(w).cast("int"))
    return kept.unionByName(fresh, allowMissingColumns=True)


# ---------------------------------------------------------------------------- G13
def sliding_counts(requests: DataFrame, keys: list[str], ts: str, window_seconds: int = RATE_WINDOW_SECONDS,
                   bucket_seconds: int = 3600) -> DataFrame:
    """G13 (all-calls variant): per request, calls of the same key in [ts - window, ts].

    Exact and skew-safe: rows are split into (key, hour) buckets; each bucket also
    receives, as halo, the previous bucket's rows that fall within ``window_seconds`` of
    its start, so a busy key spreads over its hours instead of one task.
    """
    us = epoch_us(F.col(ts))
    b_us = max(bucket_seconds, window_seconds) * 1_000_000  # a halo of one bucket must cover the window
    w_us = window_seconds * 1_000_000
    base = requests.withColumn("__us", us).withColumn("__b", F.floor(F.col("__us") / b_us))
    own = base.withColumn("__halo", F.lit(False))
    halo = base.where(F.col("__us") >= (F.col("__b") + 1) * b_us - w_us) \
        .withColumn("__b", F.col("__b") + 1).withColumn("__halo", F.lit(True))
    w = Window.partitionBy(*keys, "__b").orderBy("__us").rangeBetween(-w_us, 0)
    both = own.unionByName(halo).withColumn("calls_in_window", F.count(F.lit(1)).over(w))
    return both.where(~F.col("__halo")).drop("__us", "__b", "__halo")


def _bursts(requests: DataFrame, keys: list[str], ts: str, order: str, window_seconds: int,
            bucket_seconds: int = 3600) -> DataFrame:
    """Number each key's bursts (runs without a pause longer than the window) without a
    per-key sort: rows are windowed per (key, hour); the previous row across an hour
    edge comes from a per-(key, hour) edge table, and burst numbers are offset by the
    starts counted in earlier hours (a window over the small keys x hours table)."""
    win = window_seconds * 1_000_000
    b_us = max(bucket_seconds, window_seconds) * 1_000_000
    base = requests.withColumn("__us", epoch_us(F.col(ts))).withColumn("__b", F.floor(F.col("__us") / b_us))
    edges = base.groupBy(*keys, "__b").agg(F.max("__us").alias("__bmax"))
    edges = edges.select(*keys, "__b", F.lag("__bmax").over(Window.partitionBy(*keys).orderBy("__b")).alias("__edge"))
    w_kb = Window.partitionBy(*keys, "__b").orderBy("__us", F.col(order))
    staged = base.join(edges, on=[*keys, "__b"]).withColumn(
        "__prev", F.coalesce(F.lag("__us").over(w_kb), F.col("__edge")))
    staged = staged.withColumn(
        "__start", (F.col("__prev").isNull() | ((F.col("__us") - F.col("__prev")) > win)).cast("int"))
    per_bucket = staged.groupBy(*keys, "__b").agg(F.sum("__start").alias("__s"))
    offsets = per_bucket.select(*keys, "__b", F.coalesce(F.sum("__s").over(
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    staged = staged.join(offsets, on=[*keys, "__b"]).withColumn(
        "__burst", F.col("__off") + F.sum("__start").over(w_kb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return staged.drop("__edge", "__prev", "__start", "__off")


class _Admission:
    """The rule as it runs: the admitted stamps of the last window, at most ``limit`` of them."""

    def __init__(self, limit: int, window_us: int, held=()):
        self.limit, self.window = limit, window_us
        self.held, self.head = list(held), 0

    def admits(self, stamps: list[int]) -> list[int]:
        """Places of the admitted ones of sorted stamps; while the window is full, the rest up to its end is skipped."""
        i, found = 0, []
        while i < len(stamps):
            t = stamps[i]
            while self.head < len(self.held) and self.held[self.head] < t - self.window:
                self.head += 1
            if self.head > 4 * self.limit:    # only the live window is kept: memory stays O(limit)
                self.held, self.head = self.held[self.head:], 0
            if len(self.held) - self.head < self.limit:
                self.held.append(t)
                found.append(i)
                i += 1
            elif self.head < len(self.held):
                i = bisect.bisect_right(stamps, self.held[self.head] + self.window, i)
            else:                             # a limit of 0
                break
        return found


def _starts(batch: pa.RecordBatch, block: list[str], every: int | None = None) -> np.ndarray:
    """Places where a row's block differs from the one before, and every so many rows."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for c in block:
        column = batch.column(c)
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True))
    if every:
        new[::every] = True
    return np.flatnonzero(new)


def _pack(block: list[str]):
    """Sorted rows of blocks → pieces of at most ``PIECE`` stamps: the first, the last and all of them."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, block, PIECE)
            ends = np.append(starts[1:], batch.num_rows)
            us = batch.column("__us")
            stamps = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), us)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(block).take(pa.array(starts)).columns, us.take(pa.array(starts)), us.take(pa.array(ends - 1)), stamps],
                [*block, "__us", "__end", "__stamps"])
    return run


def _replay(limit: int, window_us: int, block: list[str], flags: bool):
    """Sorted blocks, each led by a row without a stamp that carries the state it starts from (none:
    empty) → their rows with ``admitted``, or from their pieces each block's first stamp and last state."""
    def run(batches):
        current, state, first, done = None, None, None, []

        def ended(schema):
            out = pa.RecordBatch.from_arrays(
                [*[pa.array([key[j] for key, _, _ in done], schema.field(c).type) for j, c in enumerate(block)],
                 pa.array([f for _, f, _ in done], pa.int64()), pa.array([e for _, _, e in done], pa.list_(pa.int64()))],
                [*block, "__first", "__exit"])
            done.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            lead = np.asarray(batch.column("__us").is_null())
            if flags:      # a row a stamp, a block a stretch of rows
                starts = _starts(batch, block)
                stamps = np.asarray(pc.fill_null(batch.column("__us"), 0))
                offsets = np.append(starts, batch.num_rows)
            else:          # a piece a row
                starts = np.arange(batch.num_rows)
                column = batch.column("__stamps")
                stamps, offsets = np.asarray(column.values), np.asarray(column.offsets)
            places, stamps, leads = [], stamps.tolist(), lead[starts].tolist()
            keys = zip(*[batch.column(c).take(pa.array(starts)).to_pylist() for c in block])
            for i, key, led, a, b in zip(starts.tolist(), keys, leads, offsets[:-1].tolist(), offsets[1:].tolist()):
                if key != current:
                    if first is not None and not flags:
                        done.append((current, first, state.held[state.head:]))
                    current, state, first = key, _Admission(limit, window_us), None
                if led:
                    state = _Admission(limit, window_us, batch.column("__enter")[i].as_py() or ())
                    a += int(flags)
                if a < b:
                    first = stamps[a] if first is None else first
                    places += [a + p for p in state.admits(stamps[a:b])]
            if flags:
                admitted = np.zeros(batch.num_rows, dtype=bool)
                admitted[np.array(places, dtype=int)] = True
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted)], [*batch.schema.names, "admitted"]).filter(pa.array(~lead))
            elif done:
                yield ended(batch.schema)
            schema = batch.schema
        if first is not None and not flags:
            done.append((current, first, state.held[state.head:]))
            yield ended(schema)
    return run


def admitted_requests(requests: DataFrame, keys: list[str], ts: str, order: str, limit: int = RATE_LIMIT,
                      window_seconds: int = RATE_WINDOW_SECONDS, bucket_seconds: int = 3600) -> DataFrame:
    """G13 (reference semantics): a request is admitted when fewer than ``limit``
    *admitted* requests of its key fall in [ts - window, ts]; rejected calls do not count.

    The rule is sequential per key, but its state empties after any pause longer than the
    window.  Requests are cut into bursts at such pauses (numbered per key without a per-key
    sort, see ``_bursts``), and bursts into blocks of ``bucket_seconds``.  Blocks are replayed
    side by side from a guessed state (at first: empty) and hand on the state they end in.
    While a burst's blocks started from another state than the block before has handed on,
    it is replayed from those states in blocks twice as long.  So a client that never pauses is
    spread over many tasks, a burst in which the limit isn't always hit settles in two rounds,
    and none takes more rounds than the logarithm of its blocks.  A task keeps at most ``limit``
    stamps.  Rows with a null key or stamp are left out.
    """
    win = window_seconds * 1_000_000
    group = [*keys, "__burst"]
    ship_package(requests.sparkSession)
    checkpoint_dir(requests.sparkSession)
    staged = _bursts(requests, keys, ts, order, window_seconds, bucket_seconds).checkpoint()
    kinds = {f.name: f.dataType.simpleString() for f in staged.schema.fields}
    spans = staged.groupBy(*group).agg(F.min("__b").alias("__low"), F.max("__b").alias("__high"))
    block = [*group, "__w"]
    block_ddl = ", ".join([f"`{c}` {kinds[c]}" for c in group] + ["`__w` bigint"])
    columns = [c for c in staged.columns if c not in group]

    def led(rows: DataFrame, states: DataFrame, columns: list[str], then: str) -> DataFrame:
        """Rows of blocks in order, each block led by the state that it starts from."""
        kinds = dict(rows.dtypes)
        leads = states.select(*block, *[F.lit(None).cast(kinds[c]).alias(c) for c in columns], "__enter")
        own = rows.select(*block, *columns, F.lit(None).cast("array<bigint>").alias("__enter"))
        return own.unionByName(leads).repartition(*[F.col(c) for c in block]).sortWithinPartitions(*block, F.asc_nulls_first("__us"), then)

    empty = F.array().cast("array<bigint>")
    pending = spans.where("__high > __low").withColumn("__width", F.lit(1).cast("bigint")).checkpoint()
    # all rounds read the stamps alone, sorted and packed once
    piece = [*group, "__b"]
    packed = staged.join(pending, group, "left_semi").select(*piece, "__us").repartition(*piece).sortWithinPartitions(*piece, "__us") \
        .mapInArrow(_pack(piece), ", ".join(f"`{c}` {kinds[c]}" for c in piece) + ", __us bigint, __end bigint, __stamps array<bigint>").checkpoint()
    states = None
    settled, final = [spans.where("__high = __low").select(*group, "__low", F.lit(1).cast("bigint").alias("__width"))], []
    while not pending.isEmpty():
        rows = packed.join(pending, group).withColumn("__w", F.floor((F.col("__b") - F.col("__low")) / F.col("__width")))
        if states is None:
            states = rows.select(*block).distinct().withColumn("__enter", empty)
        stamps = led(rows, states, ["__us", "__end", "__stamps"], "__end")
        exits = stamps.mapInArrow(_replay(limit, win, block, False), f"{block_ddl}, __first bigint, __exit array<bigint>")
        before = F.lag("__exit").over(Window.partitionBy(*group).orderBy("__w"))
        true = F.coalesce(F.filter(before, lambda x: x >= F.col("__first") - win), empty)
        seen = states.join(exits.withColumn("__true", true), block).select(*block, "__enter", "__true").checkpoint()
        wrong = seen.where(F.col("__enter") != F.col("__true")).select(*group).distinct()
        settled.append(pending.join(wrong, group, "left_anti").select(*group, "__low", "__width"))
        final.append(seen.join(wrong, group, "left_anti").select(*block, "__enter"))
        pending = pending.join(wrong, group, "left_semi").withColumn("__width", F.col("__width") * 2).checkpoint()
        states = (seen.where("__w % 2 = 0").join(wrong, group, "left_semi")
                  .select(*group, F.expr("__w div 2").alias("__w"), F.col("__true").alias("__enter")))
    widths = reduce(DataFrame.unionByName, settled)
    rows = staged.join(widths, group).withColumn("__w", F.floor((F.col("__b") - F.col("__low")) / F.col("__width")))
    none = rows.limit(0).select(*block).withColumn("__enter", empty)
    out_schema = block_ddl + ", " + ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", __enter array<bigint>, admitted boolean"
    out = led(rows, reduce(DataFrame.unionByName, final, none), columns, order).mapInArrow(_replay(limit, win, block, True), out_schema)
    return out.select(*requests.columns, "admitted")


# ---------------------------------------------------------------------------- G15, G17
def dedupe_links(links: DataFrame) -> DataFrame:
    """One row per url, the last one (by ``ord``) wins."""
    cols = [c for c in links.columns if c not in ("url",)]
    return links.groupBy("url").agg(F.max_by(F.struct(*cols), F.col("ord")).alias("__r")).select("url", "__r.*")


def listing(df: DataFrame, partition_col: str, order_col: str) -> DataFrame:
    """The index-backed listings become a sort within a partition column."""
    return df.repartition(partition_col).sortWithinPartitions(partition_col, F.desc(order_col))


# ---------------------------------------------------------------------------- G2, G9, G14
def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append log rows (dataset profiles, audit entries) to a Parquet table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def run_manifest(run_id: str, run_type: str, file_hashes: DataFrame, batch_hash: DataFrame,
                 parameters: dict, results: DataFrame | None = None, started_epoch: float | None = None) -> DataFrame:
    """One-row manifest — input files (name, size, sha256), combined input hash,
    parameters, model results and duration, with the whole record as JSON text."""
    import json
    import time

    files = file_hashes.agg(F.array_sort(F.collect_list(F.struct(
        F.col("file_name"), F.col("length").alias("size_bytes"), F.col("sha256")))).alias("input_files"))
    models = (results.agg(F.collect_list(F.struct(*results.columns)).alias("models")) if results is not None
              else file_hashes.sparkSession.createDataFrame([([],)], "models array<string>"))
    now = time.time()
    row = with_row(with_row(files, batch_hash), models)
    row = row.select(
        F.lit(run_id).alias("run_id"), F.lit(run_type).alias("run_type"), "input_files",
        F.col("batch_sha256").alias("combined_input_hash"),
        F.lit(json.dumps(parameters, sort_keys=True, separators=(",", ":"))).alias("parameters_json"), "models",
        F.lit(round(started_epoch, 6) if started_epoch else None).cast("double").alias("created_at_epoch"),
        F.lit(round(now, 6)).alias("finished_at_epoch"),
        F.lit(round(now - started_epoch, 4) if started_epoch else None).cast("double").alias("duration_seconds"))
    return row.withColumn("manifest_json", F.to_json(F.struct(*[c for c in row.columns])))
