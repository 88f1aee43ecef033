"""Structured Streaming forms of the rules that have a natural stream (survey W1-W4).

* W1 — rate limit over a request stream: ``transformWithStateInPandas`` keeps, per
  (client, route), only the admitted timestamps of the last window (at most ``limit``
  of them), and sorts a client's rows outside memory (see ``admission``).
* W2 — daily series: event-time ``window`` + watermark, append mode; indicators are
  computed by the batch operators over the closed days (``foreachBatch``).
* W3 — windowed counters: count, missing count, approximate distinct users, watermarked.
* W4 — latest job state per key: ``max_by`` over event order, update mode.

``run_to_table`` drives a stream to completion with ``trigger(availableNow=True)`` into
Parquet folders, one per micro-batch, under the shared checkpoint location.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.session import checkpoint_dir, ensure_utc, ship_package
from lumen.streaming.admission import Admissions

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream over ``<sf_dir>/<name>.parquet`` (schema taken from the table)."""
    ensure_utc(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(sf_dir)


def run_to_table(stream: DataFrame, output_mode: str = "append", name: str = "stream",
                 location: str | None = None, key: list[str] | None = None, state_store: str | None = None) -> DataFrame:
    """Run ``stream`` until the available input is consumed; return the sink as a table.

    Each micro-batch overwrites its own folder, so a batch that is run again after a
    failure leaves the rows it would have left before.  A stream started again with the
    same ``location`` goes on from its checkpoint; without one a new folder is taken.
    append: all batches together; complete: the last batch; update: the last batch's rows
    of each ``key``.  ``state_store``: class of the state store for this stream (default: the
    session's; ``ROCKS_DB`` for streams with state processors, which need it).
    """
    spark = stream.sparkSession
    base = location or f"{checkpoint_dir(spark).rstrip('/')}/lumen-stream/{name}-{uuid.uuid4().hex[:12]}"
    out, ckpt = f"{base}/out", f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/__batch={batch_id}")

    before = spark.conf.get(STATE_STORE)
    processors = "TransformWithState" in stream._jdf.queryExecution().analyzed().toString()
    spark.conf.set(STATE_STORE, state_store or (ROCKS_DB if processors else before))
    try:
        q = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())]))
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", out).parquet(out)
    if output_mode == "complete":
        return rows.where(F.col("__batch") == rows.agg(F.max("__batch")).first()[0])
    if output_mode == "update":
        rest = [F.col(c) for c in rows.columns if c not in (key or [])]
        return rows.groupBy(*(key or [])).agg(F.max_by(F.struct(*rest), "__batch").alias("__row")).select(*(key or []), "__row.*")
    return rows


def _with_ts(stream: DataFrame, ts: str) -> DataFrame:
    """Event time as TIMESTAMP (watermarks refuse TIMESTAMP_NTZ; session zone is UTC)."""
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        return stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream


# ---------------------------------------------------------------------------- W2
def daily_series_stream(stream: DataFrame, ts: str, value: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Mean value per (day, keys); a day is emitted once the watermark passes its end."""
    return (_with_ts(stream, ts).withWatermark(ts, delay)
            .groupBy(F.window(F.col(ts), "1 day").alias("w"), *keys)
            .agg(F.avg(value).alias("price"), F.count(F.lit(1)).alias("n_obs"))
            .select(*keys, F.to_date(F.col("w.start")).alias("date"), "price", "n_obs"))


# ---------------------------------------------------------------------------- W3
def window_counters(stream: DataFrame, ts: str, value: str, user: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows, missing values and approximate distinct users per event-time window; a window's
    state goes once the watermark has passed it (output mode update or append)."""
    return (_with_ts(stream, ts).withWatermark(ts, delay).groupBy(F.window(F.col(ts), width).alias("w"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"),
                 F.approx_count_distinct(user).alias("approx_users"))
            .select(F.col("w.start").alias("window_start"), "rows", "missing", "approx_users"))


# ---------------------------------------------------------------------------- W4
def latest_state_stream(stream: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Latest values per key (use output mode update: only keys with news are written)."""
    order = F.struct(*[F.col(c) for c in order_cols])
    return stream.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in value_cols]), order).alias("v"),
                                   F.count(F.lit(1)).alias("events")).select(key, "v.*", "events")


# ---------------------------------------------------------------------------- W1
def rate_limit_stream(stream: DataFrame, keys: list[str], ts: str, order: str, limit: int = 180,
                      window_seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """Admitted flag per request; state per key = admitted epoch-µs in the window.

    Rows of a key inside one micro-batch are handled in (ts, order) order, sorted through the
    state store, so a busy key needs no more memory than others.  A row older than the key's
    last handled timestamp minus the window is late: not admitted.  A key's state goes by a
    timer when the watermark is past its last timestamp and the window.  Rows with a null
    key, timestamp or ``order`` are left out, as in the batch form.  Needs the state store of ``ROCKS_DB``,
    which ``run_to_table`` takes by itself.
    """
    ship_package(stream.sparkSession)
    out_schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField(order, T.LongType()),
                               T.StructField("admitted", T.BooleanType()), T.StructField("late", T.BooleanType())])
    staged = _with_ts(stream, ts).withWatermark(ts, delay).withColumn("__us", F.unix_micros(F.col(ts)))
    staged = staged.withColumn(order, F.col(order).cast("bigint")).dropna(subset=[*keys, order, "__us"])
    return staged.select(*keys, ts, order, "__us").groupBy(*keys).transformWithStateInPandas(
        Admissions(keys, order, limit, window_seconds * 1_000_000), out_schema, "append", "eventTime")
