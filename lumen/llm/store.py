"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lumen.session import checkpoint_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the folder named by ``spark.checkpoint.dir`` and read it back.

    The written table cuts the lineage: a later stage that loses an executor rereads the
    shared files.  Every call takes a new folder, so reruns never meet.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lumen-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """``materialize`` with the rows bucketed by ``key``, in as many buckets as a shuffle has
    partitions, and the folder of the table: a later grouping by the key reads the buckets and doesn't move the rows.  Every
    task adds its own files to the buckets, so the write doesn't move them either."""
    spark = df.sparkSession
    table = f"lumen_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table))
    return spark.table(table), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more, wherever the shared folder is."""
    spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[-1]}`")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a written table's shuffle files go as soon as it is written (what is written is
    read from the shared folder, so nobody asks for them again)."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
