"""Gaps between sorted values, without a group held whole.

A range bucket per value (approximate boundaries of a bounded sketch) cuts every group, so
a window holds one bucket; neighbours across bucket edges come from the previous bucket's
maximum.  The number of buckets follows the number of distinct values, so a task holds about
``BUCKET_VALUES`` of them whatever the input.  Quantiles: :mod:`lumen.functions.ranks`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A task ranks about this many distinct values at most.
BUCKET_VALUES = 500_000


def add_range_bucket(hist: DataFrame, keys: list[str], value_col: str, count_col: str,
                     buckets: int) -> DataFrame:
    """Add ``__bucket``: position of ``value_col`` among approximate range boundaries."""
    if not keys:
        raise ValueError("keys must name at least one grouping column (add a constant one)")
    if buckets <= 1:
        return hist.withColumn("__bucket", F.lit(0))
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = hist.groupBy(*keys).agg(
        F.percentile_approx(value_col, probs, 10 * buckets).alias("__bounds"))
    joined = hist.join(bounds, on=keys, how="left")
    return joined.withColumn(
        "__bucket", F.size(F.filter("__bounds", lambda b: b <= F.col(value_col)))).drop("__bounds")


def bucket_count(hist: DataFrame) -> int:
    """Range buckets per group such that none holds many more than ``BUCKET_VALUES`` values,
    even if one group has them all."""
    return buckets_for(hist.count())


def buckets_for(values: int) -> int:
    return max(1, math.ceil(values / BUCKET_VALUES))


def sorted_gaps(long: DataFrame, keys: list[str], value_col: str,
                buckets: int | None = None) -> DataFrame:
    """Differences between consecutive sorted values per key, as a weighted histogram.

    Output ``(keys..., gap, cnt)``: repeated values give gap 0 (count-1 times); each
    distinct value after the first gives its distance to the previous distinct value.
    Neighbours across bucket edges come from the previous bucket's maximum.
    """
    hist = long.where(F.col(value_col).isNotNull()).groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("__c"))
    return sorted_gaps_from_hist(hist, keys, value_col, "__c", buckets)


def sorted_gaps_from_hist(hist: DataFrame, keys: list[str], value_col: str, count_col: str,
                          buckets: int | None = None) -> DataFrame:
    """:func:`sorted_gaps` from a histogram ``(keys..., value, count)`` of non-null values."""
    if count_col != "__c":
        hist = hist.withColumnRenamed(count_col, "__c")
    b = add_range_bucket(hist, keys, value_col, "__c", buckets or bucket_count(hist))
    edges = b.groupBy(*keys, "__bucket").agg(F.max(value_col).alias("__bmax"))
    w_prev_bucket = Window.partitionBy(*keys).orderBy("__bucket")
    edges = edges.select(*keys, "__bucket", F.lag("__bmax").over(w_prev_bucket).alias("__prev_edge"))
    w = Window.partitionBy(*keys, "__bucket").orderBy(value_col)
    with_prev = b.join(edges, on=[*keys, "__bucket"]).withColumn(
        "__prev", F.coalesce(F.lag(value_col).over(w), F.col("__prev_edge")))
    dup = with_prev.where(F.col("__c") > 1).select(*keys, F.lit(0.0).alias("gap"), (F.col("__c") - 1).alias("cnt"))
    step = with_prev.where(F.col("__prev").isNotNull()).select(
        *keys, (F.col(value_col) - F.col("__prev")).cast("double").alias("gap"), F.lit(1).cast("bigint").alias("cnt"))
    return dup.unionByName(step).groupBy(*keys, "gap").agg(F.sum("cnt").alias("cnt"))
