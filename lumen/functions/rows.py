"""One-row results beside other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of ``row`` (one row: a total, a maximum) beside every row.

    The row is a scalar subquery: it is computed once and put into the plan as a value, so
    nothing is joined.
    """
    value = row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("row")).scalar()
    return df.withColumn("__row", value).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("__row").getField(c).alias(c) for c in row.columns])
