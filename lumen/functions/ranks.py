"""Values at given ranks of many groups together, by narrowing histograms.

Every value has a monotone 54-bit key (sign and logarithm), whose leading digits cut a
group into bins.  A round counts the rows of each bin, finds the bin that holds each
wanted rank and goes on within these bins with the next digits, until none holds many
rows.  Then the rows of the chosen bins alone are counted by value and ranked.

No group is held or sorted whole, and no row carries bounds: a round shuffles at most
``2^14`` counts per group and task, a final window holds ``MOST`` rows at most, or the
doubles of one key (some 4,000).  A hot value is a count like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.session import checkpoint_dir

# A final window ranks about this many rows of a group.
MOST = 200_000
# Bits of the key that are still undecided after each round.
LEFT = (40, 26, 13, 0)
_SCALE = float(1 << 42)
_OFFSET = 1 << 53


def monotone_key(value: Column) -> Column:
    """A value's place in 0 .. 2^54, never smaller for a greater value; infinity and NaN share the last."""
    x = value.cast("double")
    size = F.floor(F.least(F.ln(F.abs(x)) + 745, F.lit(1456.0)) * _SCALE)
    return (F.when(x == 0, F.lit(0)).when(x < 0, -size).otherwise(size) + _OFFSET).cast("bigint")


def beside(rows: DataFrame, table: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` on columns that may hold nulls; the columns of both, once."""
    rows, table = rows.alias("rows"), table.alias("table")
    joined = rows.join(table, reduce(lambda a, b: a & b, (
        F.col(f"rows.`{c}`").eqNullSafe(F.col(f"table.`{c}`")) for c in names)), how)
    if how == "left_semi":
        return joined
    more = [F.col(f"table.`{c}`") for c in table.columns if c not in names]
    return joined.select(*[F.col(f"rows.`{c}`") for c in rows.columns], *more)


def exact_quantiles(rows: DataFrame, keys: list[str], value_col: str, count_col: str,
                    probs: list[float], most: int = MOST) -> DataFrame:
    """Linear-interpolated quantiles per group: ``(keys..., prob, value)``.

    ``rows`` are ``(keys..., value, count)``; a value may stand in several rows.  Null values
    are ignored, a group without others has no result; null keys are a group.  The values at
    the ranks floor((n-1)p) and the next one are interpolated — the rule of pandas
    ``quantile``, Spark's ``percentile`` and DuckDB's ``quantile_cont``.  ``rows`` is read
    once per round and once more at the end, so a costly one should be written first.
    """
    if not keys:
        raise ValueError("keys must name at least one grouping column (add a constant one)")
    checkpoint_dir(rows.sparkSession)
    value, count = F.col(f"`{value_col}`"), F.col(f"`{count_col}`")
    of_keys = [F.col(f"`{k}`") for k in keys]
    rows = rows.where(value.isNotNull()).select(
        *of_keys, value.alias("__v"), count.cast("bigint").alias("__c"), monotone_key(value).alias("__key"))
    wanted, decided = None, 0
    for bits in LEFT:
        bin_of = F.shiftright("__key", bits).alias("__bin")
        if wanted is None:
            group = keys
            bins = rows.groupBy(*of_keys, bin_of)
        else:
            group = [*keys, "__prefix"]
            bins = _chosen(rows, wanted, keys, decided).groupBy(*of_keys, "__prefix", bin_of)
        wanted = _narrowed(bins.agg(F.sum("__c").alias("__c")), wanted, group, keys, probs).checkpoint()
        decided = bits
        if (wanted.agg(F.max("__inside")).first()[0] or 0) <= most:
            break
    return _picked(rows, wanted, keys, decided)


def _chosen(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The rows in bins that hold a wanted rank, with ``__prefix``, the number of their bin."""
    bins = wanted.select(*[F.col(f"`{k}`") for k in keys], "__prefix").distinct()
    return beside(rows.withColumn("__prefix", F.shiftright("__key", bits)), bins, [*keys, "__prefix"], "left_semi")


def _narrowed(bins: DataFrame, wanted: DataFrame | None, group: list[str], keys: list[str],
              probs: list[float]) -> DataFrame:
    """(keys..., prob, fraction, upper, rank within the bin, bin, its rows) of every wanted rank."""
    whole = Window.partitionBy(*[F.col(f"`{k}`") for k in group])
    before = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__n", F.sum("__c").over(whole)).withColumn(
        "__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    if wanted is None:
        at = [(F.lit(float(p)), (F.col("__n") - 1) * F.lit(float(p))) for p in probs]
        ranks = F.array(*[
            F.struct(p.alias("prob"), (h - F.floor(h)).alias("__part"), F.lit(upper).alias("__upper"),
                     F.least(F.floor(h) + int(upper), F.col("__n") - 1).alias("__rank"))
            for p, h in at for upper in (False, True)])
        here = F.filter(ranks, lambda r: (r["__rank"] >= F.col("__before")) & (r["__rank"] < F.col("__before") + F.col("__c")))
        found = bins.withColumn("__w", F.explode(here)).select(*bins.columns, "__w.*")
    else:
        found = beside(wanted.drop("__inside"), bins, group).where(
            (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__c")))
    return found.select(
        *[F.col(f"`{k}`") for k in keys], "prob", "__part", "__upper", (F.col("__rank") - F.col("__before")).alias("__rank"),
        F.col("__bin").alias("__prefix"), F.col("__c").alias("__inside"))


def _picked(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The wanted values, ranked within their bins, and interpolated."""
    of_keys = [F.col(f"`{k}`") for k in keys]
    values = _chosen(rows, wanted, keys, bits).groupBy(*of_keys, "__prefix", "__v").agg(F.sum("__c").alias("__c"))
    before = Window.partitionBy(*of_keys, "__prefix").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    found = beside(wanted, values, [*keys, "__prefix"]).where(
        (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__c")))
    ends = found.groupBy(*of_keys, "prob").agg(
        F.max(F.when(~F.col("__upper"), F.col("__v"))).alias("__lo"), F.max(F.when(F.col("__upper"), F.col("__v"))).alias("__hi"),
        F.max("__part").alias("__part"))
    between = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")
    exact = (F.col("__part") == 0) | (F.col("__lo") == F.col("__hi"))   # infinities too
    return ends.select(*of_keys, "prob", F.when(exact, F.col("__lo")).otherwise(between).alias("value"))
