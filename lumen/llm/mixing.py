"""Mixing sources to target weights, in DataFrame operations only.

Sizes (words per document) are summed per source, the sums give each source a target and
a repetition rate ``target / source_size``, and each document is emitted ``floor(rate)``
times plus once more if a hash of its id, read as a number in [0, 1), is below the
fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 9


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, size) → (source, source_size, target), one row per source.

    Sources in code-point order (null last) take the weights in turn and share the sum of
    all sizes by weight; a target stops at ``most`` times its source's size and the excess
    is shared again by weight until no target is above.  That fixed point is
    ``min(most * size, level * weight)``: with the sources ordered by the level at which
    they fill up, the level is the first at which the rest of the words, shared over the
    rest of the weights, fills no further source.  A source without words has target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = per.select("source", "source_size", weight.alias("weight")).withColumn(
        "full_at", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    # sources in the order in which they fill up; all before a source are full
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(float(most)) * F.col("source_size")).over(before), F.lit(0.0)))
             / F.sum("weight").over(onward))
    # the level holds from the first source that it doesn't fill
    at = ranked.withColumn("place", F.row_number().over(by_level)).withColumn("level", level)
    holds = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("place", "level"))).over(everything)["level"]
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(holds * F.col("weight"), F.lit(float(most)) * F.col("source_size")))
    return at.select("source", F.col("source_size").cast("long"), target.cast("double").alias("target"))


def _draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies) for every row of ``docs``.

    Null texts have size 0; a null source is a source of its own, last in order; rows that
    repeat an id make the same draw; a null id draws from the word ``null``.  A source
    with no words is copied 0 times.  An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"))
    return _planned(sized, weights, most, seed).select("doc_id", "size", "source_size", "target", "copies")


def _planned(sized: DataFrame, weights, most, seed) -> DataFrame:
    targets = source_targets(sized.select("source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(_draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    t = targets.withColumnRenamed("source", "of_source")
    return (sized.join(t, sized["source"].eqNullSafe(t["of_source"])).drop("of_source")
            .withColumn("copies", copies.cast("long")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix_plan` says, all columns
    kept and none added."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"))
    out = _planned(sized, weights, most, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
