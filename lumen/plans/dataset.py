"""Dataset analysis plan: profile + quality report + findings for one table.

The value histogram (the only shuffle that sees raw rows besides the duplicate count)
is computed once and written to the checkpoint folder; profile, quantiles, outliers,
flags and targets all read it, so the raw table is scanned three times in total
(aggregate pass, histogram pass, duplicate pass) whatever is asked afterwards.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.operators import profile as P
from lumen.operators import quality as Q
from lumen.operators.quality import _one_row_join
from lumen.session import checkpoint_dir

TABLES_AT_ONCE = 4   # each has its own histogram in the shared folder; tasks are shared out by Spark


@dataclass
class DatasetAnalysis:
    name: str
    profile: DataFrame
    flags: DataFrame
    outliers: DataFrame
    summary: DataFrame
    issues: DataFrame
    targets: DataFrame
    numeric_count: int
    names_text: str
    source: DataFrame = field(repr=False, default=None)

    @cached_property
    def date_frequency(self) -> DataFrame:
        """P12, computed on first use (it reads the date columns once)."""
        return P.date_frequency(self.source)


def analyze_dataset(df: DataFrame, name: str = "dataset", materialize: bool = True) -> DatasetAnalysis:
    """Profile + quality report, over the whole table."""
    hist = P.value_histogram(df, materialize=materialize)
    prof = P.column_profile(df, hist)
    outl = P.iqr_outliers(df, hist, prof)
    flags = Q.column_flags(prof, outl)
    summ = Q.quality_summary(flags, P.duplicate_rows(df), prof)
    numeric = [f.name for f in df.schema.fields if P.is_numeric_type(f.dataType)]
    return DatasetAnalysis(
        name=name, profile=prof, flags=flags, outliers=outl, summary=summ, issues=Q.quality_issues(summ),
        targets=Q.recommend_targets(prof), numeric_count=len(numeric),
        names_text=" ".join(c.lower() for c in df.columns), source=df)


def brief_row(a: DatasetAnalysis) -> DataFrame:
    """One row per dataset with everything the N1-N4 rules read."""
    has_date = a.date_frequency.agg((F.count(F.lit(1)) > 0).alias("has_date"))
    targets = a.targets.agg(F.count(F.lit(1)).cast("int").alias("target_count"))
    score = a.summary.select("quality_score")
    issues = a.issues.agg(F.count(F.lit(1)).cast("int").alias("issue_rows"),
                          F.min_by("code", "ord").alias("first_issue_code"))
    missing = a.profile.agg(F.min_by(F.when(F.col("missing") > 0, F.col("column")),
                                     F.when(F.col("missing") > 0, F.col("position"))).alias("first_missing_column"))
    row = _one_row_join([has_date, targets, score, issues, missing])
    return row.select(F.lit(a.name).alias("dataset"), F.lit(a.names_text).alias("names_text"),
                      F.lit(a.numeric_count).alias("numeric_count"), "has_date", "target_count", "quality_score",
                      "issue_rows", "first_missing_column", "first_issue_code")


def brief_rows(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """:func:`brief_row` of each table, in their order.  An analysis is a long chain of jobs of
    which most leave cores idle, so those of ``TABLES_AT_ONCE`` tables run side by side."""
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    checkpoint_dir(spark)

    def row(table: tuple[str, DataFrame]) -> DataFrame:
        return brief_row(analyze_dataset(table[1], table[0]))

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        # a target per table: job groups and local properties of this thread hold for its jobs
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(row), t) for t in tables.items()]]
