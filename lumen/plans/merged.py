"""Merged runs over several files (U9, U10): load each file alone, skip the unreadable
ones with a note, and union the rest by column name when at least two remain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumen.operators.combine import union_by_name
from lumen.sources.files import load_many


def load_and_union(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Returns (union with source_file / source_row_number, per-file status, notes)."""
    ok, status = load_many(spark, paths)
    notes = [f"{r['file_name']} skipped: {r['error']}" for r in status.collect() if not r["success"]]
    if len(ok) < 2:
        raise ValueError("a merged run needs at least two readable files")
    return union_by_name([(name, df) for name, df, _ in ok]), status, notes
