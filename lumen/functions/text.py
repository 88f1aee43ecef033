"""Scalar text helpers (survey id T10) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """trim + lower, '-' and ' ' → '_'."""
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def safe_stem(c: Column) -> Column:
    """File stem cleanup: runs of characters outside [A-Za-z0-9_-] → '_', stripped of '_'."""
    stem = F.regexp_replace(c, r"\.[^./]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")


def format_number(c: Column, digits: int = 4) -> Column:
    """Number as text with thousands separators and up to ``digits`` decimals; '-' for null."""
    s = F.regexp_replace(F.regexp_replace(F.format_number(c, digits), r"0+$", ""), r"\.$", "")
    return F.coalesce(s, F.lit("-"))


def format_percent(c: Column, digits: int = 2) -> Column:
    """Ratio as a percent text, e.g. 0.1234 → '12.34%'; '-' for null."""
    return F.coalesce(F.concat(format_number(c * 100, digits), F.lit("%")), F.lit("-"))
