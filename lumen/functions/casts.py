"""Safe conversions and type families.

ANSI mode is on in Spark 4: plain ``cast`` and ``/`` throw on bad input, so every
conversion here goes through ``try_*`` built-ins, which stay inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: text tokens read as missing (pandas CSV defaults)
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# fixed values: timestamp layouts tried, in order, for text dates
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss",
                "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")
_SHAPES = {"yyyy": r"[+-]?\d{4,}", "MM": r"(0[1-9]|1[0-2])", "dd": r"(0[1-9]|[12]\d|3[01])", "HH": r"([01]\d|2[0-3])",
           "mm": r"[0-5]\d", "ss": r"[0-5]\d", "'T'": "[Tt]", ".": r"\."}

# numeric text: optional sign, digits with optional fraction, optional exponent
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric columns as ``select_dtypes(np.number)`` sees them (bool excluded)."""
    return isinstance(dt, T.NumericType)


def is_feature_numeric(dt: T.DataType) -> bool:
    """Numeric or boolean (model features)."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def logical_type(dt: T.DataType) -> str:
    """pandas-style dtype name for a Spark type."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    if isinstance(dt, T.ArrayType):
        return "array"
    return "object"


def type_family(dt: T.DataType) -> str:
    """Numeric / Date-time / Boolean / Text."""
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    if isinstance(dt, T.NumericType):
        return "Numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "Date-time"
    return "Text"


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def text_to_number(c: Column) -> Column:
    """T3 for text: numeric-looking text → double, anything else → null."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def to_number(df: DataFrame, name: str) -> Column:
    """``pd.to_numeric(errors='coerce')`` on a column of any type."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, T.NumericType):
        return null_if_nan(c.cast("double"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(c.cast("timestamp")) * 1000).cast("double")
    if isinstance(dt, T.DateType):
        return (F.unix_micros(c.cast("timestamp")) * 1000).cast("double")
    if isinstance(dt, T.StringType):
        return text_to_number(c)
    return F.lit(None).cast("double")


def text_to_timestamp(c: Column) -> Column:
    """T4 for text: first layout that parses wins; unparseable → null.

    A layout is tried on texts of its shape only: a parser that fails costs some 4 µs.
    """
    s = F.trim(c)
    tried = [F.when(s.rlike(_shape(fmt)), F.try_to_timestamp(s, F.lit(fmt))) for fmt in DATE_FORMATS]
    return F.when(s.rlike(r"^[+-]?\d"), F.coalesce(*tried))


def _shape(layout: str) -> str:
    return "^" + re.sub("|".join(map(re.escape, _SHAPES)), lambda m: _SHAPES[m[0]], layout) + "$"


def to_timestamp_any(df: DataFrame, name: str) -> Column:
    """T4: ``pd.to_datetime(errors='coerce')``; numbers are nanoseconds since epoch."""
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dt, T.StringType):
        return text_to_timestamp(c)
    if isinstance(dt, T.NumericType):
        return F.timestamp_micros(F.floor(c / 1000).cast("bigint"))
    return F.lit(None).cast("timestamp")


def safe_number(c: Column, digits: int = 6) -> Column:
    """Round to ``digits`` (half-even, as Python's ``round``); NaN → null."""
    return F.bround(null_if_nan(c.cast("double")), digits)


def lenient_number(c: Column) -> Column:
    """Bad or null → null."""
    return c.cast("string").try_cast("double")


def fround(c: Column | str, digits: int) -> Column:
    """Round half up on the binary value: ``floor(x * 10^d + 0.5) / 10^d``.

    Unlike ``round`` (which rounds the shortest decimal text of a double) this gives the
    same answer as any engine doing the same IEEE arithmetic, so result hashes compare.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def fround_sql(expr: str, digits: int) -> str:
    """SQL twin of :func:`fround`."""
    return f"(floor(({expr}) * {float(10 ** digits)!r} + 0.5) / {float(10 ** digits)!r})"
