"""Ordered scans that Spark has no window built-in for.

Exponential moving average (``adjust=False``: y0 = x0, y_i = q*y_{i-1} + a*x_i with
a = 2/(span+1), q = 1-a) is computed as a *blocked* closed form so that it never needs
a running product that over- or under-flows and never needs a row-by-row loop:

1. rows of a series carry a dense 0-based index ``idx`` (caller provides it);
2. ``blk = idx div B`` and ``k = idx mod B``;
3. inside a block: ``local = q^k * sum_{j<=i in blk} c_j x_j q^{-k_j}`` where
   ``c_j = 1`` on the very first row of the series and ``a`` elsewhere.  With
   ``B = 256`` and span >= 3 (q >= 0.5) ``q^-k`` stays far below the double range;
4. per block the value at its last row (``end``) and the index of that row (``last``);
   the carried-in value of block b is ``carry_b = sum_{c<=b} end_c q^(last_b-last_c)``.
   Terms older than ``M`` blocks weigh less than q^(M*B) < 1e-30 relative and fall
   below double resolution, so the sum runs over a fixed frame of M+1 blocks —
   a plain window over the (tiny) block table, JVM side;
5. ``ema = local + carry_{b-1} * q^(k+1)``.

Work is partitioned by (series keys, block); the only table joined back is the
block table (one row per 256 input rows), sized at run time by AQE.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def _lookback_blocks(q: float, block: int = BLOCK) -> int:
    # smallest M with q^(M*block) < 1e-30
    if q <= 0.0:
        return 1
    return max(1, math.ceil(math.log(1e-30) / (block * math.log(q))))


def ema(df: DataFrame, specs: list[tuple[str, str, int | Column, list[int] | None]], keys: list[str],
        idx_col: str = "idx") -> DataFrame:
    """Add EMA columns; ``specs`` = [(value_col, out_col, span, span_choices)].

    ``span`` is an int, or a Column whose value is one of ``span_choices`` (series of
    different length get different spans).  All (column, span) pairs are computed in
    one blocked pass: one window over (keys, block), one block table, one join.
    """
    fixed: list[tuple[str, str, int]] = []
    chooser: list[tuple[str, Column, list[tuple[int, str]]]] = []
    for value_col, out_col, span, choices in specs:
        if isinstance(span, int):
            fixed.append((value_col, out_col, span))
            continue
        opts = sorted(set(choices or []))
        if len(opts) == 1:
            fixed.append((value_col, out_col, opts[0]))
            continue
        tmps = []
        for s_ in opts:
            tmp = f"__ema_{out_col}_{s_}"
            fixed.append((value_col, tmp, s_))
            tmps.append((s_, tmp))
        chooser.append((out_col, span, tmps))
    out = _ema_pass(df, fixed, keys, idx_col)
    for out_col, span, tmps in chooser:
        expr = None
        for s_, tmp in tmps:
            expr = F.when(span == s_, F.col(tmp)) if expr is None else expr.when(span == s_, F.col(tmp))
        out = out.withColumn(out_col, expr).drop(*[t for _, t in tmps])
    return out


def _carry_step(i: int, q: float):
    def step(acc: Column, e: Column) -> Column:
        return acc + e[f"__end{i}"] * F.pow(F.lit(q), F.col("__last") - e["__last"])
    return step


def _ema_pass(df: DataFrame, fixed: list[tuple[str, str, int]], keys: list[str], idx_col: str) -> DataFrame:
    k = F.col(idx_col) % BLOCK
    w_blk = (Window.partitionBy(*keys, "__blk").orderBy(idx_col)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    staged = df.withColumn("__blk", F.floor(F.col(idx_col) / BLOCK)).withColumn("__k", k)
    local_cols, end_aggs, carry_cols = [], [], []
    lookback = 1
    for i, (value_col, out_col, span) in enumerate(fixed):
        alpha = 2.0 / (span + 1.0)
        q = 1.0 - alpha
        lookback = max(lookback, _lookback_blocks(q))
        c = F.when(F.col(idx_col) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        local_cols.append((F.pow(F.lit(q), F.col("__k"))
                           * F.sum(c * F.col(value_col) * F.pow(F.lit(q), -F.col("__k"))).over(w_blk))
                          .alias(f"__local{i}"))
        end_aggs.append(F.max_by(f"__local{i}", idx_col).alias(f"__end{i}"))
    staged = staged.select("*", *local_cols)
    blocks = staged.groupBy(*keys, "__blk").agg(F.max(idx_col).alias("__last"), *end_aggs)
    w_b = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(-lookback, Window.currentRow)
    hist = blocks.withColumn(
        "__hist", F.collect_list(F.struct("__last", *[f"__end{i}" for i in range(len(fixed))])).over(w_b))
    for i, (_, _, span) in enumerate(fixed):
        q = 1.0 - 2.0 / (span + 1.0)
        carry_cols.append(F.aggregate("__hist", F.lit(0.0), _carry_step(i, q)).alias(f"__carry{i}"))
    carries = hist.select(*keys, (F.col("__blk") + 1).alias("__blk"), *carry_cols)
    out = staged.join(carries, on=[*keys, "__blk"], how="left")
    finals = []
    for i, (_, out_col, span) in enumerate(fixed):
        q = 1.0 - 2.0 / (span + 1.0)
        finals.append((F.col(f"__local{i}") + F.coalesce(F.col(f"__carry{i}"), F.lit(0.0))
                       * F.pow(F.lit(q), F.col("__k") + 1)).alias(out_col))
    drop = ["__blk", "__k"] + [f"__local{i}" for i in range(len(fixed))] + [f"__carry{i}" for i in range(len(fixed))]
    return out.select("*", *finals).drop(*drop)
