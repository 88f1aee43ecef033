import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.functions.quantiles import sorted_gaps
from lumen.functions.ranks import MOST, exact_quantiles


@pytest.mark.parametrize("most", [MOST, 40, 1])
def test_exact_quantiles_in_any_number_of_rounds(spark, most):
    rng = np.random.default_rng(7)
    normal = rng.normal(size=5000)
    hot = np.concatenate([np.full(2500, 3.0), rng.exponential(size=2500)])  # one value holds half the rows
    wide = np.concatenate([[0.0, -0.0, 5e-324, -1e300, 1e300], 10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-9, 9, 500))])
    near = 1.7e15 + np.arange(4000)   # thousands of values share a key
    groups = {0: normal, 1: hot, 2: wide, None: near, 4: np.array([2.5])}
    rows = [(k, float(x)) for k, a in groups.items() for x in a] + [(0, None), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for counted in (df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")), df.withColumn("c", F.lit(1))):
        got = {(r["k"], r["prob"]): r["value"] for r in exact_quantiles(counted, ["k"], "v", "c", probs, most).collect()}
        assert len(got) == len(groups) * len(probs)
        for k, arr in groups.items():
            for p in probs:
                assert got[(k, p)] == pytest.approx(float(np.quantile(arr, p)), rel=1e-12, abs=0), (k, p)
    assert exact_quantiles(df.where("false").withColumn("c", F.lit(1)), ["k"], "v", "c", probs).collect() == []


def test_infinities_and_nan_come_last(spark):
    values = [float("-inf"), -1.0, 0.0, 1.0, float("inf"), float("nan"), float("nan")]
    df = spark.createDataFrame([(1, v, 1) for v in values], "k int, v double, c int")
    got = [r["value"] for r in exact_quantiles(df, ["k"], "v", "c", [0.5, 1 / 6, 1.0]).orderBy("prob").collect()]
    assert got[:2] == [-1.0, 1.0] and np.isnan(got[2])


@pytest.mark.parametrize("buckets", [1, 8, None])
def test_sorted_gaps_match_numpy(spark, buckets):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 500, size=3000)
    df = spark.createDataFrame([(0, int(v)) for v in vals], "k int, v long")
    gaps = sorted_gaps(df, ["k"], "v", buckets=buckets).toPandas()
    diffs = np.diff(np.sort(vals))
    exp = {float(g): int(c) for g, c in zip(*np.unique(diffs, return_counts=True))}
    got = {float(g): int(c) for g, c in zip(gaps["gap"], gaps["cnt"])}
    assert got == exp
