"""lumen — Spark-native dataset profiling, time-series indicators, model comparison
and rule-based findings.

Every operator takes and returns Spark DataFrames; the heavy work (scans, aggregates,
windows, joins, model fitting) runs on executors.  Only bounded, few-row results
(one row per column, per model, per metric) are ever looked at on the driver.
"""

__version__ = "0.1.0"
