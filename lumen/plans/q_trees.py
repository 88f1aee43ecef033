"""Registered query of the level-wise trees (M17) and its twin, a level a group of CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumen.functions.casts import fround, fround_sql as R
from lumen.operators import extra_trees as ET
from lumen.plans.registry import register
from lumen.sources.tables import table

FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
TREES, DEPTH, TRIED, SEED = 3, 2, 2, 42


def _draw_sql(salt: str) -> str:
    return f"('0x' || substr(md5('{SEED}:{salt}:' || tree || ':' || node || ':' || feature), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"


def _trees_sql() -> str:
    x = ", ".join(f"{c}::DOUBLE" for c in FEATURES)
    parts = [f"r0 AS (SELECT [{x}] AS x, l_extendedprice::DOUBLE AS y, t::INTEGER AS tree, 1::BIGINT AS node FROM lineitem, range({TREES}) AS q(t))"]
    out = []
    for d in range(DEPTH + 1):
        parts += [
            f"e{d} AS (SELECT tree, node, y, f::INTEGER AS feature, x[f + 1] AS v FROM r{d}, range({len(FEATURES)}) AS q(f))",
            f"""s{d} AS (SELECT tree, node, feature, count(*) AS n, sum(y) AS s, min(v) AS low, max(v) AS high, max(y) > min(y) AS mixed
  FROM e{d} GROUP BY ALL)"""]
        if d == DEPTH:
            out.append(f"SELECT tree, node, n, s / n AS value, NULL::INTEGER AS feature, NULL::DOUBLE AS threshold FROM s{d} WHERE feature = 0")
            break
        parts += [
            f"""c{d} AS (SELECT *, low + ({_draw_sql('t')}) * (high - low) AS threshold FROM s{d} WHERE mixed AND high > low
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_draw_sql('f')}, feature) <= {TRIED})""",
            f"""l{d} AS (SELECT tree, node, feature, count(*) AS nl, sum(y) AS sl FROM e{d} JOIN c{d} USING (tree, node, feature)
  WHERE v <= threshold GROUP BY ALL)""",
            f"""b{d} AS (SELECT tree, node, feature, threshold FROM c{d} JOIN l{d} USING (tree, node, feature)
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, feature) = 1)""",
            f"r{d + 1} AS (SELECT x, y, tree, node * 2 + (x[feature + 1] > threshold)::BIGINT AS node FROM r{d} JOIN b{d} USING (tree, node))"]
        out.append(f"SELECT a.tree, a.node, a.n, a.s / a.n AS value, b.feature, b.threshold FROM s{d} a LEFT JOIN b{d} b USING (tree, node) WHERE a.feature = 0")
    return ("WITH " + ",\n".join(parts) + f"\nSELECT tree, node, n, {R('value', 4)} AS value, feature, {R('threshold', 6)} AS threshold FROM (\n"
            + "\nUNION ALL\n".join(out) + ")")


@register("extra_trees_depth_2", sql=_trees_sql())
def q_extra_trees_depth_2(spark, sf_dir):
    """All nodes of three extremely randomised trees for l_extendedprice over all rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x"),
                                                   F.array(F.col("l_extendedprice").cast("double")).alias("g"))
    nodes = ET.grow(rows, 1, TREES, DEPTH, TRIED, SEED)
    return nodes.select("tree", "node", "n", fround(F.get("value", F.lit(0)), 4).alias("value"), "feature",
                        fround("threshold", 6).alias("threshold"))
