import math
import random

import pytest

from lumen.llm import topk_search as tk

KIND = "vec_id bigint, embedding array<float>, label int, block string, id int, v int"


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is None or i % 20:
            continue
        best = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(ok) if b != a)[:k]
        out += [(i, rank + 1, None if null else j, -s) for rank, (s, null, j) in enumerate(best)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "b", 2, 3) for i, v in rows], KIND)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def f32(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("block_rows,chunk", [(1024, 256), (16, 4)])
def test_matches_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch, block_rows, chunk):
    monkeypatch.setattr(tk, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(tk, "CHUNK_BLOCKS", chunk)
    r = random.Random(9)
    centres = [[f32(r.gauss(0, 0.3)) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(260):
        c = centres[i % 5]
        rows.append((i, [f32(x + r.gauss(0, 0.05)) for x in c]))
    common = rows[40][1]
    rows += [(1000 + i, common) for i in range(60)]  # a very common vector
    rows += [(20, rows[3][1]), (20, rows[20][1]), (None, common), (None, rows[7][1])]
    rows += [(2000, None), (2020, [0.1, None] + [0.0] * 10), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (2080, [0.5, -0.5]), (2100, [])]
    assert got(tk.top_k(frame(spark, rows))) == brute(rows)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (40, [-1.0, 0.0])]
    assert got(tk.top_k(frame(spark, rows))) == brute(rows)
    assert tk.top_k(frame(spark, [])).collect() == []
    assert tk.top_k(frame(spark, [(0, [1.0])])).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(i, [f32(2.0 ** 21 + i), f32(3.0 * 2 ** 20 - i)]) for i in range(45)]
    assert got(tk.top_k(frame(spark, rows), k=3)) == brute(rows, 3)
