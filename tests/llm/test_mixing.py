import hashlib
import math
import re

import pytest

from lumen.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """By resharing the excess until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        out = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in names}
        above = {s for s in free if out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


def plan(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    per = {}
    for (_, _, s), n in zip(rows, size):
        per[s] = per.get(s, 0) + n
    t = targets(per)
    out = []
    for (i, _, s), n in zip(rows, size):
        rate = t[s] / per[s] if per[s] else 0
        draw = int(hashlib.md5(f"9:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2 ** 32
        out.append((i, n, per[s], round(t[s], 6), math.floor(rate) + (draw < rate - math.floor(rate))))
    return sorted(out, key=repr)


def test_edge_rows_match_the_iteration(edge):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in edge.select("doc_id", "text", "source").collect()]
    got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"])
                  for r in mixing.mix_plan(edge).collect()), key=repr)
    assert got == plan(rows)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, "d": 10_000}, {"a": 0, "b": 0}, {"a": 7}, {None: 50, "é": 3, "z": 0},
    {f"s{i:02}": (i * 37) % 91 for i in range(25)}, {"a": 100, "b": 40, "c": 20},
])
def test_targets_share_everything_under_the_limit(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_repeats_whole_rows(edge):
    copies = {}
    for r in mixing.mix_plan(edge).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixed.schema["row"].dataType == edge.schema["row"].dataType
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {i: n for i, n in copies.items() if n}


def test_reruns_agree_and_empty(edge, empty):
    a, b = (sorted(map(repr, mixing.mix_plan(edge.repartition(n)).collect())) for n in (2, 7))
    assert a == b
    assert mixing.mix_plan(empty).collect() == [] and mixing.mix(empty).collect() == []
