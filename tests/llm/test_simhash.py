import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lumen.llm import simhash
from lumen.llm.components import connected_components


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=3):
    """Root (smallest position) of every fingerprint, all pairs compared."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    roots = components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f - (1 << 64) if f >> 63 else f, least.get(r)) for (i, _), f, r in zip(rows, fps, roots)), key=repr)


def test_edge_rows_match_brute_force(edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.simhash_groups(edge).collect()), key=repr)
    assert got == expected(rows)


def test_one_row_of_each_component_stays(edge):
    groups = simhash.simhash_groups(edge).collect()
    want = {r["component_id"] for r in groups if r["component_id"] is not None}
    kept = simhash.keep_one_of_each(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 1


def test_empty_table(empty):
    assert simhash.simhash_groups(empty).collect() == []
    assert simhash.keep_one_of_each(empty).collect() == []


@pytest.mark.parametrize("list_rows", [8192, 16])
def test_links_connect_the_same_fingerprints_as_all_pairs(spark, monkeypatch, list_rows):
    """Dense families of fingerprints, also with posting lists dealt out as block pairs."""
    monkeypatch.setattr(simhash, "LIST_ROWS", list_rows)
    r = random.Random(7)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(25):
            flips = r.sample(range(64), r.randint(0, 6))
            fps.add(centre ^ sum(1 << b for b in flips))
    fps |= {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = simhash.links(nodes)
    rows = edges.collect()
    for e in rows:
        assert ((e["src"] ^ e["dst"]) & (1 << 64) - 1).bit_count() <= 3
    assert len(rows) <= 8 * len(fps) * (1 if list_rows > 100 else 8)
    roots = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = components(fps)
    by_brute, by_spark = {}, {}
    for f, w in zip(signed, want):
        by_brute.setdefault(w, set()).add(f)
        by_spark.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, by_brute.values())) == sorted(map(sorted, by_spark.values()))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, i) for i in range(1001, 1300)]
    odd = [(5000, 5000), (None, 7), (8, None), (3, 2)]
    got = {r["node"]: r["root"] for r in connected_components(
        spark.createDataFrame(path + star + odd, "src bigint, dst bigint")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1300)}


def test_majority_needs_over_half():
    same = np.array([1, 2, 3, 2], dtype=np.uint64)
    assert simhash._majority(same, np.array([2, 0, 2])).tolist() == [0, 0, 2]
