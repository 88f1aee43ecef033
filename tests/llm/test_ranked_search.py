import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumen.llm import ranked_search
from tests.llm.conftest import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    """Every document scored for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, bag in bags:
            score = 0
            for t, q in asked.items():
                if bag[t]:
                    m = 75 + 25 * bag.total() * n // total
                    score += q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i, ))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def result(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_matches_brute_force_on_the_edge_table(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    asked = [(1, "one two THREE one"), (2, rows[8][1][:200]), (3, None), (4, "!! ..."), (None, "日本語 ab ab é"), (5, "a b"), (6, "nowhere")]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in asked], "item_id int, text string, doc_id string, score int")
    for k in (3, 20):
        assert result(ranked_search.search(edge, items, k)) == brute(rows, asked, k)
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(edge, items.where("item_id = 3")).collect() == []
    assert ranked_search.search(edge, items.where("item_id = 99")).collect() == []


@pytest.mark.parametrize("size, step", [(400, 1), (4_000, 8), (1 << 24, 64)])
def test_blocks_steps_and_groups_change_nothing(spark, monkeypatch, size, step):
    r = random.Random(4)
    stock = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(stock[:r.choice([5, 50, 300])]) for _ in range(r.randint(0, 60)))) for i in range(700)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)]  # ties
    asked = [(i, " ".join(r.choice(stock) for _ in range(12))) for i in range(15)] + [(99, rows[1][1])]
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", size)
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 300)
    monkeypatch.setattr(ranked_search, "STEP", step)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    assert result(ranked_search.search(docs, items)) == brute(rows, asked, 20)


def lists_of(seed, n_lists=6, n_docs=5_000):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n_lists):
        docs = np.sort(r.choice(n_docs, size=n_docs // 2, replace=False))
        out.append(ranked_search.ImpactList(docs, (r.pareto(1.2, len(docs)) * 1000).astype(np.int64) + 1))
    return out


def test_best_positions_stop_early_and_exactly():
    lists, weights, tie = lists_of(1), [3, 1, 4, 1, 5, 9], np.arange(5_000)
    whole = np.zeros(5_000, dtype=np.int64)
    for x, w in zip(lists, weights):
        whole[x.docs] += w * x.impacts
    order = np.lexsort((tie, -whole))[:20]
    docs, scores, looked = ranked_search.best_positions(lists, weights, 5_000, 20, 0, tie, step=4)
    assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert looked < 2_500  # fewer than half of the documents were looked up
    # a floor from elsewhere ends it sooner, with those that reach it
    docs, scores, fewer = ranked_search.best_positions(lists, weights, 5_000, 20, int(whole[order[4]]), tie, step=4)
    assert docs.tolist() == order[:5].tolist() and fewer <= looked


def test_equal_scores_at_the_bound_are_not_missed():
    # all impacts equal: nothing but the strict comparison brings the smallest ids
    docs = np.arange(500)
    lists = [ranked_search.ImpactList(docs, np.full(500, 7)), ranked_search.ImpactList(docs, np.full(500, 9))]
    found, scores, _ = ranked_search.best_positions(lists, [1, 1], 500, 20, 0, np.arange(500)[::-1].copy(), step=2)
    assert found.tolist() == list(range(499, 479, -1)) and set(scores.tolist()) == {16}


def test_terms():
    for text in ["A-b_c  d1É\x00é", "", "日本 語 x", *words(5, 40)]:
        assert [t.decode() for t in ranked_search.terms_of(text.encode())] == terms(text)
