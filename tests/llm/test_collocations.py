import random
import re
from collections import Counter

import pytest

from lumen.llm import collocations


def brute(rows, least, longest, first):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    frequent = {p: n for p, n in counts.items() if n >= least}
    within = Counter()
    for (lang, w), n in frequent.items():
        for k in range(1, len(w)):
            for i in range(len(w) - k + 1):
                within[lang, w[i:i + k]] = max(within[lang, w[i:i + k]], n)
    out = {}
    for (lang, w), a in frequent.items():
        if len(w) > 1 and not 100 * within[lang, w] >= 100 * a:
            cuts = [(1000 * a * total[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), frequent[lang, w[:k]], frequent[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s)
                  for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:first], 1))


def result(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n):
    r = random.Random(seed)
    stock = ["of", "The", "the", "a", "é", "New", "york", "city", "x", "aa", "日本"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(stock) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(r.randint(0, 40)))
        rows.append((r.choice([text, text + "a a a a a a a", "in New York City hall; " + text]), r.choice(["en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("least, longest, first", [(3, 5, 50), (10, 3, 7), (2, 2, 1000), (1, 6, 40)])
def test_matches_brute_force(spark, least, longest, first):
    rows = corpus(least, 120)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert result(collocations.collocations(docs, least, longest, first)) == brute(rows, least, longest, first)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(9, 100)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)
    monkeypatch.setattr(collocations, "ROWS", 7)
    assert result(collocations.collocations(docs, 4, 5, 100)) == brute(rows, 4, 5, 100)


def test_edge_table(edge, empty):
    rows = [(r["text"], r["lang"]) for r in edge.collect()]
    assert result(collocations.collocations(edge, 5)) == brute(rows, 5, 5, 2000)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(edge.where("text IS NULL")).collect() == []


def test_exact_beyond_64_bits(spark):
    """1000 a n is past 2^63 long before the counts are; the cut's arithmetic is decimal."""
    from pyspark.sql import functions as F
    huge = 9 * 10**16
    row = spark.createDataFrame([(huge, huge, [huge + 1], [huge + 7])], "n bigint, total bigint, from_left array<bigint>, from_right array<bigint>")
    cut = row.select(collocations._lowest_cut(2).alias("c")).select(F.col("c.score")).first()[0]
    assert cut == 1000 * huge * huge // ((huge + 1) * (huge + 7))
