import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, hash string, "
          "size double, fp bigint, key string, kept string")


def words(seed, n, size=400):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(1, 9))) for _ in range(size)]
    return [r.choice(stock) for _ in range(n)]


def prose(seed, n):
    """Sentences of some words, lines of some sentences."""
    r, out = random.Random(seed), []
    left = words(seed, n)
    while left:
        k = r.randint(3, 12)
        out.append(" ".join(left[:k]).capitalize() + r.choice([". ", ". ", "! ", ".\n"]))
        left = left[k:]
    return "".join(out)


def edge_rows():
    """Nulls in every column, empty, blank, short and very long texts, repeated rows, ties."""
    base = prose(1, 200)
    shared = prose(2, 60)
    texts = [
        (1, None), (2, ""), (3, " \t\n\r "), (4, "one two"), (4, "one two"), (5, "one two"), (None, base),
        (6, base), (7, base), (8, base[:-1] + "?"), (9, prose(3, 80) + shared + prose(4, 80)),
        (10, prose(5, 90) + shared), (11, shared), (12, prose(6, 60_000)), (13, "é" * 40 + "日本語 テキスト 안녕하세요 Ωμέγα ÀÉ ß İ"),
        (14, "ab" * 500), (15, "a b " * 400), (15, prose(7, 50)), (16, "x" * 30_000), (17, "1234 5678 !!! ... ???"),
        (18, "<|endoftext|> it's <|startoftext|>x<|endoftext|> ﬁ ﬂ ẞ Σας é"), (19, prose(8, 300)), (20, None),
        (21, "🙂" * 30 + prose(9, 40)), (22, "🙃" * 30 + prose(9, 40)),
    ]
    langs, sources = ["en", "fr", None], ["s1", "s2", None, "s3"]
    return [(i, t, langs[k % 3], sources[k % 4], len(t) if t and k % 5 else None, f"x{k}" if k % 2 else None, k, None, float(k), k, "k", "z")
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
