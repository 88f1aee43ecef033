import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumen.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(PATH)


def ids_of(own, texts):
    table = own.table()
    rows, counts = table.number([t.encode() for t in texts])
    start, lens = table.features
    ids = bpe.gather(own.ids, start[rows], lens[rows])
    ends = np.cumsum(bpe.sums_by_group(lens[rows], counts))
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]


def test_random_texts_match_the_library(own, library):
    r = random.Random(3)
    bits = ["a", "b", "the", "ing", " ", "\n", "Σ", "ς", "İ", "é", "é", " ", "\u0085", "\x1c", " ", "ß", "你",
            "😀", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "１", "½", "٣", "--", "!!!", "aaaa", "ǅ", "ﬁ"]
    texts = ["".join(r.choice(bits + [chr(r.randint(1, 0x2FFF)), chr(r.randint(0xE000, 0x1FFFF))]) for _ in range(r.randint(1, 40)))
             for _ in range(1500)]
    texts += ["x" * 5000, "ab" * 3000, "internationalization" * 30, "aaaaaaaa" * 9]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(own, texts) == want


def test_every_failing_proposal_is_merged_exactly(own, library):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghilmnorstuvy") for _ in range(r.randint(1, 15))) for _ in range(5000)]
    data = [w.encode() for w in words]
    flat, lens = own.encode_words(data)
    ends = np.cumsum(lens)
    got = [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    buffer = np.frombuffer(b"".join(data), dtype=np.uint8)
    sizes = np.array(list(map(len, data)))
    proposed, n = own.propose(buffer, bpe.starts_of(sizes), sizes)
    ends = np.cumsum(n)
    right = [proposed[a:b].tolist() == g for a, b, g in zip([0, *ends[:-1]], ends, got)]
    assert 0.1 < np.mean(right) < 0.95  # both branches are taken


def test_table_is_emptied_without_changing_results(own, library):
    texts = ["some words here", "other words there", "some other"]
    table = own.table()
    table.limit = 2
    for t in texts:
        rows, _ = table.number([t.encode()])
        start, lens = table.features
        assert bpe.gather(own.ids, start[rows], lens[rows]).tolist() == library.encode(t, add_special_tokens=False).ids


def test_round_trip_of_edge_rows(edge, library):
    rows = edge.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], bytes(r["ids"]), r["text"]) for r in bpe.encode_and_decode(edge, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    apart = bpe.decode(bpe.encode(edge, PATH), PATH)
    assert sorted(((r["doc_id"], r["text"]) for r in apart.collect()), key=repr) == sorted(((i, t) for i, _, t in want), key=repr)


def test_empty_table_and_null_ids(spark, empty):
    assert bpe.digests(empty, PATH).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert bpe.decode(null, PATH).collect()[0]["text"] == ""
