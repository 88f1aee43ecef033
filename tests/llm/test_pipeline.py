import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lumen.llm import mixing, quality_classifier
from lumen.sources.tables import table
from tests.conftest import SF001
from tests.llm.test_mixing import plan
from tests.llm.test_simhash import expected
from tests.llm.test_suffix_dedup import removed


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_every_stage_matches_brute_force(spark):
    docs = table(spark, SF001, "documents")
    stage = dict(cp.STAGES)
    assert list(stage) == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "mix_sources", "bpe"]

    good = stage["quality_classifier"](spark, docs, SF001).checkpoint()
    scores = quality_classifier.classify(docs, quality_classifier.train(docs, table(spark, SF001, "labels")))
    assert sorted(texts(good)) == sorted(texts(docs.join(scores.where("kept").select("doc_id"), "doc_id")))

    unique = stage["simhash_near_dedup"](spark, good, SF001).checkpoint()
    want = {(i, t) for (i, t) in texts(good) if i in {c for _, _, c in expected(texts(good))}}
    assert set(texts(unique)) == want and unique.count() == len(want) < good.count()

    cut = stage["suffix_array_dedup"](spark, unique, SF001).checkpoint()
    by_brute = {i: (begins, ends) for i, _, _, begins, ends, _ in removed(texts(unique))}
    before = dict(texts(unique))
    for r in cut.collect():
        whole = before[r["doc_id"]].encode()
        kept, at = [], 0
        for a, b in zip(*by_brute[r["doc_id"]]):
            while a < b and whole[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(whole) and whole[b] & 0xC0 == 0x80:
                b -= 1
            kept.append(whole[at:a])
            at = b
        assert r["text"].encode() == b"".join([*kept, whole[at:]]) and r["n_chars"] == len(r["text"])

    mixed = stage["mix_sources"](spark, cut, SF001).checkpoint()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in cut.select("doc_id", "text", "source").collect()]
    copies = {i: n for i, _, _, _, n in plan(rows)}
    assert sorted(texts(mixed)) == sorted((i, t) for i, t, _ in rows for _ in range(copies[i]))
    assert mixing.mix_plan(cut).count() == cut.count()
    for step in (good, unique, cut, mixed):
        assert step.columns == docs.columns and step.dtypes == docs.dtypes

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(map(tuple, stage["bpe"](spark, mixed, SF001).collect()))
    want = []
    for i, t in texts(mixed):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert sorted(map(tuple, cp.run(spark, SF001).collect())) == got


def test_stages_take_edge_rows_and_empty_tables(spark, edge, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(columns), empty.select(columns)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF001).checkpoint()
