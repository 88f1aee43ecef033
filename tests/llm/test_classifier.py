import random

import numpy as np

from lumen.llm import quality_classifier as qc
from lumen.sources.tables import table
from tests.conftest import SF01
from tests.llm.conftest import words


def corpus(spark, n=500, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        own = words(i, r.randint(20, 120))
        text = " ".join(own) if good else " ".join(w.upper() + "!!" for w in own)
        docs.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b"]) if good else r.choice(["b", "c"]), len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (3, None, 0), (10 ** 9, 0, 0)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
            {i: not t.endswith("!!") for i, t, *_ in docs})


def test_unlabelled_documents_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    model = qc.train(docs, labels)
    got = {r["doc_id"]: r for r in qc.classify(docs, model).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert sum(got[i]["kept"] == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("text_score", "meta_score", "score"))
    kept = qc.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_views_teach_each_other():
    """The content view has few labels; metadata that tell the classes teach it the rest."""
    r = np.random.default_rng(2)
    n = 600
    y = (r.random(n) < 0.5).astype(float)
    meta = qc.Rows(np.where(y > 0, 5, 9), np.ones(n), np.ones(n, dtype=np.int64))
    topic = r.integers(0, 20, n)
    text = qc.Rows((topic + 20 * y).astype(np.int64), np.full(n, 8.0), np.ones(n, dtype=np.int64))
    quality = np.full(n, np.nan)
    quality[:60] = y[:60]
    held = np.zeros(n, dtype=bool)
    held[40:60] = True
    alone = qc.co_train(text, meta, quality, held, rounds=0)
    taught = qc.co_train(text, meta, quality, held, rounds=4, confident=0.8, exchanged=0.5)
    rest = np.arange(60, n)

    def right(m):
        return float(((m.text.log_odds(text)[rest] > m.text.log_odds(text)[rest].mean()) == (y[rest] > 0)).mean())
    assert right(taught) >= right(alone) and right(taught) > 0.95


def test_both_views_pass_labels_on_the_given_tables(spark):
    docs, labels = (table(spark, SF01, name) for name in ("documents", "labels"))
    passed = qc.train(docs, labels).passed
    assert len(passed) == qc.ROUNDS
    for of_round in passed:
        assert of_round["text_good"] + of_round["text_bad"] > 0 and of_round["meta_good"] + of_round["meta_bad"] > 0


def test_one_class_or_no_labels_keep_by_the_prior(spark, edge, empty):
    labels = spark.createDataFrame([(9, 1), (10, 1)], "doc_id bigint, quality int")
    got = qc.classify(edge, qc.train(edge, labels)).collect()
    assert len(got) == edge.count() and all(r["kept"] for r in got) and len({r["score"] for r in got}) == 1
    none = qc.train(edge, labels.where("false"))
    assert {r["kept"] for r in qc.classify(edge, none).collect()} == {True}
    assert qc.classify(empty, none).collect() == []
    assert qc.classify(empty, qc.train(empty, labels)).collect() == []


def test_edge_rows_are_scored_alike_in_any_partitioning(spark, edge):
    docs, labels, _ = corpus(spark, 200)
    model = qc.train(docs, labels)
    again = qc.train(docs.repartition(5), labels)
    assert np.allclose(model.text.weights, again.text.weights)
    a, b = (sorted(((r["doc_id"], round(r["score"], 9), r["kept"]) for r in qc.classify(edge.repartition(n), model).collect()), key=repr)
            for n in (1, 4))
    assert a == b and len(a) == edge.count()
    assert qc.keep_good(edge, model).columns == edge.columns
