import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lumen.llm import language_id as lid


def corpus(spark, n=240):
    r = random.Random(5)
    stock = {"aa": ["bal", "dor", "mint", "zol"], "bb": ["qué", "ñan", "llo", "ción"], "cc": ["schö", "ung", "ßen", "zür"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(stock))
        rows.append((i, " ".join("".join(r.choice(stock[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 30))), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    out = lid.held_out(F.col("doc_id"))
    model = lid.train(docs.where(~out))
    got = lid.predict(docs.where(out), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert got and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_unseen_words_back_off_to_ngrams(spark):
    model = lid.train(corpus(spark))
    assert model.knows("qué") and not model.knows("ciónñanciónqué")
    got = model.score_words(["ciónñanciónqué", "schößenungzür"])
    assert [model.languages[k] for k in got.argmax(axis=1)] == ["bb", "cc"]
    # no known n-gram of any length: as an unseen word in every language
    assert (model.score_words(["日"]) == model.unseen).all()


def test_edge_rows(edge, empty):
    model = lid.train(edge)
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in lid.predict(edge, model).collect()}
    und = {i for i, lang, s in rows if lang == "und" and s == 0}
    assert {1, 2, 3, 17, 20} <= und
    assert lid.predict(edge, model).count() == edge.count()
    assert {lang for _, lang, _ in rows} <= {"und", "en", "fr"}
    nothing = lid.train(empty)
    assert {r["lang_pred"] for r in lid.predict(edge, nothing).collect()} == {"und"}
    assert lid.predict(empty, model).collect() == []


def test_sample_is_bounded_and_scores_dont_depend_on_partitions(spark):
    docs = corpus(spark)
    whole = lid.train(docs)
    assert len(lid.train(docs, sample_per_lang=10).keys) < len(whole.keys)
    assert len(lid.train(docs, sample_bytes=500).keys) < len(whole.keys)
    a, b = (sorted(map(repr, lid.predict(docs.repartition(n), lid.train(docs.repartition(n))).collect())) for n in (1, 5))
    assert a == b


def test_a_rare_language_keeps_its_words(spark):
    rare = [(1000 + i, f"zut{chr(97 + i)} fripple", "rare") for i in range(3)]
    docs = corpus(spark, 600).union(spark.createDataFrame(rare, "doc_id bigint, text string, lang string"))
    model = lid.train(docs)
    assert all(model.knows(w) for w in ("zuta", "zutb", "zutc", "fripple"))
    assert {r["lang_pred"] for r in lid.predict(docs.where("lang = 'rare'"), model).collect()} == {"rare"}


def plain_grams(word, n):
    edged = word if n == 1 else f" {word} "
    return [edged[i:i + n] for i in range(len(edged) - n + 1)]


def plain_scorer(rows):
    """The same rule with dictionaries: text -> (language, share)."""
    langs = sorted({lang for _, _, lang in rows if lang is not None})
    counts = {(k, lang): Counter() for k in range(6) for lang in langs}
    for _, text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()) if lang is not None and text is not None else ():
            counts[0, lang][w] += 1
            for k in range(1, 6):
                counts[k, lang].update(plain_grams(w, k))
    vocabulary = [set().union(*(counts[k, lang] for lang in langs)) for k in range(6)]

    def logs(k, term):
        out = []
        for lang in langs:
            total = sum(counts[k, lang].values()) + 0.5 * (len(vocabulary[k]) + 1)
            out.append(round(math.log((counts[k, lang][term] + 0.5) / total) * lid.FIXED))
        return out

    def word(w):
        if w in vocabulary[0]:
            return logs(0, w)
        for k in (5, 4, 3, 2, 1):
            known = [logs(k, g) for g in plain_grams(w, k) if g in vocabulary[k]]
            if known:
                return [sum(x) // len(known) for x in zip(*known)]
        return logs(0, "")

    def text(t):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words or not langs:
            return "und", 0.0
        total = [sum(x) for x in zip(*map(word, words))]
        best = max(total)
        return langs[total.index(best)], 1 / sum(math.exp((x - best) / lid.FIXED) for x in total)
    return text


def test_matches_a_plain_scorer(spark):
    docs = corpus(spark, 60).withColumn("text", F.when(F.col("doc_id") == 7, "").otherwise(F.col("text")))
    rows = [tuple(r) for r in docs.collect()]
    score = plain_scorer([r for r in rows if r[0] % 2])
    got = lid.predict(docs, lid.train(docs.where("doc_id % 2 = 1"))).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, share = score(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - share) < 1e-9


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "mir mir", "b"), (2, "mir mir", "a")], "doc_id bigint, text string, lang string")
    got = lid.predict(docs, lid.train(docs)).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and {r["score"] for r in got} == {0.5}
