import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import sentencepiece

from lumen.llm import quality_rules as rules

PIECES, RANKS = public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken")


def base(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    mark = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(mark), len(words) < 10 or 100 * len(mark) > 20 * len(words))


def fertility(text, model):
    ids = [t for w in (text or "").encode().split() for t in model.encode(w.decode())]
    p = np.array(list(Counter(ids).values())) / max(len(ids), 1)
    return len(ids), sum(map(model.IsByte, ids)), float(-(p * np.log2(p)).sum()) if ids else 0.0


def run(docs, **more):
    return rules.fertility_rules(docs, PIECES, RANKS, public.PATTERN, **more)


def run_measured(docs):
    return rules.measured_rules(docs, PIECES, RANKS, public.PATTERN)


def test_counts_match_brute_force(edge):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want, extra = [], []
    for r in edge.select("doc_id", "text").collect():
        want.append((r["doc_id"], *base(r["text"])))
        extra.append((r["doc_id"], *fertility(r["text"], model)))
    out = run(edge).collect()
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    near = sorted(((str(r["doc_id"]), r["n_tokens"], round(r["byte_share"] * max(r["n_tokens"], 1)), round(r["token_entropy"], 6)) for r in out))
    assert near == sorted((str(i), n, b, round(h, 6) + 0.0) for i, n, b, h in extra)
    assert all(not r["kept"] for r in out if r["base_failed"])


def test_bands_reject_by_script_and_by_language(spark):
    plain = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} of language" for i in range(60))
    noise = " ".join(f"{(i * 7919) % 10007:x}q{i}zxj" for i in range(60))
    han = " ".join("这是一个关于语言的句子" for _ in range(3)) + " " + " ".join("数据处理系统" for _ in range(9))
    docs = spark.createDataFrame([(1, plain, "en"), (2, noise, "en"), (3, han, "zh"), (4, plain, "xx")], "doc_id int, text string, lang string")
    tight = dict(rules.BANDS) | {"latin": rules.Band((1.8, 12.0), 0.3)} | {"xx": rules.Band((50.0, 99.0), 0.3)}
    kept = {r["doc_id"]: (r["kept"], r["script"]) for r in run(docs, lang_col="lang", bands=tight).collect()}
    assert kept[1] == (True, "latin") and kept[2][0] is False and kept[4][0] is False
    assert kept[3][1] == "han"


def junk(seed):
    """Texts of 60 words that pass the base rules and are no language, by kind."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    wide = letters + letters.upper() + "0123456789+/"
    return {
        "letters": " ".join("".join(r.choice(letters) for _ in range(8)) for _ in range(60)),
        "base64": " ".join("".join(r.choice(wide) for _ in range(40)) for _ in range(60)),
        "hex": " ".join("".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(60)),
        "digits": " ".join("".join(r.choice("0123456789") for _ in range(9)) for _ in range(60)),
        "signs": " ".join("".join(r.choice("!@#$%^&*") for _ in range(6)) for _ in range(60)),
        "mojibake": " ".join("".join(r.choice("éèàçùâêîôû日本語") for _ in range(6)).encode().decode("latin-1") for _ in range(60)),
    }


ENGLISH = ("the of and to in is that for it was on are as with they at be this have from or one had by but not what all were "
           "when we there can an your which their said if will each about how up out them then many some these would other "
           "into has more her two like him see time could make than first been its who now people my made over did down only "
           "way find use may water long little very after words called just where most know").split()


def test_measured_bands_reject_junk_and_keep_prose(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(ENGLISH) for _ in range(r.randint(30, 200))), "en") for i in range(120)]
    for k in range(4):
        rows += [(1000 + 10 * k + i, t, ["en", "en", None, "xx"][k]) for i, t in enumerate(junk(k).values())]
    out = run_measured(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()
    assert all(x["kept"] for x in out if x["doc_id"] < 1000)
    assert [x["doc_id"] for x in out if x["doc_id"] >= 1000 and x["kept"]] == []


def test_measured_verdict_matches_brute_force(spark, edge):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(ENGLISH[:40 + i % 60]) for _ in range(60)), [None, "en", "fr"][i % 3]) for i in range(240)]
    rows += [(500 + i, t, "en") for i, t in enumerate(junk(9).values())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").unionByName(edge.select("doc_id", "text", "lang"))
    out = run_measured(docs).collect()
    names = list(rules.LEAST_SPREAD)
    def step(x, m):
        return int(np.floor((x[m] if m == "byte_share" else np.log(max(x[m], 1e-6))) * rules.STEPS))

    def bands(key):
        groups = defaultdict(list)
        for x in out:
            if not x["base_failed"]:
                groups[key(x)].append([step(x, m) for m in names])
        ends = {}
        for k, v in groups.items():
            if len(v) >= rules.LEAST_TEXTS:
                ends[k] = []
                for m, own in zip(names, map(sorted, zip(*v))):
                    q1, q3 = (own[-(-len(own) * q // 4) - 1] for q in (1, 3))
                    reach = rules.FENCE * max(q3 - q1, rules.LEAST_SPREAD[m] * rules.STEPS)
                    ends[k].append((q1 - reach if m != "byte_share" else -np.inf, q3 + reach))
        return ends

    own, script = bands(lambda x: (x["lang"], x["script"])), bands(lambda x: x["script"])
    assert len(own) >= 3
    for x in out:
        ends = own.get((x["lang"], x["script"])) or script.get(x["script"])
        want = ends is None or all(a <= step(x, m) <= b for m, (a, b) in zip(names, ends))
        assert x["in_measured_band"] == want
        assert x["kept"] == (x["in_fixed_band"] and want) and not (x["kept"] and x["base_failed"])
    assert len(out) == docs.count()


def test_words_are_forgotten_without_changing_results(edge):
    a = sorted(map(repr, run(edge).collect()))
    b = sorted(map(repr, run(edge.repartition(1).sortWithinPartitions("row")).collect()))
    assert a == b


def test_empty_table(empty):
    assert run(empty).collect() == []
    assert run_measured(empty).collect() == []
