import re

import duckdb

from lumen.llm import license_scan, sentence_spans
from lumen.llm.license_texts import LICENSES, LONG, NOTICES, long_licenses
from lumen.llm.queries import ORACLE_SQL
from tests.llm.conftest import prose


def kept_by_brute_force(rows, span=sentence_spans.SPAN, least=sentence_spans.MIN_WORDS):
    stops = ".!?…。！？؟۔।"
    split = re.compile(f"[^{stops}\n]+[{stops}]*|[{stops}\n]")
    docs = []
    for i, t in rows:
        pieces = split.findall(t or "")
        at = [k for k, p in enumerate(pieces) if p.strip(stops + " \t\n\x0b\x0c\r")]
        norm = [tuple(w for w in re.split(r"[\x20\x09-\x0D]+", pieces[k].lower()) if w) for k in at]
        runs = {}
        for s in range(len(norm)):
            for e in range(s + min(span, len(norm)), len(norm) + 1):
                if sum(map(len, norm[s:e])) >= least:
                    runs[s] = (e, tuple(norm[s:e]))
                    break
        docs.append((i, t, pieces, at, runs))
    first, out = {}, []
    for i, t, _, _, runs in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        for s, (_, run) in runs.items():
            first.setdefault(run, (i, t, s))
    for i, t, pieces, at, runs in docs:
        gone = {k for s, (e, run) in runs.items() if first[run] != (i, t, s) for k in at[s:e]}
        out.append((i, len(at), len(gone), "".join(p for k, p in enumerate(pieces) if k not in gone)))
    return sorted(out, key=repr)


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Copies of one long sentence, of words that are sentences each, of passages set into other
    sentences, in scripts with other stops; and short sentences that many texts share."""
    one = " ".join(prose(30, 40).replace(".", "").replace("!", "").split())
    exclaimed = " ".join(w.strip(".!") + "!!" for w in prose(31, 60).split())
    passage = prose(32, 60)
    hindi = "।".join(" ".join(f"श{a}{b}" for b in range(9)) for a in range(8))
    common = "It is so. That is all. Yes. No. "
    texts = [one, one, exclaimed, exclaimed, prose(33, 50) + "and then " + passage, prose(34, 50) + "but " + passage + prose(35, 30), hindi, hindi,
             common + prose(36, 100), common + prose(37, 100), "Yes. No. Yes. No.", "Yes. No. Yes. No."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["n_removed"] for r in sentence_spans.remove_repeated_spans(docs).collect()}
    assert [i for i, n in sorted(got.items()) if n] == [1, 3, 5, 7]


def test_spans_match_brute_force(edge, empty):
    docs = edge.where("row NOT IN (3, 5)")  # rows that repeat an id with another text are ordered by hash
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in sentence_spans.remove_repeated_spans(docs).collect()), key=repr)
    assert got == kept_by_brute_force(rows)
    assert any(n for _, _, n, _ in got)
    assert sentence_spans.remove_repeated_spans(empty).collect() == []


def test_equal_rows_count_as_one_document(spark):
    text = prose(20, 60)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_removed"] > 0) for r in sentence_spans.remove_repeated_spans(docs).collect()}
    assert got == {(1, False), (2, True), (None, True)}


def test_whole_licences_in_other_spellings(spark):
    mit = LICENSES["MIT"]
    texts = [
        (1, mit), (2, mit.upper().replace("\n", "\r\n")), (3, "Copyright (c) 2020 Some One\n\n" + mit.replace("sublicense", "sub-license")),
        (4, mit + "\nAnd more."), (5, "  © 1999 X\n" + LICENSES["BSD-2-Clause"].replace('"AS IS"', "``AS IS''")), (6, None), (7, ""),
        (8, "All rights reserved."), (9, LICENSES["Zlib"].replace("appreciated", "appreciated,").replace("acknowledgment", "acknowledgement")),
        (9, LICENSES["ISC"]),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id int, text string, license_id string, lines string")
    got = sorted((r["doc_id"], r["license_id"] or "") for r in license_scan.scan(docs).collect())
    assert got == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, ""), (5, "BSD-2-Clause"), (6, ""), (7, ""), (8, ""), (9, "ISC"), (9, "Zlib")]


def test_copyright_lines_in_every_form(spark):
    lines = ["Copyright © 2020 Jane Doe", "© Jane Doe", "(c) Copyright 2020 Jane Doe", "Copyright The X Authors", "Copyright Jane Doe 2020",
             "Copyright [yyyy] [name of copyright owner]", "Copyright <YEAR> <COPYRIGHT HOLDER>", "# Copyright Jane Doe. All rights reserved."]
    known = sorted(license_scan.LICENSES)
    docs = spark.createDataFrame([(f"{i}/{name}", f"{line}\n\n{license_scan.LICENSES[name]}") for i, line in enumerate(lines) for name in known],
                                 "doc_id string, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(docs).collect()}
    assert got == {f"{i}/{name}": name for i in range(len(lines)) for name in known}


def test_body_lines_about_copyright_stay(spark):
    words = license_scan.LICENSES["MIT"].split(), license_scan.LICENSES["BSD-3-Clause"].split()
    docs = spark.createDataFrame([(" ".join(w[:n]), " ".join(w[:i]) + "\n" + " ".join(w[i:i + n]) + "\n" + " ".join(w[i + n:]))
                                  for w in words for i, x in enumerate(w) if x.lower() == "copyright" for n in (2, 5, 8)],
                                 "doc_id string, text string")
    assert {r["license_id"] for r in license_scan.scan(docs).collect()} == {"MIT", "BSD-3-Clause"}


def test_long_licences_with_and_without_their_appendix(spark):
    texts = long_licenses()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} == set(LONG) == {name for name, _ in texts}
    filled = "Copyright © 2020 Jane Doe\n" + texts[0][1].upper().replace("[YYYY] [NAME OF COPYRIGHT OWNER]", "2021 THE X AUTHORS")
    docs = spark.createDataFrame([*texts, ("Apache-2.0", filled), ("none", texts[0][1] + "\nAnd more.")], "doc_id string, text string")
    got = sorted((r["doc_id"], r["license_id"] or "none") for r in license_scan.scan(docs).collect())
    assert got == sorted((name, name) for name, _ in [*texts, ("Apache-2.0", ""), ("none", "")])


def test_notices_are_whole_lines(spark, edge, empty):
    text = f"Some text.\n{NOTICES['MIT'].upper()}\nMore. {NOTICES['GPL-3.0']}\n{NOTICES['MIT']}\nlicensed under cc  BY NC 4.0!"
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id int, text string")
    got = {r["doc_id"]: (r["n_notices"], r["notice_ids"]) for r in license_scan.scan(docs).collect()}
    assert got == {1: (3, "CC-BY-NC-4.0,MIT"), 2: (0, "")}
    assert license_scan.scan(edge).count() == edge.count()
    assert license_scan.scan(empty).collect() == []
    none = license_scan.scan(docs, notices={}).collect()
    assert {r["n_notices"] for r in none} == {0}


def test_the_callers_licences(spark):
    known = spark.createDataFrame([("b", "My own  licence."), ("a", "my own license"), ("e", "")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "MY OWN LICENSE!"), (2, "")], "doc_id int, text string")
    assert {(r["doc_id"], r["license_id"]) for r in license_scan.scan(docs, known).collect()} == {(1, "a"), (2, None)}


def test_the_scan_equals_its_sql(spark):
    owners = ["Copyright © 2020 Jane Doe", "© Jane Doe", "(c) Copyright 2020 Jane Doe", "Copyright The X Authors", "Copyright Jane Doe 2020",
              "Copyright [yyyy] [name of copyright owner]", "copyright holders be liable", "copyright notice and this", "Copyright the work of many",
              "Portions copyright by the Some Project", "c copyright 2001", "copyright law is one two three four five six seven eight nine"]
    texts = [text for _, text in long_licenses()] + [f"{line}\n{LICENSES['MIT']}" for line in owners] + [
        *owners, None, "", " \n.", *NOTICES.values(), *LICENSES.values()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    documents = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    columns = "doc_id, text_digest, license_id, n_notices, notice_ids"
    expected = con.execute(f"SELECT {columns} FROM ({ORACLE_SQL['op6_license_scan']}) ORDER BY doc_id").fetchall()
    got = [tuple(r) for r in license_scan.scan(docs).select(*columns.split(", ")).orderBy("doc_id").collect()]
    assert got == expected
    assert {"Apache-2.0", "GPL-3.0", "MIT"} <= {r[2] for r in got}
