import json

import pytest

from lumen.sources import files as S
from lumen.sources import json_shape as J


def _w(d, name, text):
    p = d / name
    p.write_bytes(text.encode())
    return str(p)


@pytest.mark.parametrize("line, kind", [
    (b'{"a":1}', "object"), (b'{"a":1} x', "bad"), (b'{"a":1}{"a":2}', "bad"), (b'[{"a":1},{}]', "list"), (b"[1]", "bad"), (b"[]", "list"),
    (b"  \r", ""), (b"1", "bad"), (b'{"a":', "bad"), (b"\xff", "bad")])
def test_kind_of_a_line(line, kind):
    assert J.line_kind(line) == kind


@pytest.mark.parametrize("line, depth, want", [
    (b'{"a": "}{", "b": "\\"}"}', 0, (1, 0, False)), (b"{} {}", 0, (2, 0, False)), (b'"x"', 0, (1, 0, False)), (b'"x": 1,', 1, (0, 1, False)),
    (b"]} 3", 2, (1, 0, False)), (b"}", 0, (0, -1, True)), (b"", 0, (0, 0, False))])
def test_values_at_the_top(line, depth, want):
    assert J.top_values(line, depth) == want


@pytest.mark.parametrize("text", [
    '{"a":1} x\n{"a":2}\n{"a":3}\n', '{"a":1}\n2\n', '{"a":1}\n[1]\n', '{"a":1}{"a":2}\n',
    '{\n"a": 1\n}\n{\n"a": 2\n}\n', '[\n{"a": 1}\n]\n"more"\n', '{\n"a": 1\n', '}\n{\n', "", " \n\n"])
def test_what_is_no_json_is_an_error(spark, tmp_path, text):
    with pytest.raises(Exception):
        S.read_json(spark, _w(tmp_path, "x.json", text))[0].collect()


def test_long_documents_in_many_splits(spark, tmp_path):
    rows = [{"id": i, "t": "}{][ \" \\ " * (i % 7), "n": {"k": [i]}} for i in range(400)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        whole = json.dumps({"items": rows}, indent=1)
        df, _ = S.read_json(spark, _w(tmp_path, "doc.json", "﻿" + whole))
        assert {(r["id"], r["t"]) for r in df.collect()} == {(r["id"], r["t"]) for r in rows} and "n.k" in df.columns
        with pytest.raises(ValueError):
            S.read_json(spark, _w(tmp_path, "two.json", whole + "\n" + json.dumps(rows[0], indent=1)))
        with pytest.raises(ValueError):
            S.read_json(spark, _w(tmp_path, "open.json", whole[:-2]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_a_folder_of_both_kinds(spark, tmp_path):
    _w(tmp_path, "a.json", '{"id": 1, "items": [{"x": 1}]}\n{"id": 2}\n')
    _w(tmp_path, "b.json", json.dumps([{"id": 3}, {"id": 4}], indent=2))
    _w(tmp_path, "c.json", '{"id": 5}')
    _w(tmp_path, "d.json", "\n")
    df, report = S.read_json(spark, str(tmp_path))
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3, 4, 5] and report.warnings == ["json_lines"]
    _w(tmp_path, "e.json", '{"id": 6}\n{"id": 7')
    with pytest.raises(ValueError):
        S.read_json(spark, str(tmp_path))
