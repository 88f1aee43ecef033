import csv
import io
import random

import pytest

from lumen.sources import files as S
from lumen.sources import records as R


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", False, True), (b'"a,b', True, False), (b'a"b,c', False, False), (b'"a""b', True, False), (b'x,"a"', False, False),
    (b'"a",b"', False, False), (b'a"",', False, True), (b'""', False, True), (b'"', True, False), (b'b",c', False, False), (b'b",c,"d', True, True),
])
def test_state_after_a_line(line, outside, inside):
    assert (R.inside_after(line, b",", False), R.inside_after(line, b",", True)) == (outside, inside)


def test_states_are_composed_over_splits(spark):
    r = random.Random(1)
    maps = [("f%d" % (i % 2), i * 10, r.random() < 0.5, r.random() < 0.5) for i in range(60)]
    want = {}
    for f in ("f0", "f1"):
        state = False
        for _, start, outside, inside in (m for m in maps if m[0] == f):
            want[f, start] = state
            state = inside if state else outside
    r.shuffle(maps)
    got = R.split_states(spark.createDataFrame(maps, "file string, start bigint, from_outside boolean, from_inside boolean"))
    assert {(x["file"], x["start"]): x["inside"] for x in got.collect()} == want


def _write(path, rows, end="\n", encoding="utf-8"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))
    return str(path)


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("end, encoding", [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "utf-8-sig"), ("\n", "big5")])
def test_quoted_line_ends_in_many_splits(spark, tmp_path, small_splits, end, encoding):
    r = random.Random(7)
    stock = ["a", "b,c", '"', '""', "\n", "\n\n", "數量", "x;y", "long words here ", " ", '5"']
    rows = [[str(i), "".join(r.choice(stock) for _ in range(r.choice([3, 12, 400 if i % 40 == 0 else 2]))), r.choice(["", "z"])] for i in range(300)]
    path = _write(tmp_path / "q.csv", [["id", "text", "flag"], *rows], end, encoding)
    df, report = S.read_csv(spark, path, infer=False)
    assert report.encoding == encoding and report.bad_rows == 0 and df.columns == ["id", "text", "flag"]
    got = {x["id"]: x["text"] or "" for x in df.collect()}
    assert got == {i: t for i, t, _ in rows}
    parts = R.quoted_records(spark, path, encoding, ",")
    assert parts.select("start").distinct().count() >= 8  # one file, many tasks
    assert parts.where(f"kind = {R.MIDDLE}").count() > 0  # a record over more than two splits


def test_a_stray_quote_stays_in_its_record(spark, tmp_path, small_splits):
    rows = [f"{i},pipe {i},x" for i in range(200)]
    rows[50] = '50,5" pipe,x'
    rows[51] = '51,6"" pipe",x'
    rows[120] = '120,"two\nlines",x'
    path = tmp_path / "stray.csv"
    path.write_text("id,name,flag\n" + "\n".join(rows) + "\n")
    df, report = S.read_csv(spark, str(path))
    got = {r["id"]: r["name"] for r in df.collect()}
    assert len(got) == 200 and report.bad_rows == 0
    assert got[50] == '5" pipe' and got[51] == '6"" pipe"' and got[120] == "two\nlines" and got[121] == "pipe 121"


def test_ragged_rows_blank_lines_and_several_files(spark, tmp_path, small_splits):
    _write(tmp_path / "a.csv", [["k", "v"], ["1", "x\ny"], [], ["2"], ["3", "p", "q"], ["4", "r"]])
    _write(tmp_path / "b.csv", [["k", "v"], ["5", 'say "no"'], ["6", "\n"]])
    (tmp_path / "c.csv").write_text('k,v\n7,"never closed\n8,z\n')
    df, report = S.read_csv(spark, str(tmp_path))
    assert report.bad_rows == 1 and report.warnings
    got = {r["k"]: r["v"] for r in df.collect()}
    assert got[1] == "x\ny" and got[2] is None and got[4] == "r" and got[5] == 'say "no"' and got[6] == "\n" and 3 not in got
    assert got[7].startswith("never closed") and 8 not in got
