"""CSV records whose quoted fields hold line ends, from files that are read in splits.

A split can't know whether it starts inside a quoted field.  So every split is first read
under both assumptions, which gives a map from the state at its start to that at its end; the
maps of a file's splits, composed from the front, give each split's true state.  A second pass
over the lines then puts the records together.  Only the pieces of records that cross
from one split into the next are shuffled.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.session import ship_package

_REST_OF_QUOTED = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')

WHOLE, HEAD, MIDDLE, TAIL = range(4)


def inside_after(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, given that one was or wasn't at its
    start.  A quote opens a field only as its first character, and is doubled inside."""
    if b'"' not in line:
        return inside
    at, opened = 0, inside
    while True:
        if opened or line[at:at + 1] == b'"':
            closing = _REST_OF_QUOTED.match(line, at if opened else at + 1)
            if closing is None:
                return True
            at, opened = closing.end(), False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Runs of lines of one split: ((file, start), lines), in order."""
    for batch in batches:
        files, starts, lines = (batch.column(i).to_pylist() for i in range(3))
        a = 0
        for b in range(1, len(lines) + 1):
            if b == len(lines) or files[b] != files[a] or starts[b] != starts[a]:
                yield (files[a], starts[a]), lines[a:b]
                a = b


def _split_maps(sep: bytes):
    """Lines → (file, start, from_outside, from_inside): the state each split ends in."""
    def run(batches):
        now, states = None, [False, True]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, *states)], ["file", "start", "from_outside", "from_inside"])

        for block, lines in _blocks(batches):
            if block != now:
                if now:
                    yield row()
                now, states = block, [False, True]
            for line in lines:
                if b'"' in line:
                    states = [inside_after(line, sep, s) for s in states]
        if now:
            yield row()
    return run


def _records(sep: bytes, encoding: str, opened: set[tuple[str, int]]):
    """Lines → whole records, and the pieces of those that cross a split's ends."""
    bom = codecs.BOM_UTF8 if encoding == "utf-8-sig" else b""
    codec = "utf-8" if bom else encoding

    def run(batches):
        now, inside, begun, first, held, out = None, False, False, False, [], []

        def put(kind):
            text = b"\n".join(held).decode(codec)
            out.append((*now, kind, first, text))

        for block, lines in _blocks(batches):
            if block != now:
                if now and held:
                    put(TAIL if not begun else MIDDLE)
                now, held, inside = block, [], block in opened
                begun = inside  # the lines held belong to a record of a split before
                first = block[1] == 0
            for line in lines:
                if first and not held and bom and line.startswith(bom):
                    line = line[len(bom):]
                held.append(line)
                inside = inside_after(line, sep, inside)
                if not inside:
                    put(HEAD if begun else WHOLE)
                    held, begun, first = [], False, False
            if out:
                yield _rows(out)
                out = []
        if now and held:
            put(TAIL if not begun else MIDDLE)
        if out:
            yield _rows(out)
    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "start", "kind", "first", "value"])


def split_states(maps: DataFrame) -> DataFrame:
    """(file, start, inside): the state at each split's start, the maps before it composed.

    A map is constant, keeps the state or turns it over: the state is that of the last constant
    map, turned over as often as maps after it do.  A file has one row per split."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("from_outside") == F.col("from_inside")
    turns = F.coalesce(F.sum(F.when(~constant & F.col("from_outside"), 1).otherwise(0)).over(before), F.lit(0))
    up_to = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.when(~constant & F.col("from_outside"), 1).otherwise(0)).over(up_to)
    last = F.last(F.when(constant, F.struct(F.col("from_outside").cast("int").alias("state"), F.col("total").alias("total"))),
                  ignorenulls=True).over(before)
    marked = maps.withColumn("total", total).withColumn("turns", turns).withColumn("last", last)
    since = F.col("turns") - F.coalesce(F.col("last.total"), F.lit(0))
    return marked.select("file", "start", ((F.coalesce(F.col("last.state"), F.lit(0)) + since) % 2 == 1).alias("inside"))


def quoted_records(spark: SparkSession, path: str, encoding: str, sep: str) -> DataFrame:
    """(file, start, kind, first, value): the records of a CSV source and the pieces of those
    that cross splits, for ``joined_records``; ``first`` marks each file's first record.

    Files are split as text files are.  An open quote at a file's end closes there.  The
    splits that start inside a quoted field (one number each, per split of the input) go to
    the tasks of the second pass.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    delimiter = sep.encode()
    maps = lines.mapInArrow(_split_maps(delimiter), "file string, start bigint, from_outside boolean, from_inside boolean")
    opened = {(r["file"], r["start"]) for r in split_states(maps).where("inside").collect()}
    return lines.mapInArrow(_records(delimiter, encoding, opened), "file string, start bigint, kind int, first boolean, value string")


def joined_records(parts: DataFrame) -> DataFrame:
    """Whole records of ``quoted_records``' parts: pieces are joined in their files' order."""
    pieces = parts.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind")
    opening = F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(order)
    put_together = (pieces.withColumn("opening", opening).groupBy("file", "opening")
                    .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("pieces"))
                    .select("file", F.col("opening").alias("start"), "first",
                            F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value")))
    whole = parts.where(F.col("kind") == WHOLE).select("file", "start", "first", "value").unionByName(put_together)
    return whole.withColumn("value", F.regexp_replace("value", "\r$", "")).where("first OR trim(value) <> ''")
