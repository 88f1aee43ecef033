"""What the files of a JSON source are: JSON Lines, or one document each.

One pass over all lines classifies them and counts how each split changes the depth of
brackets (a JSON string holds no raw line end, so every line can be read alone).  For
files that aren't JSON Lines, a second pass starts each split at its true depth and counts the
values at the top: a document is exactly one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.session import ship_package
from lumen.sources.records import _blocks

_STRING = re.compile(rb'"(?:[^"\\]|\\.)*"')
_TOKEN = re.compile(rb"[\[{]|[\]}]|[^\s\[\]{},:]+")
_BOM = b"\xef\xbb\xbf"


def line_kind(line: bytes) -> str:
    """``object``, ``list`` (of objects), ``bad`` or, for a blank line, the empty string."""
    if not line.strip():
        return ""
    try:
        value = json.loads(line)
    except ValueError:
        return "bad"
    if isinstance(value, dict):
        return "object"
    return "list" if isinstance(value, list) and all(isinstance(x, dict) for x in value) else "bad"


def top_values(line: bytes, depth: int) -> tuple[int, int, bool]:
    """Values that begin at depth 0 in a line that starts at ``depth``, the depth after it, and
    whether the depth fell below 0."""
    begun, below = 0, False
    for token in _TOKEN.findall(_STRING.sub(b"s", line)):
        if token in b"[{":
            begun += depth == 0
            depth += 1
        elif token in b"]}":
            depth -= 1
            below |= depth < 0
        else:
            begun += depth == 0
    return begun, depth, below


def _clean(line: bytes, start: int, first: bool) -> bytes:
    return line[len(_BOM):] if first and start == 0 and line.startswith(_BOM) else line


def _line_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and batch: lines of each kind, the change of depth, the first character."""
    now, first = None, False
    for batch in batches:
        rows = []
        for block, lines in _blocks([batch]):
            first, now = block != now, block
            kinds, change, opens = {"object": 0, "list": 0, "bad": 0, "": 0}, 0, None
            for line in lines:
                line, first = _clean(line, block[1], first), False
                kinds[line_kind(line)] += 1
                change += top_values(line, 0)[1]
                opens = opens or line.strip()[:1].decode("latin-1") or None
            rows.append((*block, kinds["object"], kinds["list"], kinds["bad"], change, opens if block[1] == 0 else None))
        if rows:
            types = [pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             ["file", "start", "objects", "lists", "bad", "change", "opens"])


def _top_level(depths: dict[tuple[str, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, depth, first = None, 0, False
        for batch in batches:
            rows = []
            for block, lines in _blocks([batch]):
                if block != now:
                    now, depth, first = block, depths.get(block, 0), True
                values, broken = 0, False
                for line in lines:
                    line, first = _clean(line, block[1], first), False
                    begun, depth, below = top_values(line, depth)
                    values, broken = values + begun, broken or below
                rows.append((block[0], values, broken))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "n", "broken"])
    return run


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                         F.col("value").cast("binary").alias("line"))


def json_files(spark: SparkSession, path: str) -> list[dict]:
    """One entry per file that isn't blank: ``file``, ``records`` (its lines), ``is_lines`` (JSON
    Lines, or a document on one line) and ``is_object`` (a document that is an object).

    A file that is neither JSON Lines nor one document raises ValueError.  A row per file,
    and a number per split of the files that aren't JSON Lines, come to the driver.
    """
    ship_package(spark)
    facts = (_lines(spark, path).mapInArrow(_line_facts, "file string, start bigint, objects bigint, lists bigint, bad bigint, change bigint, opens string")
             .groupBy("file", "start").agg(*[F.sum(c).alias(c) for c in ("objects", "lists", "bad", "change")], F.first("opens", True).alias("opens")))
    facts = facts.checkpoint()
    files = facts.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("objects", "lists", "bad", "change")], F.max("opens").alias("opens")).collect()
    files = [f for f in files if f["objects"] + f["lists"] + f["bad"]]
    documents = [f["file"] for f in files if f["bad"]]
    if documents:
        before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        starts = facts.where(F.col("file").isin(documents)).select("file", "start", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))
        depths = {(r["file"], r["start"]): r["depth"] for r in starts.collect()}
        tops = (_lines(spark, documents).mapInArrow(_top_level(depths), "file string, n bigint, broken boolean")
                .groupBy("file").agg(F.sum("n").alias("n"), F.max("broken").alias("broken")))
        changes = {f["file"]: f["change"] for f in files}
        wrong = [r["file"] for r in tops.collect() if r["n"] != 1 or r["broken"] or changes[r["file"]]]
        if wrong:
            raise ValueError(f"neither JSON Lines nor one JSON document: {min(wrong)}")
    return [{"file": f["file"], "records": f["objects"] + f["lists"] + f["bad"], "is_lines": not f["bad"],
             "is_object": f["opens"] == "{" if f["bad"] else f["objects"] == 1 and not f["lists"]} for f in files]
