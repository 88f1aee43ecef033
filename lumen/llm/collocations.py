"""Phrase collocations by SETM.

The occurrence relation of length k holds, in order of place, where a frequent phrase of k
words starts.  It is persisted in blocks of whole pieces.  A length is extended by a merge
join of the relation with itself at adjacent places of a piece: two frequent phrases that
overlap in all but their ends make one of k + 1 words.  The joined occurrences are counted
by group over all blocks, and the relation is semi-joined with the frequent groups before it
is extended again.  A relation's table is removed once that of the next length is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.llm.store import discard, materialize, materialize_buckets, shuffles_removed
from lumen.llm.texts import bounded_batches, byte_texts

LEAST, LONGEST, FIRST = 100, 5, 2000
BLOCK_BYTES = 24 << 20
"""Texts of one block (a longer text is a block alone)."""
SALTS = 64

_BREAK = b"\xff"
_TO_PIECES = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)

# A group's number: its block and its place among the block's groups, in one long.
LOCAL_BITS, SEQUENCE_BITS = 30, 13


def _block_number(part: int, sequence: int) -> int:
    if sequence >> SEQUENCE_BITS or part >> (63 - LOCAL_BITS - SEQUENCE_BITS):
        raise ValueError("more blocks or tasks than a group's number can hold")
    return ((part << SEQUENCE_BITS) | sequence) << LOCAL_BITS


# ---- relations in packed form: places rise, groups are numbers within the block ----

def _pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed, after the size of the planes."""
    planes = np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd"), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


RELATION = "block bigint, lang string, places binary, local binary, keys array<binary>, counts binary"
ROWS = 1 << 16
SLICES = 3
"""Pairs are counted in so many slices, one after the other: the disk that a count's shuffle
takes is a slice's."""


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts → the relation of words, with each block's words and how often they occur."""
    part, sequence = TaskContext.get().partitionId(), 0
    held: dict[str, tuple[list[bytes], int]] = {}
    for batch in batches:
        for text, lang in zip(byte_texts(batch, "text"), batch.column("lang").to_pylist()):
            if not text:
                continue
            texts, size = held.get(lang, ([], 0))
            if texts and size + len(text) > BLOCK_BYTES:
                yield _word_block(_block_number(part, sequence), lang, texts)
                sequence, texts, size = sequence + 1, [], 0
            texts.append(text)
            held[lang] = texts, size + len(text)
    for lang, (texts, _) in held.items():
        yield _word_block(_block_number(part, sequence), lang, texts)
        sequence += 1


def _word_block(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    seen: dict[bytes, int] = {_BREAK: 0}
    parts = []
    for text in texts:
        tokens = text.lower().translate(_TO_PIECES).replace(_BREAK, b" \xff ").split()
        tokens.append(_BREAK)
        parts.append(np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int32, len(tokens)))
    flat = np.concatenate(parts)
    places = np.flatnonzero(flat)  # a break takes a place, so no neighbours span it
    counts = np.bincount(flat, minlength=len(seen))[1:]
    return _relation(number, lang, places, flat[places] - 1, counts, [_BREAK.join(list(seen)[1:])])


def _relation(number: int, lang: str, places: np.ndarray, local: np.ndarray, counts: np.ndarray, keys: list[bytes]) -> pa.RecordBatch:
    gaps, local, counts = (pa.array([_pack(x.astype(np.int32))], pa.binary()) for x in (np.diff(places, prepend=0), local, counts))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang], pa.string()), gaps, local,
                                       pa.array([keys], pa.list_(pa.binary())), counts], ["block", "lang", "places", "local", "keys", "counts"])


def _extend(blocks: pa.Table, frequent: pa.Table) -> pa.Table:
    """A block's relation, semi-joined with its frequent groups and merge-joined with itself one
    place on: the relation of phrases a word longer."""
    if not blocks.num_rows or not frequent.num_rows:
        return _no_relation()
    row = {name: blocks.column(name)[0].as_py() for name in ("block", "lang", "places", "local")}
    places, local = np.cumsum(_unpack(row["places"], np.int32), dtype=np.int64), _unpack(row["local"], np.int32)
    own = frequent.column("local").to_numpy()
    codes = frequent.column("code").to_numpy()
    rank = np.full(max(int(local.max()), int(own.max())) + 1, -1, dtype=np.int64)
    rank[own] = np.arange(len(own))
    group = rank[local]
    kept = group >= 0
    places, group = places[kept], group[kept]
    next_to = np.flatnonzero(places[1:] == places[:-1] + 1)
    if not len(next_to):
        return _no_relation()
    pair, local, counts = np.unique(group[next_to] * len(own) + group[next_to + 1], return_inverse=True, return_counts=True)
    keys = [_pack(codes), _pack((pair // len(own)).astype(np.int32)), _pack((pair % len(own)).astype(np.int32))]
    return pa.Table.from_batches([_relation(row["block"], row["lang"], places[next_to], local, counts, keys)])


def _no_relation() -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary())],
                    ["block", "lang", "places", "local", "keys", "counts"])


def _groups(words: bool, part: int = 0, parts: int = 1):
    """Rows of a relation → a row per group: a word, or the codes of a pair's phrases (those
    pairs only that a hash deals to the slice ``part`` of ``parts``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, lang, packed, counted = (batch.column(name)[r].as_py() for name in ("block", "lang", "keys", "counts"))
                counts = _unpack(counted, np.int32)
                own = np.arange(len(counts))
                if words:
                    keys = [pa.array(packed[0].split(_BREAK), pa.binary()).cast(pa.string())]
                else:
                    codes = _unpack(packed[0], np.int64)
                    first, last = (codes[_unpack(x, np.int32)] for x in packed[1:])
                    mixed = (first.astype(np.uint64) * _MIX[0] ^ last.astype(np.uint64) * _MIX[1]) >> np.uint64(33)
                    own = np.flatnonzero(mixed % np.uint64(parts) == part)
                    keys = [pa.array(first[own]), pa.array(last[own])]
                for a in range(0, len(own), ROWS):
                    place = own[a:a + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place + block), *([pa.array([lang] * len(place), pa.string())] if words else []),
                         *[k.slice(a, len(place)) for k in keys], pa.array(counts[place].astype(np.int64))],
                        ["number", *(["lang", "word"] if words else ["first", "last"]), "count"])
    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(_unpack(x, np.int32).sum()) for x in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64())], ["lang", "n"])


# ---- counting and the semi-join ----

def _frequent(relation: DataFrame, words: bool, least: int, name: str) -> DataFrame:
    """(number, code, n, lead, keys...) of the groups found ``least`` times or more in all
    blocks together.  Every group has as many rows as blocks that hold it; ``code`` is the
    number of the first of them, the row where ``lead`` is true."""
    keys = {"lang": "string", "word": "string"} if words else {"first": "bigint", "last": "bigint"}
    schema = ", ".join(["number bigint", *[f"{k} {t}" for k, t in keys.items()], "count bigint"])
    same = Window.partitionBy(*keys)
    tables = []
    for part in range(parts := 1 if words else SLICES):
        groups = relation.select("block", "lang", "keys", "counts").mapInArrow(_groups(words, part, parts), schema)
        counted = groups.select("number", *keys, F.sum("count").over(same).alias("n"), F.min("number").over(same).alias("code"))
        tables.append(materialize(counted.where(F.col("n") >= least).withColumn("lead", F.col("code") == F.col("number")), name))
    return reduce(DataFrame.union, tables)


def _phrases(lead: DataFrame, shorter: DataFrame) -> DataFrame:
    """Frequent groups with their words and the frequencies of their first and last parts."""
    head = shorter.select(F.col("code").alias("first"), "lang", F.col("words").alias("head"), F.col("from_left").alias("left"))
    tail = shorter.select(F.col("code").alias("last"), F.element_at("words", -1).alias("word"), F.col("from_right").alias("right"))
    return (lead.join(head, "first").join(tail, "last")
            .select("code", "first", "last", "lang", F.concat("head", F.array("word")).alias("words"), "n",
                    F.concat("left", F.array("n")).alias("from_left"), F.concat("right", F.array("n")).alias("from_right")))


def _lowest_cut(size: int) -> F.Column:
    """(score, k, l, r) of the lowest-scoring cut of phrases of ``size`` words, ties to small k."""
    exact = "decimal(38,0)"

    def cut(k: int) -> F.Column:
        left, right = F.col("from_left")[k - 1], F.col("from_right")[size - k - 1]
        return F.struct(
            F.expr(f"CAST(1000 AS decimal(4,0)) * CAST(n AS decimal(17,0)) * CAST(total AS decimal(17,0)) "
                   f"div CAST(CAST(from_left[{k - 1}] AS decimal(17,0)) * CAST(from_right[{size - k - 1}] AS decimal(17,0)) AS {exact})").alias("score"),
            F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(k) for k in range(1, size)]))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of every language.

    Texts, A-Z lower-cased, are split at ``. , ; : ! ?`` and line ends into pieces and those at
    spaces and tabs into words.  Candidates are phrases of 2 to ``longest`` words that occur
    ``least`` times or more within pieces of a language's texts.  A cut after k words scores
    floor(1000 a n / (l r)), n being the language's words and l, r the occurrences of both
    parts; the lowest-scoring cut counts, then the smallest k.  A candidate that lies in a
    longer one of the same frequency is dropped.  Order: score and a downwards, phrase by bytes.
    A null language is ``und``; null and empty texts hold no word; rows are texts of their own,
    equal ones too; an empty table gives an empty result; other columns are ignored.
    Products are exact below 10^17 occurrences of a phrase and words of a language.
    """
    own = bounded_batches(docs).select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    with shuffles_removed(spark):
        relation, folder = materialize_buckets(own.mapInArrow(_words, RELATION), "occurrences-1", "block")
        marks = _frequent(relation, True, least, "frequent-1")
        totals = materialize(relation.select("lang", "counts").mapInArrow(_sizes, "lang string, n bigint")
                             .groupBy("lang").agg(F.sum("n").alias("total")), "totals")
        phrases = marks.where("lead").select("code", "lang", F.array("word").alias("words"), "n", F.array("n").alias("from_left"),
                                             F.array("n").alias("from_right"))
        candidates: list[DataFrame] = []
        for size in range(2, longest + 1):
            in_block = F.shiftright("number", LOCAL_BITS)
            placed = marks.select(F.shiftleft(in_block, LOCAL_BITS).alias("block"), "code",
                                  (F.col("number") - F.shiftleft(in_block, LOCAL_BITS)).alias("local"))
            pairs = (relation.select("block", "lang", "places", "local").groupBy("block").cogroup(placed.groupBy("block"))
                     .applyInArrow(_extend, RELATION))
            done = folder
            relation, folder = materialize_buckets(pairs, f"occurrences-{size}", "block")
            discard(spark, done)
            marks = _frequent(relation, False, least, f"frequent-{size}")
            phrases = materialize(_phrases(marks.where("lead").select("code", "first", "last", "n"), phrases), f"phrases-{size}")
            candidates.append(phrases)
        discard(spark, folder)
    scored = []
    for size, own in enumerate(candidates, 2):
        if size <= longest - 1:
            longer = candidates[size - 1]
            within = (longer.select(F.col("first").alias("code"), "n").union(longer.select(F.col("last").alias("code"), "n"))
                      .groupBy("code").agg(F.max("n").alias("longer")))
            own = own.join(within, "code", "left").where("longer IS NULL OR 100 * longer < 100 * n")
        scored.append(own.join(totals, "lang").withColumn("cut", _lowest_cut(size))
                      .select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.col("cut.l").alias("l"),
                              F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's candidates are ranked in parts first, so that no task sorts them all
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    parts = (reduce(DataFrame.union, scored).withColumn("salt", salt)
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)).cast("bigint"))
             .where(F.col("rank") <= first).drop("salt", "rank"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
