"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes.  Two fingerprints that differ in at most ``max_bits`` bits
share at least ``8 - max_bits`` positional bytes (one differing bit spoils one byte), the
*guaranteed minimum*.  Each fingerprint is posted in the inverted index under positional
bytes, the shared bytes are tallied per pair, pairs below the guaranteed minimum are
dropped and the rest verified on the bits.

Postings of single bytes would hold 1/256 of all fingerprints each, so the index posts
*triples* of positions: with the eight positions split into two halves, any five shared
positions contain three of one half, and the four triples of either half give 8 postings
of 24 bits.  Inside a posting list the tally counts all eight positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.components import connected_components
from lumen.llm.store import materialize
from lumen.llm.texts import bounded_batches, byte_texts, held, slices, starts_of

SHINGLE_WORDS = 3
MAX_BITS = 3
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
LIST_ROWS = 8192
"""Posting lists beyond this many fingerprints are dealt out as pairs of blocks."""


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fingerprint long) of every row; see :func:`simhash_groups` for the rules."""
    from xxhash import xxh64_intdigest as digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for batch in batches:
            texts = byte_texts(batch, "text")
            out = np.zeros(len(texts), dtype=np.uint64)
            for a, b in slices(texts):
                hashes: list[int] = []
                counts = np.zeros(b - a, dtype=np.int64)
                for i in range(a, b):
                    words = texts[i].lower().split() if texts[i] else []
                    if not words:
                        continue
                    joined = b" ".join(words)
                    n = len(words) - shingle_words + 1
                    if n <= 1:
                        hashes.append(digest(joined, 42))
                        counts[i - a] = 1
                        continue
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    begins = [0, *ends[:n - 1].tolist()]
                    hashes += [digest(joined[s:e], 42) for s, e in zip(begins, (ends[shingle_words - 1:] - 1).tolist())]
                    counts[i - a] = n
                out[a:b] = _majority(np.array(hashes, dtype=np.uint64), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    ids = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(run, f"id {kind}, fp bigint").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of hashes: the bits set in over half of them (an empty group: 0)."""
    out = np.zeros(len(counts), dtype=np.uint64)
    step = 1 << 18
    for i, (s, n) in enumerate(zip(starts_of(counts).tolist(), counts.tolist())):
        if n:
            ones = np.zeros(64, dtype=np.int64)
            for a in range(s, s + n, step):
                own = hashes[a:min(a + step, s + n)].astype(">u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > n).view(">u8")[0]
    return out


def _posting_keys(fp: Column) -> Column:
    """The eight (triple, bytes) postings of a fingerprint, as longs."""
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for n, triple in enumerate(TRIPLES):
        key = F.lit(n).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    return F.explode(F.array(*keys))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (column ``fp``) → edges (src, dst) whose components are those
    of all pairs differing in at most ``max_bits`` bits.

    Each posting list yields a spanning forest of its verified pairs (at most one edge per
    fingerprint), never the pairs themselves.  A list beyond ``LIST_ROWS`` fingerprints is
    cut into hashed blocks and dealt out as block pairs, so no task holds more than two
    blocks and every pair of the list still meets once.
    """
    if max_bits > 3:
        raise ValueError("triples of positions guarantee a meeting up to 3 differing bits")
    posted = nodes.select("fp", _posting_keys(F.col("fp")).alias("key"))
    sizes = posted.groupBy("key").count().where(F.col("count") > LIST_ROWS)
    blocks = sizes.select("key", F.ceil(F.col("count") / F.lit(LIST_ROWS // 2)).cast("int").alias("n"))
    dealt = posted.join(blocks, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                    lambda j: F.least(own, j).cast("long") * F.col("n") + F.greatest(own, j)))
    rows = dealt.select("fp", "key", F.explode(pairs).alias("part"))
    return (rows.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
            .mapInArrow(_forests(max_bits), "src bigint, dst bigint").distinct())


def _forests(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = np.zeros(0, np.uint64)
        open_at = None
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            runs = np.concatenate([[0], cut, [len(fps)]])
            src, dst = [], []
            first = (int(key[0]), int(part[0]))
            if open_at is not None and open_at != first:
                _forest(open_run, max_bits, src, dst)
                open_run = np.zeros(0, np.uint64)
            sizes = np.diff(runs)
            for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0)).tolist():
                if k == len(sizes) - 1:
                    continue
                group = fps[runs[k]:runs[k + 1]]
                if k == 0 and len(open_run):
                    group = np.concatenate([open_run, group])
                _forest(group, max_bits, src, dst)
            last = fps[runs[-2]:]
            open_run = np.concatenate([open_run, last]) if len(sizes) == 1 else last
            open_at = (int(key[-1]), int(part[-1]))
            if src:
                yield _edges(src, dst)
        src, dst = [], []
        _forest(open_run, max_bits, src, dst)
        if src:
            yield _edges(src, dst)
    return run


def _edges(src: list, dst: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(src).view(np.int64)), pa.array(np.concatenate(dst).view(np.int64))], ["src", "dst"])


def _forest(fps: np.ndarray, max_bits: int, src: list, dst: list) -> None:
    """Breadth-first search over one posting list: tally shared bytes, drop the pairs under
    the guaranteed minimum, verify the bits, add one edge per fingerprint reached."""
    if len(fps) < 2:
        return
    least = 8 - max_bits
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            diff = rest ^ at
            shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = np.flatnonzero(shared >= least)
            near = near[np.bitwise_count(diff[near]) <= max_bits]
            if len(near):
                found = rest[near]
                src.append(np.full(len(found), at, dtype=np.uint64))
                dst.append(found)
                queue.extend(found)
                rest = np.delete(rest, near)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint long, component_id) for every row of ``docs``.

    Texts are lower-cased in A-Z only and cut into words of non-white-space; every
    ``shingle_words``-word shingle (repeats included, space-joined) is hashed with XXH64
    (seed 42), a bit is set if over half the hashes have it.  Fewer words: one shingle of
    all of them; null, empty or blank text: fingerprint 0, linked like any other.
    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is the
    smallest id in the component.  Repeated ids keep all their rows.  A null id never
    names a component (a component of null ids alone has a null ``component_id``).  An
    empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    nodes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("least"))
    roots = connected_components(links(nodes.select("fp"), max_bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(classes, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(labels, "fingerprint").select(id_col, "fingerprint", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one row left of each near-duplicate component.

    The row with the smallest id stays; among rows that repeat that id the one whose other
    columns sort first (null before any value).  Rows with a null id are kept, as nothing
    tells them apart from the row that stays.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle_words, max_bits)
    stay = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    rest = [c for c in docs.columns if c != id_col]
    one = (docs.join(stay, id_col, "left_semi").groupBy(id_col)
           .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("row")))
    return (one.select(id_col, "row.*").select(*[F.col(f"`{c}`") for c in docs.columns])
            .unionByName(docs.where(F.col(id_col).isNull())))
