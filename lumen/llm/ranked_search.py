"""Ranked lexical search with the Best Position Algorithm.

Every block of documents holds, per query term, its postings ordered by impact.  A query
reads its terms' lists from the top, side by side; each document met is looked up in all
other lists by direct access, which gives its whole score and its place in every list.  A
list's best position is the end of the unbroken run of places met by either way, so the sum
of the impacts there bounds every document not met, and falls faster than the impacts last
read.  A query stops in a block as soon as that bound is strictly below its k-th score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.llm.store import materialize
from lumen.llm.texts import bounded_batches, byte_texts, slices, starts_of

K = 20
BLOCK_BYTES = 16 << 20
"""Texts of one block of the index (a longer text is a block alone)."""
QUERY_BYTES = 4 << 20
"""Queries are answered in groups of about this much text, each with an index of its terms."""
SEED_BLOCKS = 4
"""Blocks searched first for a lower bound of every query's k-th score (speed only)."""
STEP = 64

_TO_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes above ASCII, only A-Z lower-cased."""
    return text.lower().translate(_TO_TERMS).split() if text else []


# ---- the index: postings of the queries' terms, by blocks of documents ----

INDEX = ("block bigint, doc_ids array<{kind}>, sizes binary, terms array<int>, dfs array<bigint>, docs binary, tfs binary, "
         "n_docs bigint, n_terms bigint")


def _index(vocabulary: dict[bytes, int]):
    """Rows of texts → one row per block: documents' sizes, and postings by term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        ids, sizes, postings = [], [], []
        for batch in batches:
            texts = byte_texts(batch, "text")
            for a, b in slices(texts):
                weight = sum(len(t or b"") for t in texts[a:b])
                if ids and held + weight > BLOCK_BYTES:
                    yield _block((part << 33) | number, ids, sizes, postings)
                    number, held, ids, sizes, postings = number + 1, 0, [], [], []
                n, doc, term, tf = _postings(texts[a:b], vocabulary)
                postings.append((doc + sum(map(len, sizes)), term, tf))
                ids.append(batch.column(0).slice(a, b - a))
                sizes.append(n)
                held += weight
        if ids:
            yield _block((part << 33) | number, ids, sizes, postings)
    return run


def _postings(texts: list[bytes | None], vocabulary: dict[bytes, int]):
    """Sizes of the texts, and (text, term, occurrences) of the vocabulary's terms."""
    sizes, own = np.zeros(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        words = terms_of(text)
        sizes[i] = len(words)
        own.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words)))
    flat = np.concatenate(own) if own else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[flat >= 0]
    key, tf = np.unique(doc * max(1, len(vocabulary)) + flat[flat >= 0], return_counts=True)
    return sizes, key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), tf


def _block(number: int, ids: list[pa.Array], sizes: list[np.ndarray], postings: list[tuple]) -> pa.RecordBatch:
    doc, term, tf = (np.concatenate([p[i] for p in postings]) for i in range(3))
    order = np.argsort(term, kind="stable")
    doc, term, tf = doc[order], term[order], tf[order]
    terms, dfs = np.unique(term, return_counts=True)
    size = np.concatenate(sizes)
    own = pa.concat_arrays(ids)
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
        pa.array([size.tobytes()], pa.binary()), pa.array([terms], pa.list_(pa.int32())), pa.array([dfs], pa.list_(pa.int64())),
        pa.array([doc.astype(np.int32).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary()),
        pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64())],
        ["block", "doc_ids", "sizes", "terms", "dfs", "docs", "tfs", "n_docs", "n_terms"])


# ---- one block: impact lists and their search ----

class ImpactList:
    """A term's postings in a block: by impact downwards, and by document for direct access."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        order = np.argsort(-impacts, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        self.by_doc = np.argsort(self.docs)
        self.sorted_docs = self.docs[self.by_doc]

    def find(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents the list has, and their places in it."""
        at = np.minimum(np.searchsorted(self.sorted_docs, docs), len(self.docs) - 1)
        has = self.sorted_docs[at] == docs
        return has, self.by_doc[at[has]]


def best_positions(lists: list[ImpactList], weights: list[int], n_docs: int, k: int, floor: int,
                   tie: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of the k best (equal scores by ``tie``) that reach ``floor``, and
    how many documents were looked up.  Lists are read ``step`` places at a time, twice as many
    each round."""
    met = np.zeros(n_docs, dtype=bool)
    places = [np.zeros(len(x.docs) + 1, dtype=bool) for x in lists]  # the last one is never met
    best = [0] * len(lists)
    top_docs, top_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    depth, looked = 0, 0
    while True:
        new = np.unique(np.concatenate([x.docs[depth:depth + step] for x in lists]))
        new = new[~met[new]]
        met[new] = True
        looked += len(new)
        scores = np.zeros(len(new), dtype=np.int64)
        for x, w, seen in zip(lists, weights, places):
            has, at = x.find(new)
            scores[has] += w * x.impacts[at]
            seen[at] = True
        top_docs, top_scores = np.concatenate([top_docs, new]), np.concatenate([top_scores, scores])
        keep = top_scores >= max(1, floor)
        top_docs, top_scores = top_docs[keep], top_scores[keep]
        order = np.lexsort((tie[top_docs], -top_scores))[:k]
        top_docs, top_scores = top_docs[order], top_scores[order]
        bound = 0
        for i, (x, w, seen) in enumerate(zip(lists, weights, places)):
            best[i] += int(np.argmin(seen[best[i]:]))
            if best[i] < len(x.docs):
                bound += w * int(x.impacts[best[i] - 1])
        kth = int(top_scores[-1]) if len(top_scores) == k else 0
        if bound < max(kth, floor, 1):
            return top_docs, top_scores, looked
        depth, step = depth + step, step * 2


class Block:
    """A row of the index with the impacts that N and L give it."""

    def __init__(self, row: dict, n: int, total: int):
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        docs = np.frombuffer(row["docs"], dtype=np.int32).astype(np.int64)
        tfs = np.frombuffer(row["tfs"], dtype=np.int32).astype(np.int64)
        m = 100 - 25 + (25 * sizes * n) // max(1, total)
        impacts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[docs])
        dfs = np.array(row["dfs"], dtype=np.int64)
        starts = starts_of(dfs)
        self.n_docs, self.docs, self.impacts = len(sizes), docs, impacts
        self.at = {t: (int(s), int(s + d)) for t, s, d in zip(row["terms"], starts, dfs)}
        self.lists: dict[int, ImpactList] = {}

    def list_of(self, term: int) -> ImpactList:
        if term not in self.lists:
            a, b = self.at[term]
            self.lists[term] = ImpactList(self.docs[a:b], self.impacts[a:b])
        return self.lists[term]


FOUND = "item int, doc_id {kind}, score bigint, met bigint"


def _search(queries: list[dict[int, int]], n: int, total: int, k: int, floors: list[int]):
    """Rows of the index → the k best documents of every query in each of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = [[] for _ in queries]  # k best scores of the task's blocks so far
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("doc_ids")[r].values
                row = {name: batch.column(name)[r].as_py() for name in ("sizes", "terms", "dfs", "docs", "tfs")}
                block = Block(row, n, total)
                tie = np.empty(len(ids), dtype=np.int64)
                tie[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                items, docs, scores, met = [], [], [], []
                for q, weights in enumerate(queries):
                    own = [(block.list_of(t), w) for t, w in weights.items() if t in block.at]
                    if not own:
                        continue
                    floor = max(floors[q], held[q][-1] if len(held[q]) == k else 0)
                    d, s, looked = best_positions([x for x, _ in own], [w for _, w in own], block.n_docs, k, floor, tie)
                    held[q] = sorted(held[q] + s.tolist(), reverse=True)[:k]
                    items.append(np.full(len(d), q))
                    met.append(np.full(len(d), looked))
                    docs.append(d)
                    scores.append(s)
                if items:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(items), pa.int32()), ids.take(pa.array(np.concatenate(docs))),
                         pa.array(np.concatenate(scores)), pa.array(np.concatenate(met))], ["item", "doc_id", "score", "met"])
    return run


# ---- the operator ----

def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of ``items``.

    Terms are runs of ASCII letters, digits and characters above ASCII, only A-Z lower-cased.
    A term weighs floor(1000 ln((2N+2)/(2df+1))); its impact in a document is
    10^9 tf div (1000 tf + 12 m) with m = 75 + 25 n N div L; a score sums weight x impact over
    the item's terms, repeats included.  Only scores above 0 count; equal ones go by id, null
    ids last.  Null and empty texts have no term; every row is a document of its own, rows with
    equal ids too; items equal in id and text count once.  An empty table on either side, or
    none with a term, gives an empty result; other columns are ignored.

    Items reach the driver in groups of about ``QUERY_BYTES`` of text; each group's terms make
    one index over all documents, kept in the shared folder.  A group's documents that reach
    the driver are the k-th scores of ``SEED_BLOCKS`` blocks only.
    """
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    kinds = own.schema["id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    found = [_search_group(own, asked, group, k, kinds) for group in _groups(asked)]
    found = [x for x in found if x is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[1]}, rank int, {id_col} {kinds[0]}, score bigint")
    return reduce(DataFrame.unionByName, found).withColumnRenamed("doc_id", id_col)


def _groups(items: DataFrame) -> Iterator[list[tuple]]:
    group, held = [], 0
    for item, text in items.toLocalIterator():
        data = text.encode("utf-8")
        if group and held + len(data) > QUERY_BYTES:
            yield group
            group, held = [], 0
        group.append((item, Counter(terms_of(data))))
        held += len(data)
    if group:
        yield group


def _search_group(docs: DataFrame, items: DataFrame, group: list[tuple], k: int, kinds: tuple[str, str]) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for _, counts in group:
        for term in counts:
            vocabulary.setdefault(term, len(vocabulary))
    index = materialize(docs.mapInArrow(_index(vocabulary), INDEX.format(kind=kinds[0])), "impacts")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not n or not vocabulary:
        return None
    df = {r["term"]: r["df"] for r in index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))))
          .groupBy("term").agg(F.sum("df").alias("df")).collect()}  # as many rows as the group has terms
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = [{vocabulary[t]: weight[vocabulary[t]] * c for t, c in counts.items() if weight.get(vocabulary[t], 0) > 0}
               for _, counts in group]
    schema = FOUND.format(kind=kinds[0])
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def top(blocks: DataFrame, floors: list[int]) -> DataFrame:
        return (blocks.mapInArrow(_search(queries, n, total, k, floors), schema)
                .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))

    first = [r["block"] for r in index.select("block").orderBy(F.xxhash64("block")).limit(SEED_BLOCKS).collect()]
    floors = [0] * len(group)
    for r in top(index.where(F.col("block").isin(first)), floors).where(F.col("rank") == k).collect():
        floors[r["item"]] = r["score"]
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"item int, item_id {kinds[1]}")
    return top(index, floors).join(names, "item").select("item_id", "rank", "doc_id", "score")
