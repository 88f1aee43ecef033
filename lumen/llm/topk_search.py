"""Exact top-k inner products, block at a time.

Vectors are ordered by coarse cluster and id and cut into blocks (document ranges).  A
block keeps its vectors (the forward index) and the greatest and least value of each
component.  For a query, the sum of what each component can contribute at most bounds
every score of the block.  Blocks are taken in the order of these bounds: first the
query's own block and those of the greatest bounds, which give each query a k-th score,
then all others whose bound reaches it.  Blocks whose bound falls below the k-th score
hold nothing and are never read.

Queries travel in groups, those of one block together; pairs of a query group and a block
are joined by equality on ids, never crossed row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumen.llm.store import materialize

BLOCK_ROWS = 1024
CHUNK_BLOCKS = 256
FIRST_BLOCKS = 3
CLUSTERS = 64
SAMPLE_ROWS = 4000
MERGE_SALTS = 16
NO_ID = np.iinfo(np.int64).max
NONE = -np.inf


def _bytes(x: np.ndarray) -> bytes:
    """Integers in 4 or 8 bytes each; the first byte says which."""
    small = not x.size or (x.min() >= -(1 << 31) and x.max() < 1 << 31)
    return (b"4" + x.astype("<i4").tobytes()) if small else (b"8" + x.astype("<i8").tobytes())


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4" if data[:1] == b"4" else "<i8", offset=1).astype(np.int64)


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return _ints(data).reshape(rows, -1)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``a`` and ``b``; missing components are 0."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * d
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


# -- blocks ------------------------------------------------------------------------------

BLOCKS = "block bigint, n int, ids binary, vectors binary, high binary, low binary, n_queries int"


def _vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v array<bigint>) of the vectors that take part."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return vectors.where(x.isNotNull() & whole).select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def _centres(rows: DataFrame) -> np.ndarray:
    """Coarse centres from a bounded sample; they only order the blocks, any do."""
    n = rows.count()
    draw = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = [r["v"] for r in rows.where(draw < min(1.0, SAMPLE_ROWS / max(n, 1))).orderBy("id").limit(2 * SAMPLE_ROWS).collect()]
    dims = max(map(len, found), default=0)
    x = np.array([v + [0] * (dims - len(v)) for v in found], dtype=np.float64).reshape(len(found), dims)
    centres = x[np.linspace(0, len(x) - 1, min(CLUSTERS, len(x))).astype(int)] if len(x) else x
    for _ in range(8):
        if not len(centres):
            break
        near = _nearest(x, centres)
        centres = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)


def _with_cluster(centres: np.ndarray):
    dims = centres.shape[1] if centres.ndim == 2 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").to_pylist()
            x = np.array([(v + [0] * dims)[:dims] for v in rows], dtype=np.float64).reshape(len(rows), dims)
            near = _nearest(x, centres) if dims and len(centres) and len(x) else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.astype(np.int32)), batch.column("id"), batch.column("v")], ["cluster", "id", "v"])
    return run


def _pack_blocks(query_step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        rows: list[list[int]] = []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            rows += batch.column("v").to_pylist()
            while len(ids) >= BLOCK_ROWS:
                yield _block(base + made, ids[:BLOCK_ROWS], rows[:BLOCK_ROWS], query_step)
                ids, rows, made = ids[BLOCK_ROWS:], rows[BLOCK_ROWS:], made + 1
        if ids:
            yield _block(base + made, ids, rows, query_step)
    return run


def _block(number: int, ids: list[int], rows: list[list[int]], query_step: int) -> pa.RecordBatch:
    dims = max(map(len, rows))
    x = np.array([v + [0] * (dims - len(v)) for v in rows], dtype=np.int64).reshape(len(rows), dims)
    own = np.array(ids, dtype=np.int64)
    return _record([(number, len(ids), _bytes(own), _bytes(x), _bytes(x.max(axis=0)), _bytes(x.min(axis=0)),
                     int(_is_query(own, query_step).sum()))], BLOCKS)


def _is_query(ids: np.ndarray, step: int) -> np.ndarray:
    return (ids != NO_ID) & (ids % step == 0)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


# -- the best so far of a query group ----------------------------------------------------

FOUND = "grp bigint, salt int, query binary, ids binary, scores binary"


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest scores of each query, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return query[keep], ids[keep], scores[keep]


def _top(scores: np.ndarray, ids: np.ndarray, at_least: np.ndarray, k: int, skip: np.ndarray | None = None):
    """(query, id, score) of each row's k best scores that reach the row's least score."""
    ok = scores >= at_least[:, None]
    if skip is not None:
        ok[np.arange(len(scores)), skip] = False
    if scores.shape[1] > 4 * k:  # nothing below a row's k-th greatest can be among its best
        shown = np.where(ok, scores.astype(np.float64), NONE)
        cut = np.partition(shown, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        ok &= shown >= cut[:, None]
    query, col = np.nonzero(ok)
    return _best(query, ids[col], scores[query, col], k)


STATE = "grp bigint, n int, query_ids binary, query_vectors binary, kth binary, query binary, ids binary, scores binary"


def _kth(n: int, query: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score so far, or minus infinity with fewer."""
    count = np.bincount(query, minlength=n)
    out = np.full(n, NONE)
    if len(query):
        last = np.cumsum(count) - 1
        full = count >= k
        out[full] = scores[last[full]]
    return out


def _seeds(k: int, step: int):
    """A query group from each block: its queries scored against their own block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = _ints(r["ids"]), _matrix(r["vectors"], r["n"])
                at = np.flatnonzero(_is_query(ids, step))
                found = _top(_dot(x[at], x), ids, np.full(len(at), NONE), k, at)
                yield _record([_state(r["block"], ids[at], x[at], found, k)], STATE)
    return run


def _state(grp: int, query_ids: np.ndarray, vectors: np.ndarray, found: tuple, k: int) -> tuple:
    query, ids, scores = found
    return (grp, len(query_ids), _bytes(query_ids), _bytes(vectors), _kth(len(query_ids), query, scores, k).astype("<f8").tobytes(),
            _bytes(query), _bytes(ids), _bytes(scores))


PAIRS = "grp bigint, block bigint, best double, queries binary, bounds binary"


def _pairs(state_and_summaries: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks whose bound reaches the k-th score of a query of the group."""
    for batch in state_and_summaries:
        for r in batch.to_pylist():
            q, kth = _matrix(r["query_vectors"], r["n"]), np.frombuffer(r["kth"], "<f8")
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            out = []
            for s in r["blocks"]:
                if s["block"] == r["grp"]:
                    continue
                bound = (_dot(up, _ints(s["high"])[None, :]) + _dot(down, _ints(s["low"])[None, :]))[:, 0]
                reach = np.flatnonzero(bound >= kth)
                if len(reach):
                    out.append((r["grp"], s["block"], float(bound[reach].max()), _bytes(reach), _bytes(bound[reach])))
            if out:
                yield _record(out, PAIRS)


def _score(k: int):
    """Rows of (pair, query group, block) → what the block adds to the group's queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kth, queries = np.frombuffer(r["kth"], "<f8"), _ints(r["queries"])
                queries = queries[_ints(r["bounds"]) >= kth[queries]]
                if not len(queries):
                    continue
                q, x = _matrix(r["query_vectors"], r["grp_n"])[queries], _matrix(r["vectors"], r["n"])
                query, ids, scores = _top(_dot(q, x), _ints(r["block_ids"]), kth[queries], k)
                if len(query):
                    yield _record([(r["grp"], int(r["block"] % MERGE_SALTS), _bytes(queries[query]), _bytes(ids), _bytes(scores))], FOUND)
    return run


def _collected(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.zeros(0, np.int64), *[_ints(x) for x in table.column(c).to_pylist() if x]])
                 for c in ("query", "ids", "scores"))


def _merge_some(k: int):
    def run(table: pa.Table) -> pa.Table:
        query, ids, scores = _best(*_collected(table), k)
        grp, salt = table.column("grp")[0].as_py(), table.column("salt")[0].as_py()
        return pa.Table.from_batches([_record([(grp, salt, _bytes(query), _bytes(ids), _bytes(scores))], FOUND)])
    return run


def _merge_into(k: int):
    """State and findings of one group → its new state."""
    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        r = state.to_pylist()[0]
        best = _best(*(np.concatenate(p) for p in zip(_collected(state), _collected(found))), k)
        return pa.Table.from_batches([_record([_state(r["grp"], _ints(r["query_ids"]), _matrix(r["query_vectors"], r["n"]), best, k)], STATE)])
    return run


RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            names = _ints(r["query_ids"])
            query, ids, scores = _ints(r["query"]), _ints(r["ids"]), _ints(r["scores"])
            count = np.bincount(query, minlength=len(names))
            rank = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[query]), pa.array(rank.astype(np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)],
                [c.split()[0] for c in RESULT.split(", ")])


def top_k(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: float = 64.0, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is divisible by
    ``query_step``, candidates all rows but the query's own (another row of the same id is
    one).  Ties go to the smaller id, a null id last; with fewer than k candidates all are
    given.  Null vectors and those with null or non-finite components take no part; a
    shorter vector's missing components are 0.  An empty table gives an empty result.
    """
    rows = _vectors(vectors, id_col, vec_col, scale)
    placed = rows.mapInArrow(_with_cluster(_centres(rows)), "cluster int, id bigint, v array<bigint>")
    blocks = materialize(placed.repartitionByRange("cluster", "id").sortWithinPartitions("cluster", "id")
                         .mapInArrow(_pack_blocks(query_step), BLOCKS), "vector-blocks")
    chunks = max(1, math.ceil(blocks.count() / CHUNK_BLOCKS))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    # a chunk holds the bounds of some hundred blocks
    summaries = blocks.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("block", "high", "low")).alias("blocks"))
    state = materialize(blocks.where("n_queries > 0").select("block", "n", "ids", "vectors")
                        .mapInArrow(_seeds(k, query_step), STATE), "top-k-seeds")
    asked = state.select("grp", "n", "query_vectors", "kth", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    pairs = asked.join(summaries, "chunk").select("grp", "n", "query_vectors", "kth", "blocks").mapInArrow(_pairs, PAIRS)
    ranked = materialize(pairs.withColumn("place", F.row_number().over(
        Window.partitionBy("grp").orderBy(F.col("best").desc(), "block"))), "top-k-pairs")
    forward = blocks.select("block", "n", F.col("ids").alias("block_ids"), "vectors")
    for wave in (F.col("place") <= FIRST_BLOCKS, F.col("place") > FIRST_BLOCKS):
        group = state.select("grp", F.col("n").alias("grp_n"), "query_vectors", "kth")
        work = ranked.where(wave).drop("place", "best").join(group, "grp").join(forward, "block")
        found = (work.mapInArrow(_score(k), FOUND).groupBy("grp", "salt").applyInArrow(_merge_some(k), FOUND))
        state = materialize(state.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_merge_into(k), STATE), "top-k-state")
    return state.mapInArrow(_results, RESULT)
