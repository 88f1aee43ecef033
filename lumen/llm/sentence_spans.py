"""Substring removal by sliding sentence spans.

From every sentence of every document a run of consecutive sentences is hashed: at least
``SPAN`` of them, and as many more as it takes to reach ``MIN_WORDS`` words.  Equal runs are
joined globally, and sentences covered by any run that is not the first of its kind (in
order of id and place) are removed.  Runs that always hold that many words neither miss
passages of many short sentences nor match by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lumen.llm.store import materialize
from lumen.llm.texts import bounded_batches

SPAN = 2
MIN_WORDS = 20

# sentence ends of common scripts (fixed values)
STOPS = ".!?…。！？؟۔।"

# a sentence with its stops, or a single stop or line end between sentences
PIECES = re.compile(f"[^{STOPS}\n]+[{STOPS}]*|[{STOPS}\n]")
HAS_WORD = re.compile(rf"[^{STOPS}\x20\x09-\x0D]")


def _sentences(text: str) -> tuple[list[str], list[int], list[list[str]]]:
    """Pieces that make up the text; which of them are sentences; their words, lower-cased."""
    pieces = PIECES.findall(text)
    places = [i for i, p in enumerate(pieces) if HAS_WORD.search(p)]
    return pieces, places, [_words(pieces[i]) for i in places]


def _words(sentence: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", sentence.lower()) if w]


def _runs(words: list[list[str]], span: int, min_words: int) -> list[tuple[int, bytes]]:
    """(end, digest) of the run that starts at each sentence, as far as the text holds one; a
    text of fewer than ``span`` sentences is one run if it has the words."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    span = min(span, n)
    ends = np.maximum(np.arange(n) + span, np.searchsorted(total, total[:-1] + min_words))
    normal = [" ".join(w) for w in words]
    return [(end, xxh3_128_digest("\n".join(normal[i:end]).encode("utf-8", "surrogatepass")))
            for i, end in enumerate(ends.tolist()) if end <= n]


def _spans(span: int, min_words: int):
    """One row per document and distinct run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {d for _, d in _runs(_sentences(text)[2], span, min_words)} if text else ()
                rows += [i] * len(own)
                digests += own
            at = pa.array(rows, pa.int64())
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("hash").take(at), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["id", "hash", "h1", "h2"])
    return run


def _cut(span: int, min_words: int):
    """Documents with the digests of runs that start earlier elsewhere → what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, gone, kept = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                pieces, places, words = _sentences(text or "")
                seen = {np.array([m["h1"], m["h2"]], dtype="<i8").tobytes() for m in marks or ()}
                remove: set[int] = set()
                for i, (end, d) in enumerate(_runs(words, span, min_words)):
                    if d in seen:
                        remove.update(places[i:end])
                    else:
                        seen.add(d)  # its later places in the text are not the first
                count.append(len(places))
                gone.append(len(remove))
                kept.append("".join(p for i, p in enumerate(pieces) if i not in remove) if remove else text or "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_sentences", "n_removed", "kept"])
    return run


def remove_repeated_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """(id, n_sentences, n_removed, kept) for every row of ``docs``.

    A sentence is a run of characters other than ``STOPS`` and line ends, with the stops
    after it, that has a character besides stops and ASCII white space; runs compare by
    lower-cased words.  A run has ``span`` sentences and ``min_words`` words or more, no more
    sentences than that takes, and doesn't cross the text's end; a text of fewer sentences is
    one run if it has the words.  ``kept`` is the text without the removed sentences.  Null
    texts are empty; rows equal in id and text count as one document; documents with one id
    are ordered by their texts' hash; null ids come last.  An empty table gives an empty
    result; other columns are ignored.
    """
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                       F.xxhash64(F.col(text_col)).alias("hash"))
    kind = own.schema["id"].dataType.simpleString()
    runs = materialize(own.mapInArrow(_spans(span, min_words), f"id {kind}, hash bigint, h1 bigint, h2 bigint"), "runs")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "hash")
    firsts = (runs.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("end"))
              .where("first <> end").select("h1", "h2", "first"))
    # a run that many documents have is a skewed join key, which Spark splits
    marks = (runs.join(firsts, ["h1", "h2"]).where(order != F.col("first"))
             .groupBy("id", "hash").agg(F.collect_set(F.struct("h1", "h2")).alias("marks"))
             .select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "marks"))
    same = own["id"].eqNullSafe(F.col("of_id")) & own["hash"].eqNullSafe(F.col("of_hash"))
    return (own.join(marks, same, "left").select("id", "text", "marks")
            .mapInArrow(_cut(span, min_words), f"id {kind}, n_sentences bigint, n_removed bigint, kept string")
            .withColumnRenamed("id", id_col))
