"""Language identification, word first with backing off to character n-grams.

Words known from training score by their log frequency in each language; an unseen word is
scored by the longest character n-grams that training knows, of ever shorter length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.store import materialize
from lumen.llm.texts import WordTable, bounded_batches, byte_texts, held, slices, sums_by_group

SAMPLE_PER_LANG = 4000
SAMPLE_BYTES_PER_LANG = 32 << 20
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
FIXED = 1 << 20
"""Scores are added as integers of this many parts of a nat, so sums don't depend on order."""

_CUT = regex.compile(r"\p{L}[\p{L}\p{M}]*|\n")


def _grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its borders (single letters without them)."""
    if n == 1:
        return list(word)
    edged = f" {word} "
    return [edged[i:i + n] for i in range(len(edged) - n + 1)]


def _keys(terms: list[str], kind: int) -> np.ndarray:
    """64-bit names of words (kind 0) or of n-grams (kind: their length)."""
    return np.fromiter((xxhash.xxh64_intdigest(t, kind) for t in terms), np.uint64, len(terms)).view(np.int64)


@dataclass
class LanguageModel:
    """Log frequencies (in ``1 / FIXED`` nats) of known words and n-grams per language: a
    row of ``scores`` per entry of the sorted ``keys``."""

    languages: list[str]
    keys: np.ndarray
    scores: np.ndarray
    unseen: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``scores``, -1 for an unknown key."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        order = np.argsort(keys)
        at = np.empty(len(keys), dtype=np.int64)
        at[order] = np.searchsorted(self.keys, keys[order])
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)

    def knows(self, word: str) -> bool:
        return bool(self.find(_keys([word], 0))[0] >= 0)

    def score_words(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per language."""
        out = np.tile(self.unseen, (len(words), 1))
        row = self.find(_keys(words, 0))
        out[row >= 0] = self.scores[row[row >= 0]]
        rest = np.flatnonzero(row < 0)
        for order in ORDERS:
            if not len(rest):
                break
            grams = [_grams(words[i], order) for i in rest.tolist()]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            row = self.find(_keys([g for own in grams for g in own], order))
            known = sums_by_group((row >= 0).astype(np.int64), sizes)
            total = sums_by_group(self.scores[row[row >= 0]].astype(np.int64), known)
            hit = known > 0
            out[rest[hit]] = total[hit] // known[hit, None]
            rest = rest[~hit]
        return out


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          sample_per_lang: int = SAMPLE_PER_LANG, sample_bytes: int = SAMPLE_BYTES_PER_LANG) -> LanguageModel:
    """Fit on a bounded sample of labelled rows.

    Of each language, rows are taken by a hash of the id: about ``sample_per_lang`` of them
    and about ``sample_bytes`` of text, whichever is less (all of a rarer language).  Spark
    counts their words and n-grams per language; every one of them enters the model, which
    is bounded by the sample alone, so no language's terms push out another's.  Terms are
    held by 64-bit hashes.  Rows with a null language or text teach nothing.
    """
    labelled = bounded_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    share = {r["lang"]: min(1.0, sample_per_lang / r["n"], sample_bytes / max(r["bytes"], 1)) for r in sizes}
    languages = sorted(share)
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.int32), np.zeros(0, np.int64))
    part = F.create_map(*[F.lit(x) for k in languages for x in (k, share[k])])
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < F.element_at(part, F.col("lang"))).select("lang", "text")
    counts = materialize(
        sample.mapInArrow(_count, "kind int, lang string, term bigint, n bigint")
        .groupBy("kind", "term").agg(*[
            F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i, k in enumerate(languages)]),
        "language-terms")
    return _log_frequencies(counts, languages)


def _log_frequencies(counts: DataFrame, languages: list[str]) -> LanguageModel:
    """N-grams are relative to all n-grams of their length in the language, words to all words.

    One kind of term comes to the driver at a time, as numbers.
    """
    names = [f"n{i}" for i in range(len(languages))]
    keys, scores, unseen = [], [], np.zeros(len(languages))
    for kind in (0, *sorted(ORDERS)):
        rows = counts.where(F.col("kind") == kind).select("term", *names).toArrow()
        n = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
        total = n.sum(axis=0, dtype=np.int64) + 0.5 * (len(n) + 1)
        keys.append(rows.column("term").to_numpy())
        scores.append(np.round(np.log((n + 0.5) / total) * FIXED).astype(np.int32))
        if kind == 0:
            unseen = np.log(0.5 / total)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return LanguageModel(languages, key[order], np.concatenate(scores)[order], np.round(unseen * FIXED).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and of n-grams (kind: their length) per language."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = byte_texts(batch, "text")
        for a, b in slices(texts):
            words: dict[str, Counter] = {}
            for lang, text in zip(langs[a:b], texts[a:b]):
                own = _CUT.findall(text.decode("utf-8", "replace").lower())
                words.setdefault(lang, Counter()).update(own)
            for lang, seen in words.items():
                seen.pop("\n", None)
                for kind in (0, *ORDERS):
                    terms: Counter = Counter() if kind else seen
                    if kind:
                        for w, n in seen.items():
                            for g in _grams(w, kind):
                                terms[g] += n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(terms), pa.int32()), pa.array([lang] * len(terms), pa.string()),
                         pa.array(_keys(list(terms), kind)), pa.array(list(terms.values()), pa.int64())],
                        ["kind", "lang", "term", "n"])


class _Scorer:
    """Word chunk → (scores per language, number of words with a letter)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.table = WordTable(self.learn)

    def learn(self, chunks: list[bytes]) -> list[np.ndarray]:
        found = _CUT.findall(b"\n".join(chunks).decode("utf-8", "replace").lower())
        found.append("\n")
        stop = np.flatnonzero(np.fromiter((w == "\n" for w in found), bool, len(found)))
        n = np.diff(stop, prepend=-1) - 1
        seen: dict[str, int] = {}
        row = np.fromiter((seen.setdefault(w, len(seen)) for w in found if w != "\n"), np.int64, int(n.sum()))
        scores = self.model.score_words(list(seen))
        return [sums_by_group(scores[row], n), n]


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from the text alone.

    ``lang_pred`` is the language of the greatest summed score (ties: the first in
    order), ``score`` its share of the probability under equal priors.  Null texts, texts
    without a letter, and all texts of a model without languages are ``und`` with score 0.
    Repeated rows are predicted each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _scorer(model)
        for batch in batches:
            texts = byte_texts(batch, "text")
            for a, b in slices(texts):
                rows, counts = scorer.table.number(texts[a:b])
                names = np.full(b - a, UNKNOWN, dtype=object)
                score = np.zeros(b - a)
                if model.languages and len(rows):
                    per, n = scorer.table.features
                    total = sums_by_group(per[rows], counts)
                    has = sums_by_group(n[rows], counts) > 0
                    best = total.argmax(axis=1)
                    share = 1.0 / np.exp((total - total.max(axis=1, keepdims=True)) / FIXED).sum(axis=1)
                    names[has] = np.array(model.languages, dtype=object)[best[has]]
                    score[has] = share[has]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names.tolist(), pa.string()), pa.array(score)],
                    ["id", "lang_pred", "score"])

    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _scorer(model: LanguageModel) -> _Scorer:
    """One per worker process and model (a broadcast value is one object in a worker)."""
    return held(("language", id(model)), lambda: _Scorer(model))


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
