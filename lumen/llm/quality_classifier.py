"""Quality classifier by co-training.

Two views of a document are classified apart: its *text content* (words and their shapes)
and its *page metadata* (language, source, length).  Over a few rounds each view labels the
unlabelled documents that it is most confident of, by their rank within its own pool, for
the other view to learn from.  Both
views are then calibrated on labelled documents held back, and their log odds combined to
score every document.

Fitting uses a bounded sample (``MAX_LABELLED`` labelled and ``MAX_UNLABELLED`` unlabelled
rows, chosen by a hash of the id); scoring runs over all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumen.llm.texts import WordTable, bounded_batches, byte_texts, gather, held, slices, starts_of

MAX_LABELLED = 8000
MAX_UNLABELLED = 8000
ROUNDS = 3
CONFIDENT = 0.97
EXCHANGED = 0.10
HELD_BACK = 0.2
THRESHOLD = 0.5
WORD_BITS = 15
BUCKETS = (1 << WORD_BITS) + (1 << 11)
META = 1 << 10


# -- views ---------------------------------------------------------------------------


def _shape(word: str) -> str:
    """Letters as x / X, digits as 9, other characters as they are, runs cut to two."""
    out = []
    for c in word:
        s = "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def _buckets(words: list[bytes]) -> list[np.ndarray]:
    """Hash buckets of each word: of its lower-cased form and of its shape."""
    first = np.fromiter((zlib.crc32(w.lower()) >> (32 - WORD_BITS) for w in words), np.int64, len(words))
    shape = np.fromiter(((zlib.crc32(_shape(w.decode("utf-8", "replace")).encode()) >> 21) + (1 << WORD_BITS)
                         for w in words), np.int64, len(words))
    return [np.stack([first, shape], axis=1)]


def _meta_buckets(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Hash buckets of the metadata: language, source, length in octaves (null: its own)."""
    length = "null" if n_chars is None else str(max(int(n_chars), 0).bit_length())
    return [zlib.crc32(f"{k}={v}".encode()) >> 22 for k, v in (
        ("lang", lang), ("source", source), ("length", length))]


# -- fitting ---------------------------------------------------------------------------


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class View:
    """A logistic model on weighted buckets, with its calibration (slope, offset)."""

    size: int
    weights: np.ndarray = field(default=None)
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, rows: "Rows") -> np.ndarray:
        return rows.dot(self.weights) + self.bias

    def fit(self, rows: "Rows", y: np.ndarray, rounds: int = 80, decay: float = 1e-4) -> None:
        """Full-batch AdaGrad on the log loss, classes weighted equally.

        ``y`` may lie between 0 and 1: such a row counts in both classes, by its share.
        """
        w, b = np.zeros(self.size), 0.0
        seen_w, seen_b = np.full(self.size, 1e-8), 1e-8
        good, bad = y * (0.5 / max(y.sum(), 1)), (1 - y) * (0.5 / max((1 - y).sum(), 1))
        for _ in range(rounds):
            error = _sigmoid(rows.dot(w) + b) * (good + bad) - good
            g, gb = rows.back(error, self.size) + decay * w, error.sum()
            seen_w += g * g
            seen_b += gb * gb
            w -= 0.5 * g / np.sqrt(seen_w)
            b -= 0.5 * gb / math.sqrt(seen_b)
        self.weights, self.bias = w, b

    def calibrate(self, rows: "Rows", y: np.ndarray) -> None:
        """Slope and offset of the log odds: damped Newton steps with smoothed targets."""
        raw = self.raw(rows)
        unit = float(raw.std()) or 1.0
        x = raw / unit
        up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
        t = np.where(y > 0, up, down)
        m = np.stack([x, np.ones(len(x))], axis=1)

        def loss(c):
            z = m @ c
            return float((np.logaddexp(0, z) - t * z).sum() + 5e-3 * c[0] ** 2)

        c = np.array([1.0, _logit(float(t.mean())) - x.mean()])
        for _ in range(60):
            p = _sigmoid(m @ c)
            g = m.T @ (p - t) + np.array([1e-2 * c[0], 0.0])
            h = (m * (p * (1 - p))[:, None]).T @ m + np.diag([1e-2, 1e-6])
            step, size, now = np.linalg.solve(h, g), 1.0, loss(c)
            while size > 1e-4 and loss(c - size * step) > now:
                size /= 2
            if size <= 1e-4 or abs(size * step).max() < 1e-7:
                break
            c = c - size * step
        slope, offset = float(c[0]) / unit, float(c[1])
        self.slope, self.offset = (slope, offset) if slope > 0 else (0.0, _logit(float(t.mean())))

    def log_odds(self, rows: "Rows") -> np.ndarray:
        return self.slope * self.raw(rows) + self.offset


class Rows:
    """Sparse rows: buckets and values, one after the other."""

    def __init__(self, index: np.ndarray, value: np.ndarray, counts: np.ndarray):
        self.index, self.value, self.counts = index, value, counts
        self.owner = np.repeat(np.arange(len(counts)), counts)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.index] * self.value, minlength=len(self.counts))

    def back(self, error: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=self.value * error[self.owner], minlength=size)

    def take(self, at: np.ndarray) -> "Rows":
        starts, n = starts_of(self.counts)[at], self.counts[at]
        return Rows(gather(self.index, starts, n), gather(self.value, starts, n), n)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


@dataclass
class CoTrained:
    """Both views and the log odds of a good document among the labelled ones.

    ``passed`` tells for each round how many pseudo-labels the views gave to each other.
    """

    text: View
    meta: View
    prior: float
    passed: list[dict[str, int]] = field(default_factory=list)

    def combine(self, text_odds: np.ndarray, meta_odds: np.ndarray) -> np.ndarray:
        """Probability under views that are independent given the class."""
        return _sigmoid(text_odds + meta_odds - self.prior)


def co_train(text: Rows, meta: Rows, quality: np.ndarray, held: np.ndarray, rounds: int = ROUNDS,
             confident: float = CONFIDENT, exchanged: float = EXCHANGED) -> CoTrained:
    """``quality``: 1, 0 or NaN (unlabelled); ``held``: labelled rows kept for calibration.

    In each round each view is fitted to the labels and to what the other view has labelled
    so far, calibrated, and passes on, per class, those of the unlabelled rows it hasn't
    passed yet that it is most confident of: rows that its evidence draws from the prior
    towards the class, ranked over the share ``confident`` of as many rows as the class has in
    the pool by the prior (0.97: the top 3 %), at most the share ``exchanged``.  A view that knows little has few probabilities near 0 or
    1, so a label is passed as the probability that the view gives it.  With one class only
    (or no labels) both views say nothing and the prior decides.
    """
    known = ~np.isnan(quality)
    train, back = np.flatnonzero(known & ~held), np.flatnonzero(known & held)
    pool = np.flatnonzero(~known)
    prior = _logit(float((np.nansum(quality) + 1) / (known.sum() + 2)))
    views = (View(BUCKETS), View(META))
    if len(np.unique(quality[train])) < 2 or len(np.unique(quality[back])) < 2:
        for v in views:
            v.weights, v.slope, v.offset = np.zeros(v.size), 0.0, prior
        return CoTrained(*views, prior)
    data = (text, meta)
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels that each view has got
    passed: list[dict[str, int]] = []
    for r in range(rounds + 1):
        for v, rows, extra in zip(views, data, given):
            at = np.concatenate([train, np.array(list(extra), dtype=np.int64)])
            y = np.concatenate([quality[train], np.array(list(extra.values()))])
            v.fit(rows.take(at), y)
            v.calibrate(rows.take(back), quality[back])
        if r == rounds or not len(pool):
            break
        share = float(_sigmoid(prior))
        passed.append({})
        for name, v, rows, to in zip(("text", "meta"), views, data, reversed(given)):
            odds = v.log_odds(rows.take(pool))
            fresh = ~np.isin(pool, list(to))
            for kind, lift, part in (("good", odds - prior, share), ("bad", prior - odds, 1 - share)):
                most = max(1, round(min(exchanged, 1 - confident) * part * len(pool)))
                best = np.argsort(-np.where(fresh, lift, -np.inf), kind="stable")[:most]
                best = best[fresh[best] & (lift[best] > 0)]
                to.update(zip(pool[best].tolist(), _sigmoid(odds[best]).tolist()))
                passed[r][f"{name}_{kind}"] = len(best)
    return CoTrained(*views, prior, passed)


# -- in Spark --------------------------------------------------------------------------


def _share(id_col: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _columns(text_col, lang_col, source_col, chars_col) -> list[Column]:
    def named(c, kind):
        return F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    return [named(text_col, "string").alias("text"), named(lang_col, "string").alias("lang"),
            named(source_col, "string").alias("source"), named(chars_col, "bigint").alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text",
          lang_col: str | None = "lang", source_col: str | None = "source", chars_col: str | None = "n_chars",
          max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, **co) -> CoTrained:
    """Fit on about ``max_labelled`` labelled and ``max_unlabelled`` unlabelled documents.

    A document counts as good if all its non-null labels are 1.  Labels of documents that
    aren't there, null ids and null labels teach nothing; with no labels of both classes
    the model says its prior everywhere.
    """
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("label_id")).agg((F.min(label_col) >= 1).cast("double").alias("quality")))
    n_labels = marks.count()
    chosen = marks.where(_share(F.col("label_id"), 8) < min(1.0, max_labelled / max(n_labels, 1)))
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), *_columns(text_col, lang_col, source_col, chars_col))
    part = min(1.0, max_unlabelled / max(docs.count(), 1))
    # the chosen labels number about max_labelled whatever the input, so they are broadcast
    sample = (own.join(F.broadcast(chosen), F.col("id") == F.col("label_id"), "left")
              .where(F.col("quality").isNotNull() | (_share(F.col("id"), 9) < part)))
    # an unlabelled row of the pool may be a labelled one that wasn't chosen; its label stays unseen
    rows = sample.select("id", "text", "lang", "source", "n_chars", "quality").mapInArrow(
        _featured, "draw bigint, quality double, bucket binary, value binary, meta binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["quality"] is None, r["bucket"], r["value"]))
    index = [np.frombuffer(r["bucket"], "<i4").astype(np.int64) for r in rows]
    value = [np.frombuffer(r["value"], "<f4").astype(np.float64) for r in rows]
    metas = [np.frombuffer(r["meta"], "<i4").astype(np.int64) for r in rows]
    text = Rows(*_joined(index, value))
    meta = Rows(*_joined(metas, [np.ones(len(m)) for m in metas]))
    quality = np.array([np.nan if r["quality"] is None else r["quality"] for r in rows], dtype=np.float64)
    held = np.array([(r["draw"] >> 8) % 1000 < 1000 * HELD_BACK for r in rows], dtype=bool)
    return co_train(text, meta, quality, held, **co)


def _joined(index: list, value: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in index], dtype=np.int64)
    none_i, none_v = np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([none_i, *index]), np.concatenate([none_v, *value]), counts


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sample as buckets with their shares of the words, and metadata buckets."""
    table = WordTable(_buckets)
    for batch in batches:
        texts = byte_texts(batch, "text")
        meta = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))))
        ids, quality = batch.column("id").to_pylist(), batch.column("quality").to_pylist()
        out = []
        for a, b in slices(texts):
            rows, counts = table.number(texts[a:b])
            words = table.features[0][rows] if table.features else np.zeros((0, 2), np.int64)
            for i, s, n in zip(range(a, b), starts_of(counts).tolist(), counts.tolist()):
                bucket, times = np.unique(words[s:s + n], return_counts=True)
                out.append((zlib.crc32(str(ids[i]).encode()), quality[i], bucket.astype("<i4").tobytes(),
                            (SCALE * times / max(n, 1)).astype("<f4").tobytes(),
                            np.array(_meta_buckets(*meta[i]), dtype="<i4").tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.float64(), *[pa.binary()] * 3))],
                ["draw", "quality", "bucket", "value", "meta"])


SCALE = 8.0
"""Words' shares are scaled by this, so that weights of common size tell texts apart."""


VERDICT = "text_score double, meta_score double, score double, kept boolean"


def _verdict(docs: DataFrame, model: CoTrained, threshold: float):
    """Arrow function of (text, lang, source, n_chars) with the fields of ``VERDICT``."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)  # two weight vectors of fixed size

    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        model = shared.value
        table = _table()
        texts = text.cast(pa.large_binary()).to_pylist()
        content = np.zeros(len(texts))
        for a, b in slices(texts):
            rows, counts = table.number(texts[a:b])
            if len(rows):
                weight = model.text.weights[table.features[0]].sum(axis=1)
                content[a:b] = np.array([weight[rows[s:s + n]].sum() for s, n in zip(starts_of(counts).tolist(), counts.tolist())])
                content[a:b] *= SCALE / np.maximum(counts, 1)
        odds = model.text.slope * (content + model.text.bias) + model.text.offset
        about = [_meta_buckets(*m) for m in zip(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())]
        page = model.meta.weights[np.array(about, dtype=np.int64).reshape(-1, 3)].sum(axis=1)
        page_odds = model.meta.slope * (page + model.meta.bias) + model.meta.offset
        score = model.combine(odds, page_odds)
        return pa.StructArray.from_arrays(
            [pa.array(_sigmoid(odds)), pa.array(_sigmoid(page_odds)), pa.array(score), pa.array(score >= threshold)],
            ["text_score", "meta_score", "score", "kept"])

    run.__annotations__ = {"text": pa.Array, "lang": pa.Array, "source": pa.Array, "n_chars": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, VERDICT)


def _table() -> WordTable:
    """One per worker process: words' buckets don't depend on the model."""
    return held("buckets", lambda: WordTable(_buckets))


def classify(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str | None = "lang", source_col: str | None = "source", chars_col: str | None = "n_chars",
             threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_score, meta_score, score, kept) for every row of ``docs``.

    The scores are probabilities that the document is good: by either view and combined;
    ``kept`` says whether the combined one reaches ``threshold``.  A null or blank text
    gives the text view's score of no words; null metadata are values of their own;
    repeated rows are scored each; an empty table gives an empty result.
    """
    verdict = _verdict(docs, model, threshold)
    own = _columns(text_col, lang_col, source_col, chars_col)
    return docs.select(F.col(id_col), verdict(*own).alias("verdict")).select(id_col, "verdict.*")


def keep_good(docs: DataFrame, model: CoTrained, text_col: str = "text", lang_col: str | None = "lang",
              source_col: str | None = "source", chars_col: str | None = "n_chars",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, all columns as they are."""
    verdict = _verdict(docs, model, threshold)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored = docs.select(row, verdict(*_columns(text_col, lang_col, source_col, chars_col)).alias("verdict"))
    return scored.where("verdict.kept").select("row.*")
