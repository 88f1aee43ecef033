"""Texts inside Arrow tasks: byte views, bounded slices and a bounded table of words.

A *word* is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D), which
is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20
"""Texts are worked on in slices of about this size (a longer text is a slice alone)."""


BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
"""Arrow batches that Spark sends to the workers hold about this much at most."""


def bounded_batches(docs: DataFrame) -> DataFrame:
    """Sees to it that the session sends texts to Python in batches of bounded bytes."""
    conf = docs.sparkSession.conf
    number, unit = re.fullmatch(r"(\d+)\s*([bkmg]?)b?", conf.get(BATCH_CONF).lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return docs


def byte_texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def slices(texts: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about ``most`` bytes."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


_HELD: dict = {}


def held(owner, make: Callable | None = None):
    """What a worker process keeps between tasks for one operator (``owner`` with its
    parameters): made once, and dropped as soon as another operator's task comes, so that
    a worker that serves many stages holds one operator's tables at a time."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make() if make else None
    return _HELD[owner]


class _Seen(dict):
    """Gives every new key the next number and remembers the new keys in order."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class WordTable:
    """Word → row number, with per-word features computed once per new word.

    ``learn(words)`` gets the list of words not seen before and returns one array per
    feature (first axis: the words).  The table is emptied when it holds more than
    ``limit`` words, so a worker's memory stays bounded; results never depend on that.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[np.ndarray]], limit: int = 300_000):
        self.learn, self.limit = learn, limit
        self._clear()

    def _clear(self):
        self.seen = _Seen()
        self.parts: list[list[np.ndarray]] = []
        self.features: list[np.ndarray] = []

    def number(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words of all texts, and the number of words of each text."""
        if len(self.seen) > self.limit:
            self._clear()
        words: list[bytes] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                own = text.split()
                counts[i] = len(own)
                words += own
        rows = np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))
        if self.seen.fresh:
            new = self.learn(self.seen.fresh)
            self.seen.fresh = []
            old = self.features
            self.features = [np.concatenate([a, b]) for a, b in zip(old, new)] if old else list(new)
        return rows, counts


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive groups of the given sizes."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def sums_by_group(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups (an empty group: 0)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s:s+n]`` for the given starts and lengths."""
    total = int(lens.sum())
    shift = np.repeat(starts - starts_of(lens), lens)
    return flat[shift + np.arange(total, dtype=np.int64)]
