"""Quality rules on tokeniser fertility.

Public vocabularies are run over the words of every text: characters per token (two
vocabularies), the share of byte-fallback tokens and the entropy of the token
distribution, each held against rejection bands of the text's main script, or of its
language where a band is given for one.  Base counts (words, symbols, repeated lines and
5-word windows) come from the same pass.  ``measured_rules`` adds bands per language and
script, and per vocabulary, taken from the quartiles of the table itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumen.llm.store import materialize
from lumen.llm.texts import WordTable, bounded_batches, byte_texts, gather, held, slices, sums_by_group

WINDOW = 5
SYMBOLS = b"#*$%&|<>"

# First code point of each run of a script; code points below the first run have no script.
# Fixed values, by the Unicode blocks.
SCRIPT_RUNS = [
    (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, ""), (0x370, "greek"),
    (0x400, "cyrillic"), (0x530, ""), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""), (0x900, "indic"),
    (0xE00, "thai"), (0xE80, ""), (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"),
    (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""), (0x20000, "han"), (0x32000, ""),
]
SCRIPTS = ["", *sorted({s for _, s in SCRIPT_RUNS if s})]


@dataclass(frozen=True)
class Band:
    """Where a text of a script or language must lie to be kept.

    ``entropy`` is the least share of the greatest possible token entropy
    (``log2`` of the number of tokens), asked of texts of ``entropy_from`` tokens on.
    """

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float = 0.35
    entropy_from: int = 100


# Alphabets split into pieces of a few letters; scripts that the vocabularies hardly know
# fall back to bytes (three a character), so their bands start lower and allow bytes.
BANDS: dict[str, Band] = {
    "latin": Band((1.2, 12.0), 0.30),
    "greek": Band((0.6, 8.0), 0.60),
    "cyrillic": Band((0.8, 10.0), 0.40),
    "hebrew": Band((0.4, 6.0), 0.80),
    "arabic": Band((0.4, 6.0), 0.80),
    "indic": Band((0.3, 6.0), 0.95),
    "thai": Band((0.3, 6.0), 0.95),
    "hangul": Band((0.3, 4.0), 0.95),
    "kana": Band((0.3, 4.0), 0.90),
    "han": Band((0.3, 4.0), 0.95),
    # no letters: numbers and signs come one by one or fall back to bytes
    "": Band((1.5, 8.0), 0.5),
}

#: A measured band reaches this many interquartile ranges beyond the quartiles (the far-out
#: fences of a box plot), with the range taken as at least ``LEAST_SPREAD``.
FENCE = 3.0
#: Of the logarithm of characters per token, and of the share of byte tokens.
LEAST_SPREAD = {"chars_per_token": 0.1, "chars_per_rank_token": 0.1, "byte_share": 0.1}
#: Texts that pass the base rules which a language and script, or a script, must have for
#: quartiles of its own.
LEAST_TEXTS = 50
#: Steps of the histogram that quartiles are read from, per unit.
STEPS = 1000


def _meter(piece_path: str, rank_path: str, pattern: str) -> "_Meter":
    return held(("meter", piece_path, rank_path, pattern), lambda: _Meter(piece_path, rank_path, pattern))


class _Meter:
    """Per-word features of one worker: characters, symbols, pieces, bytes, scripts."""

    def __init__(self, piece_path: str, rank_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = np.array([self.pieces.IsByte(i) for i in range(self.pieces.get_piece_size())])
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.run_starts = np.array([0, *(a for a, _ in SCRIPT_RUNS)])
        self.run_scripts = np.array([0, *(SCRIPTS.index(s) for _, s in SCRIPT_RUNS)])
        self.flat = np.zeros(0, dtype=np.int32)
        self.table = _Words(self)

    def learn(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4")
        scripts = self.run_scripts[np.searchsorted(self.run_starts, points, side="right") - 1]
        owner = np.repeat(np.arange(len(texts)), chars)
        per_script = np.bincount(owner * len(SCRIPTS) + scripts, minlength=len(texts) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
        per_script[:, 0] = 0
        symbols = np.isin(points, np.frombuffer(SYMBOLS, np.uint8))
        n_symbols = np.bincount(owner[symbols], minlength=len(texts))
        ids = self.pieces.encode(texts, num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for own in ids for t in own), np.int32, int(n.sum()))
        n_bytes = sums_by_group(self.is_byte[flat].astype(np.int64), n)
        start = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, flat])
        ranked = np.fromiter((len(self.ranks.encode_ordinary(" " + t)) for t in texts), np.int64, len(texts))
        return [chars, n_symbols, start, n, n_bytes, ranked, per_script.argmax(axis=1), per_script.max(axis=1)]


class _Words(WordTable):
    def __init__(self, meter: _Meter):
        self.meter = meter
        super().__init__(meter.learn)

    def _clear(self):
        super()._clear()
        self.meter.flat = np.zeros(0, dtype=np.int32)


def repeated_words(rows: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text: words in windows of ``window`` words found twice or more in the text."""
    n = len(rows)
    if n < window:
        return np.zeros(len(counts), dtype=np.int64)
    mixer = np.random.default_rng(5).integers(1, 1 << 63, size=window + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(text[:n - window + 1] == text[window - 1:])
    code = text[starts].astype(np.uint64) * mixer[window]
    for k in range(window):
        code += (rows[starts + k].astype(np.uint64) + np.uint64(1)) * mixer[k]
    order = np.argsort(code)
    own = code[order]
    same = own[1:] == own[:-1]
    twice = np.zeros(len(own), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = starts[order[twice]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return sums_by_group((np.cumsum(cover[:-1]) > 0).astype(np.int64), counts)


def _entropy(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shannon entropy (bits) of the ids of each group."""
    if not len(ids):
        return np.zeros(len(n))
    key = np.sort(np.repeat(np.arange(len(n), dtype=np.int64), n) << 32 | ids)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    c = np.diff(np.append(new, len(key)))
    total = np.bincount(key[new] >> 32, weights=c * np.log2(c), minlength=len(n))
    size = np.maximum(n, 1)
    return np.maximum(np.log2(size) - total / size, 0.0)


SCHEMA = ("id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, n_tokens bigint, chars_per_token double, chars_per_rank_token double, "
          "byte_share double, token_entropy double, script string, lang string")


def fertility_rules(docs: DataFrame, piece_path: str, rank_path: str, pattern: str, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str | None = None,
                    bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """One row per row of ``docs``: base counts, fertility measures and the verdict ``kept``.

    Words are runs of anything but ASCII white space; each is tokenised on its own.  A text
    fails the base rules with under 10 words or over 20 % of its words in 5-word windows
    that repeat; otherwise it is kept if it lies in the band of its language (where
    ``lang_col`` is given and ``bands`` has it) or of its main script: characters per token
    under both vocabularies, share of byte tokens, token entropy.  Null, empty and blank
    texts have no words and fail; rows with equal ids keep a row each; an empty table gives
    an empty result; other columns are ignored.
    """
    by_name = dict(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _meter(piece_path, rank_path, pattern)
        for batch in batches:
            texts = byte_texts(batch, "text")
            langs = batch.column("lang").to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *_measure(meter, texts[a:b], langs[a:b], by_name)],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col)


def _measure(meter: _Meter, texts: list, langs: list, bands: Mapping[str, Band]) -> list[pa.Array]:
    rows, n_words = meter.table.number(texts)
    empty = np.zeros(0, dtype=np.int64)
    chars, symbols, start, n, n_bytes, ranked, main, main_letters = meter.table.features or [empty] * 8
    per_text = [sums_by_group(x[rows], n_words) for x in (chars, symbols, n, n_bytes, ranked)]
    word_chars, n_symbols, n_tokens, byte_tokens, rank_tokens = per_text
    # a text's script: that of most letters, each word counted under its own main script
    owner = np.repeat(np.arange(len(texts)), n_words)
    letters = np.bincount(owner * len(SCRIPTS) + main[rows], weights=main_letters[rows], minlength=len(texts) * len(SCRIPTS))
    script = letters.reshape(len(texts), len(SCRIPTS)).argmax(axis=1)
    dup_lines = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            lines = [x for x in text.split(b"\n") if x.strip()]
            dup_lines[i] = len(lines) - len(set(lines))
    repeat = repeated_words(rows, n_words)
    entropy = _entropy(gather(meter.flat, start[rows], n[rows]), n_tokens)
    per_token = word_chars / np.maximum(n_tokens, 1)
    per_rank = word_chars / np.maximum(rank_tokens, 1)
    byte_share = byte_tokens / np.maximum(n_tokens, 1)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    used = [bands.get(lang) or bands.get(SCRIPTS[s]) or bands[""] for lang, s in zip(langs, script.tolist())]
    low, high, most_bytes, least, since = (np.array(x) for x in zip(*[
        (*b.chars_per_token, b.byte_share, b.entropy, b.entropy_from) for b in used])) if used else [empty] * 5
    inside = ((n_tokens > 0) & (per_token >= low) & (per_token <= high) & (per_rank >= low) & (per_rank <= high)
              & (byte_share <= most_bytes)
              & ((n_tokens < since) | (entropy >= least * np.log2(np.maximum(n_tokens, 2)))))
    return [pa.array(x) for x in (n_words, word_chars, n_symbols, dup_lines, repeat, failed, ~failed & inside,
                                  n_tokens, per_token, per_rank, byte_share, entropy)] + [
        pa.array([SCRIPTS[s] for s in script.tolist()], pa.string()), pa.array(langs, pa.string())]


# ---------------------------------------------------------------------------- measured bands
def _steps(measure: str) -> Column:
    """A measure on the scale of its band (ratios by their logarithm), in whole steps."""
    value = F.col(measure)
    if measure != "byte_share":
        value = F.log(F.greatest(value, F.lit(1e-6)))
    return F.floor(value * STEPS).cast("bigint")


def measured_bands(measures: DataFrame, by: list[str]) -> DataFrame:
    """Per group of the columns ``by``: ``low_`` and ``high_`` of every measure in steps.

    Quartiles are those of all texts of the group that pass the base rules, read from counts
    per step (some thousand rows a group, whatever its size); groups with fewer than
    ``LEAST_TEXTS`` of them have no row.  Null is a group of its own."""
    passing = measures.where(~F.col("base_failed"))
    counts = (passing.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), _steps(m).alias("step")) for m in LEAST_SPREAD])).alias("m"))
        .groupBy(*by, "m.measure", "m.step").agg(F.count(F.lit(1)).alias("n")))
    group = Window.partitionBy(*by, "measure")
    sums = counts.select(*by, "measure", "step", F.sum("n").over(group).alias("total"),
                         F.sum("n").over(group.orderBy("step")).alias("upto"))
    quartile = {q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("step"))) for q in (1, 3)}
    spread = F.create_map(*[x for m, least in LEAST_SPREAD.items() for x in (F.lit(m), F.lit(least * STEPS))])
    found = (sums.where(F.col("total") >= LEAST_TEXTS).groupBy(*by, "measure")
             .agg(quartile[1].alias("q1"), quartile[3].alias("q3"))
             .withColumn("reach", FENCE * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("measure")])))
    ends = []
    for m in LEAST_SPREAD:
        own = F.col("measure") == m
        ends += [F.max(F.when(own, F.col("q1") - F.col("reach"))).alias(f"low_{m}"),
                 F.max(F.when(own, F.col("q3") + F.col("reach"))).alias(f"high_{m}")]
    return found.groupBy(*by).agg(*ends)


def measured_rules(docs: DataFrame, piece_path: str, rank_path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang", bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """``fertility_rules``, and ``kept`` also asks a text to lie in the measured band of its
    language and main script, or of its script where the table has too few texts of both.

    Characters per token are bounded from both sides under either vocabulary by its own
    quartiles, the share of byte tokens from above.  Where neither group has ``LEAST_TEXTS``
    texts, ``fertility_rules`` decides alone.  Texts without a language are a group like
    any other.  Everything else is as in ``fertility_rules``; columns ``in_fixed_band`` and
    ``in_measured_band`` tell which rule rejected a text.
    """
    # measured once: the written table has no texts in it
    measures = materialize(fertility_rules(docs, piece_path, rank_path, pattern, id_col, text_col, lang_col, bands), "fertility")
    own = measured_bands(measures, ["lang", "script"])
    script = measured_bands(measures, ["script"])
    ends = [c for c in script.columns if c != "script"]
    own = own.select(F.col("lang").alias("__lang"), F.col("script").alias("__script"), *[F.col(c).alias(f"__own_{c}") for c in ends])
    script = script.select(F.col("script").alias("__of"), *[F.col(c).alias(f"__any_{c}") for c in ends])
    both = (measures.join(own, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("script") == F.col("__script")), "left")
            .join(script, F.col("script") == F.col("__of"), "left"))
    inside = F.lit(True)
    for m in LEAST_SPREAD:
        low, high = (F.coalesce(F.col(f"__own_{e}_{m}"), F.col(f"__any_{e}_{m}")) for e in ("low", "high"))
        above = F.lit(True) if m == "byte_share" else F.coalesce(_steps(m) >= low, F.lit(True))
        inside = inside & above & F.coalesce(_steps(m) <= high, F.lit(True))
    out = both.withColumn("in_fixed_band", F.col("kept")).withColumn("in_measured_band", inside)
    return out.withColumn("kept", F.col("kept") & F.col("in_measured_band")).select(
        *measures.columns, "in_fixed_band", "in_measured_band")
