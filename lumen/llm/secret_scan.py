"""Secret scans by one combined deterministic automaton.

The regular expressions of all rules are compiled, reversed, into one minimal automaton
over bytes.  A single backward pass over a text finds every place where a match of any rule
begins; from there the rule's own automaton gives the longest match.  Places inside a match
of the same rule are passed over, so matches are leftmost and don't overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.automaton import Automaton
from lumen.llm.texts import bounded_batches, byte_texts, slices


@dataclass(frozen=True)
class Rule:
    """A secret of kind ``kind``: ``head`` then ``value``, which has ``least`` bytes or more.

    A shorter value is no secret, but its match is passed over all the same.
    """

    kind: str
    value: str
    least: int = 0
    head: str = ""
    ignore_case: bool = False

    @property
    def pattern(self) -> str:
        return self.head + self.value


# The base rules. Runs of 16 and more hexadecimal digits are asked for by the pattern itself:
# a run is always one match, and a shorter one would only mark every letter from a to f.
BASE_RULES = (
    Rule("assign", "([A-Za-z0-9+/_.=-]+)", 12, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}"),
)

# Fixed formats of public services' keys.
KEY_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D\x20]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"""(https?|ftp|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20:/@"'<>]+:[^\x00-\x20/@"'<>]+@"""),
)

RULES = BASE_RULES + KEY_RULES


class Scanner:
    """The rules' automata: ``all_starts`` for the one pass, one per rule for what follows."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = list(rules)
        self.all_starts = Automaton([(r.pattern, r.ignore_case) for r in rules], backwards=True)
        self.whole = [Automaton([(r.pattern, r.ignore_case)], anchored=True) for r in rules]
        self.heads = [Automaton([(r.head, r.ignore_case)], anchored=True) if r.head else None for r in rules]

    @cached_property
    def kinds(self) -> list[str]:
        return [r.kind for r in self.rules]

    def spans(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int]]]:
        """Per text: (start, rule, end) in code points, by start and rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        stream = b"\xff".join(t or b"" for t in texts) + b"\xff"
        data = np.frombuffer(stream, dtype=np.uint8)
        at, masks = self.all_starts.places(data)
        if not len(at):
            return out
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        for k, rule in enumerate(self.rules):
            starts = at[(masks >> k) & 1 == 1]
            i = 0
            while i < len(starts):
                start = int(starts[i])
                end = self.whole[k].longest(stream, start)
                value = start if self.heads[k] is None else self.heads[k].longest(stream, start)
                if end - value >= rule.least:
                    text = int(np.searchsorted(begins, start, side="right")) - 1
                    base = points[begins[text]]
                    out[text].append((int(points[start] - base), k, int(points[end] - base)))
                i = int(np.searchsorted(starts, end))
        return [sorted(x) for x in out]


@lru_cache(maxsize=8)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SCHEMA = "id {kind}, spans array<struct<kind: string, begin: bigint, finish: bigint>>"
_SPAN = pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("finish", pa.int64())])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of ``docs``: the secrets of its whole text.

    ``spans`` holds (kind, begin, finish) in code points, the end exclusive, ordered by begin
    and then by the rules' order.  Matches of one rule are leftmost, longest and don't overlap;
    those of different rules may.  A null or empty text has none; rows with equal ids keep a
    row each; an empty table gives an empty result; other columns are ignored.  The compiled
    automata (some hundred kilobytes) go with the task.
    """
    scanner = scanner_of(tuple(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch, "text")
            for a, b in slices(texts):
                found = [[{"kind": scanner.kinds[k], "begin": s, "finish": e} for s, k, e in own] for own in scanner.spans(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.list_(_SPAN))], ["id", "spans"])

    own = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col)


def joined(spans) -> F.Column:
    """``kind:begin:finish`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["finish"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    spans = F.col("spans")

    def number_of(kind: str) -> F.Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number_of(kind) for kind in base],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"))
