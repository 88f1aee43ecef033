"""BPE encoding by speculation: greedy longest-match proposals, vectorised checks of every
adjacent pair, exact merging for the words that fail; and decoding.

A sequence of tokens is the BPE encoding of its word exactly if every token is the
encoding of its own text and every two neighbours, put side by side, stay apart, because
merges only ever join neighbours.  So the greedy proposal is accepted if all of its
neighbours stay apart, and merged exactly otherwise.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumen.llm.intmap import IntMap
from lumen.llm.texts import WordTable, bounded_batches, byte_texts, gather, held, slices, starts_of, sums_by_group

END = "</w>"
NEVER = np.int64(1) << 40
LONG = 64
"""Words of more bytes than this are merged exactly at once, one by one."""
COMMON = re.compile(rb"(?:[\x00-\x7F]|[\xC2-\xC8][\x80-\xBF]|\xE2\x80[\x90-\xA7])*+")
"""Texts below U+0240 and of common dashes and quotes: their classes are the same in all
Unicode versions."""


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A vocabulary with word ends, read from a tokenizer file whose words are lower-cased,
    cut by the file's own pattern and encoded as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(split + r"|\n")
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.special_mark = [s[:2].encode() for s in self.special]
        alphabet = _byte_alphabet()
        self.as_byte = {ord(c): b for b, c in enumerate(alphabet)}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token_text = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token_text[i] = t
        # merges: pair of ids → rank; each token's own last merge
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_at = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ia, ib, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[ia, ib] = (r, made)
            if self.made_at[made] < 0:
                self.made_at[made], self.left[made], self.right[made] = r, ia, ib
        pair_codes = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        self.pair_rank = IntMap(pair_codes, np.array([r for r, _ in self.rank.values()]))
        self.made_by_rank = np.array([made for _, made in self.rank.values()], dtype=np.int64)
        # symbols that bytes start as
        self.base = np.array([self.vocab[c] for c in alphabet], dtype=np.int64)
        self.base_end = np.array([self.vocab[c + END] for c in alphabet], dtype=np.int64)
        # proposals: tokens that encode their own text, in a trie over bytes
        texts = {t: (t[:-len(END)] if t.endswith(END) and t != END else t).translate(self.as_byte).encode("latin-1")
                 for t in self.vocab}
        self._set_trie({t: texts[t] for t, i in self.vocab.items() if self._sound(i)})
        self.cutter = Tokenizer.from_file(path)

    def _sound(self, token: int) -> bool:
        """Is the token the encoding of its own text?"""
        if self.made_at[token] < 0:
            return True
        ended = self.token_text[token].endswith(END)
        symbols: list[int] = []
        stack = [token]
        while stack:
            t = stack.pop()
            if self.made_at[t] < 0:
                symbols.append(t)
            else:
                stack += [int(self.right[t]), int(self.left[t])]
        return self._merge_few(symbols) == [token] and ended == self.token_text[symbols[-1]].endswith(END)

    def _set_trie(self, tokens: dict[str, bytes]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        inner, final = [-1], [-1]
        for t, text in tokens.items():
            at = 0
            for byte in text:
                step = (at, byte)
                if step not in nodes:
                    nodes[step] = len(inner)
                    inner.append(-1)
                    final.append(-1)
                at = nodes[step]
            if t.endswith(END) and t != END:
                final[at] = self.vocab[t]
            else:
                inner[at] = self.vocab[t]
        self.child = IntMap(np.array([n << 8 | b for n, b in nodes], dtype=np.int64), np.array([*nodes.values()]))
        self.inner, self.final = np.array(inner, dtype=np.int64), np.array(final, dtype=np.int64)

    # -- exact merging ---------------------------------------------------------------

    def _merge_few(self, ids: list[int]) -> list[int]:
        """Exact merging of one short word: lowest rank first, leftmost among equals."""
        rank = self.rank
        while len(ids) > 1:
            best = None
            for i in range(len(ids) - 1):
                r = rank.get((ids[i], ids[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            ids[at:at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n, rank = len(ids), self.rank
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := rank.get((ids[x], ids[after[x]]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[after[x]]))
        return [t for t in ids if t >= 0]

    def merge_exact(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: (flat ids, lengths).  Words of one length form
        a matrix of symbols; every round merges each row's lowest, leftmost pair."""
        out: list[np.ndarray | None] = [None] * len(lens)
        for n in np.unique(lens).tolist():
            group = np.flatnonzero(lens == n)
            if n > LONG:
                for i in group.tolist():
                    text = data[starts[i]:starts[i] + n]
                    out[i] = np.array(self._merge_long([*self.base[text[:-1]].tolist(), int(self.base_end[text[-1]])]))
                continue
            text = data[starts[group][:, None] + np.arange(n)]
            ids = self.base[text]
            ids[:, -1] = self.base_end[text[:, -1]]
            row, width = group, n
            while len(row):
                if width == 1:
                    for i, own in zip(row.tolist(), ids):
                        out[i] = own
                    break
                ranks = self.pair_rank.get(ids[:, :-1] << 32 | ids[:, 1:], NEVER)
                at = ranks.argmin(axis=1)
                low = ranks[np.arange(len(row)), at]
                stop = low == NEVER
                if stop.any():
                    for i, own in zip(row[stop].tolist(), ids[stop]):
                        out[i] = own
                    row, ids, at, low = row[~stop], ids[~stop], at[~stop], low[~stop]
                # drop the right symbol of the merged pair: every row is one symbol shorter
                keep = np.arange(width) != (at + 1)[:, None]
                ids[np.arange(len(row)), at] = self.made_by_rank[low]
                ids = ids[keep].reshape(len(row), width - 1)
                width -= 1
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), sizes

    # -- speculation -------------------------------------------------------------------

    def propose(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words at once: (flat ids, lengths).  All words walk the
        trie together, a byte a step; the last token must carry the word end."""
        ends = starts + lens
        word = np.arange(len(lens))
        at, node = starts.copy(), np.zeros(len(lens), dtype=np.int64)
        best, best_at = np.full(len(lens), -1), starts.copy()
        owners, tokens = [], []
        while len(word):
            inside = at < ends[word]
            byte = data[np.minimum(at, len(data) - 1)].astype(np.int64)
            child = np.where(inside, self.child.get(node << 8 | byte, -1), -1)
            on = child >= 0
            node = np.where(on, child, node)
            at = at + on
            done = on & (at == ends[word])
            whole = np.where(done, self.final[node], -1)
            owners.append(word[whole >= 0])
            tokens.append(whole[whole >= 0])
            inner = self.inner[node]
            better = on & ~done & (inner >= 0)
            best, best_at = np.where(better, inner, best), np.where(better, at, best_at)
            stuck = ~on
            owners.append(word[stuck])
            tokens.append(best[stuck])
            at, node = np.where(stuck, best_at, at), np.where(stuck, 0, node)
            left = whole < 0
            word, at, node, best, best_at = word[left], at[left], node[left], best[left], best_at[left]
        owner, flat = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(lens))

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of sound tokens side by side: does no merge ever join them?

        Walks both merge trees from the outer tokens inwards, last merge first.  While
        symbols x (left of the border) and y (right of it) stand there, the pair (x, y)
        would be merged if its rank comes before the merge that takes x away, or not
        after the one that takes y away (of equal merges the left one comes first).
        """
        ok = np.ones(len(a), dtype=bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends = np.full(len(a), NEVER)
        y_ends = np.full(len(a), NEVER)
        todo = np.arange(len(a))
        while len(todo):
            code = x[todo] << 32 | y[todo]
            rank = self.pair_rank.get(code, NEVER + 1)
            joins = (rank < x_ends[todo]) & (rank <= y_ends[todo])
            ok[todo[joins]] = False
            todo = todo[~joins]
            mx, my = self.made_at[x[todo]], self.made_at[y[todo]]
            todo, mx, my = (v[(mx >= 0) | (my >= 0)] for v in (todo, mx, my))
            # the later merge is undone first; of one rank the right one was made last
            take = mx > my
            tx, ty = todo[take], todo[~take]
            x_ends[tx], x[tx] = mx[take], self.right[x[tx]]
            y_ends[ty], y[ty] = my[~take], self.left[y[ty]]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each word: (flat ids, lengths)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        starts = starts_of(lens)
        short = lens <= LONG
        n = np.zeros(len(words), dtype=np.int64)
        flat, n[short] = self.propose(data, starts[short], lens[short])
        inside = np.ones(len(flat), dtype=bool)
        inside[np.cumsum(n[short]) - 1] = False
        border = np.flatnonzero(inside)
        pairs, which = np.unique(flat[border] << 32 | flat[border + 1], return_inverse=True)
        apart = self.stay_apart(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        failed = ~short
        failed[np.repeat(np.arange(len(words)), n)[border[~apart]]] = True
        again = np.flatnonzero(failed)
        if not len(again):
            return flat, n
        exact, exact_n = self.merge_exact(data, starts[again], lens[again])
        # ids of accepted words from the proposal, of the others from the merging
        source, begin, size = np.concatenate([flat, exact]), starts_of(n), n
        begin[again], size[again] = len(flat) + starts_of(exact_n), exact_n
        return gather(source, begin, size), size

    # -- chunks ----------------------------------------------------------------------

    def _cut(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Words of chunks without white space (lower-cased, NFC), and how many each has.  A
        word that is a special token stands as a negative number's text, see ``learn``."""
        text = b"\n".join(chunks).decode("utf-8", "replace")
        if not text.isascii():
            # lower-casing is by character: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        found = self.cut.findall(text.lower())
        found.append("\n")
        stop = np.flatnonzero(np.fromiter((w == "\n" for w in found), bool, len(found)))
        return [w.encode() for w in found if w != "\n"], np.diff(stop, prepend=-1) - 1

    def _cut_slowly(self, chunk: bytes) -> list[bytes | int]:
        """The same for one chunk with special tokens or characters whose class depends on the
        Unicode version: the library's own normaliser and pattern."""
        out: list[bytes | int] = []
        for part in self.cut_special.split(chunk.decode("utf-8", "replace")):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.cutter.normalizer.normalize_str(part)
                out += [w.translate(self.as_byte).encode("latin-1") for w, _ in self.cutter.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of chunks of text without white space: (start, length) into ``self.ids``."""
        joined = b"\n".join(chunks)
        common = COMMON.fullmatch(joined) and not any(m in joined for m in self.special_mark)
        odd = [] if common else [i for i, c in enumerate(chunks) if not COMMON.fullmatch(c) or any(m in c for m in self.special_mark)]
        plain = chunks if not odd else [c if COMMON.fullmatch(c) and not any(m in c for m in self.special_mark) else b"" for c in chunks]
        words, n_words = self._cut(plain)
        if odd:
            cut = {i: self._cut_slowly(chunks[i]) for i in odd}
            parts, n, at = [], n_words.copy(), 0
            for i, k in enumerate(n_words.tolist()):
                own = cut.get(i)
                parts += words[at:at + k] if own is None else own
                at += k
                if own is not None:
                    n[i] = len(own)
            words, n_words = parts, n
        seen: dict = {}
        row = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        uniq = list(seen)
        special = [(k, w) for k, w in enumerate(uniq) if isinstance(w, int)] if odd else []
        for k, _ in special:
            uniq[k] = b"?"
        flat, size = self.encode_words(uniq)
        begin = starts_of(size)
        for k, token in special:
            begin[k], size[k] = len(flat), 1
            flat = np.append(flat, token)
        lens = sums_by_group(size[row], n_words)
        ids = gather(flat, begin[row], size[row]).astype(np.uint32)
        start = starts_of(lens) + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        return [start, lens]

    def table(self) -> WordTable:
        self.ids = np.zeros(0, dtype=np.uint32)
        return _Chunks(self)


class _Chunks(WordTable):
    """A table of chunks whose flat ids live in the tokenizer and go with it."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        super().__init__(bpe.learn)

    def _clear(self):
        super()._clear()
        self.bpe.ids = np.zeros(0, dtype=np.uint32)


def tokenizer(path: str) -> tuple[WordBpe, _Chunks]:
    """The tokenizer of a file and its table of chunks, one per worker process."""
    def make():
        bpe = WordBpe(path)
        return bpe, bpe.table()
    return held(("bpe", path), make)


def token_strings(path: str) -> list[str]:
    """The file's token strings by id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        out[i] = t
    return out


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Ids of the rows a..b of a batch, some rows at a time."""
    bpe, table = tokenizer(path)
    texts = byte_texts(batch, "text")
    for a, b in slices(texts):
        rows, counts = table.number(texts[a:b])
        start, lens = table.features if table.features else (np.zeros(0, np.int64),) * 2
        n = lens[rows]
        ids = gather(bpe.ids, start[rows], n).astype("<u4")
        ends = np.cumsum(sums_by_group(n, counts)).tolist()
        yield a, b, [ids[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def _spelled(ids: np.ndarray, strings: list[str]) -> str:
    return " ".join(map(strings.__getitem__, ids.tolist()))


def _selected(df: DataFrame, id_col: str, col: str, name: str) -> tuple[DataFrame, str]:
    own = bounded_batches(df).select(F.col(id_col).alias("id"), F.col(col).alias(name))
    return own, own.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary) for every row: token ids as little-endian unsigned 32-bit integers.

    Null, empty and blank texts have no ids; repeated rows are encoded each; special
    tokens' strings in a text are their ids and none is added; other columns are ignored.
    ``vocab_path`` must be readable on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids in _encoded(batch, vocab_path):
                out = pa.array([x.tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out], ["id", "ids"])

    own, kind = _selected(docs, id_col, text_col, "text")
    return own.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ids: the tokens' own strings with spaces between, as a file
    without a decoder gives them, special tokens included.  Null or no ids: empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = held(("token strings", vocab_path), lambda: token_strings(vocab_path))
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for a, b in slices(ids):
                texts = [_spelled(np.frombuffer(x or b"", dtype="<u4"), strings) for x in ids[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], ["id", "text"])

    own, kind = _selected(encoded, id_col, ids_col, "ids")
    return own.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, text): :func:`encode`, and the ids read back by :func:`decode`, with
    one worker per task for both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = tokenizer(vocab_path)[0].token_text
        for batch in batches:
            for a, b, ids in _encoded(batch, vocab_path):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array([_spelled(x, strings) for x in ids], pa.string())], ["id", "ids", "text"])

    own, kind = _selected(docs, id_col, text_col, "text")
    return own.mapInArrow(run, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded."""
    return encode_and_decode(docs, vocab_path, id_col, text_col).select(
        id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
