"""Regular expressions over bytes as minimal deterministic automata in transition arrays.

A pattern is read with Python's own ``re`` parser, turned into a nondeterministic automaton
over bytes, made deterministic by subset construction and minimised.  Understood are
literals, classes, groups, alternatives and greedy repeats.  Byte 0xFF, which UTF-8 never has, is no
member of any class: it ends every match, so texts can be scanned as one stream with 0xFF
between them.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

import numpy as np

BREAK = 0xFF


class Nfa:
    """States are numbers; ``moves`` lists (bytes, target), ``empty`` lists targets."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, pattern: str, ignore_case: bool, backwards: bool) -> tuple[int, int]:
        """Start and end state of a pattern's part of the automaton."""
        tree = _parser.parse(pattern.encode("latin-1"), re.IGNORECASE if ignore_case else 0)
        a, b = self.state(), self.state()
        self._sequence(tree, a, b, ignore_case, backwards)
        return a, b

    def _sequence(self, items, a: int, b: int, fold: bool, back: bool) -> None:
        items = list(items)
        for item in reversed(items) if back else items:
            c = self.state()
            self._item(item, a, c, fold, back)
            a = c
        self.empty[a].append(b)

    def _item(self, item, a: int, b: int, fold: bool, back: bool) -> None:
        kind, arg = item
        if kind in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY):
            self.moves[a].append((_bytes_of(kind, arg, fold), b))
        elif kind is op.SUBPATTERN:
            self._sequence(arg[-1], a, b, fold, back)
        elif kind is op.BRANCH:
            for part in arg[1]:
                self._sequence(part, a, b, fold, back)
        elif kind is op.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                c = self.state()
                self._sequence(inner, a, c, fold, back)
                a = c
            if most is op.MAXREPEAT:
                c = self.state()
                self.empty[a].append(c)
                self._sequence(inner, c, c, fold, back)
                self.empty[c].append(b)
            else:
                self.empty[a].append(b)
                for _ in range(most - least):
                    c = self.state()
                    self._sequence(inner, a, c, fold, back)
                    self.empty[c].append(b)
                    a = c
        else:
            raise ValueError(f"no automaton for {kind}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes_of(kind, arg, fold: bool) -> frozenset[int]:
    if kind is op.ANY:
        out = set(range(256)) - {10}
    elif kind is op.LITERAL:
        out = {arg}
    elif kind is op.NOT_LITERAL:
        out = set(range(256)) - {arg}
    else:
        negated, out = False, set()
        for k, v in arg:
            if k is op.NEGATE:
                negated = True
            elif k is op.LITERAL:
                out.add(v)
            elif k is op.RANGE:
                out.update(range(v[0], v[1] + 1))
            else:
                raise ValueError(f"no automaton for {k}")
        if fold:
            out |= _either_case(out)
        if negated:
            out = set(range(256)) - out
    if fold:
        out |= _either_case(out)
    return frozenset(out - {BREAK})


def _either_case(members: set[int]) -> set[int]:
    return {ord(f(chr(b))) for b in members if b < 128 for f in (str.lower, str.upper)}


class Automaton:
    """Minimal deterministic automaton of several patterns.

    ``step`` maps ``state * n_classes + class`` to the next state times ``n_classes``;
    ``class_of`` maps a byte to its class; ``rules`` holds, per state, the bit mask of the
    patterns that accept there.  States that accept come last, from ``accepts_from`` on.
    ``anchored``: matches start at the first byte only, and state ``dead`` has no way on.
    """

    def __init__(self, patterns: list[tuple[str, bool]], backwards: bool = False, anchored: bool = False):
        nfa = Nfa()
        starts, ends = [], {}
        for rule, (pattern, ignore_case) in enumerate(patterns):
            a, b = nfa.add(pattern, ignore_case, backwards)
            starts.append(a)
            ends[b] = 1 << rule
        columns = self._byte_classes(nfa)
        table, rules, dead = self._subsets(nfa, starts, ends, columns, anchored)
        self._minimise(table, rules, dead)

    def _byte_classes(self, nfa: Nfa) -> list[int]:
        """One byte of each class of bytes that no move tells apart."""
        sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
        signs: dict[tuple, int] = {}
        self.class_of = np.array([signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256)], np.uint8)
        self.n_classes = len(signs)
        return [int(np.flatnonzero(self.class_of == c)[0]) for c in range(self.n_classes)]

    @staticmethod
    def _subsets(nfa: Nfa, starts: list[int], ends: dict[int, int], columns: list[int], anchored: bool):
        first = nfa.closure(starts)
        numbers, todo, table = {first: 0}, [first], []
        for own in todo:
            row = []
            for byte in columns:
                to = {t for s in own for members, t in nfa.moves[s] if byte in members}
                to = nfa.closure(to if anchored else to | set(starts))
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append(numbers[to])
            table.append(row)
        rules = np.array([sum({ends[s] for s in own if s in ends}) for own in todo], dtype=np.int64)
        return np.array(table), rules, numbers.get(frozenset())

    def _minimise(self, table: np.ndarray, rules: np.ndarray, dead: int | None) -> None:
        """Partition refinement: states stay together while all bytes lead to the same parts."""
        _, part = np.unique(rules, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        _, of = np.unique(part, return_index=True)  # a state of each part
        order = np.argsort(rules[of] > 0, kind="stable")
        place = np.empty(len(of), dtype=np.int64)
        place[order] = np.arange(len(of))
        self.rules = rules[of[order]]
        self.n_states = len(of)
        self.accepts_from = int((self.rules == 0).sum()) * self.n_classes
        self.step = (place[part[table[of[order]]]] * self.n_classes).astype(np.int32).ravel()
        self.start = int(place[part[0]]) * self.n_classes
        self.dead = None if dead is None else int(place[part[dead]]) * self.n_classes

    def longest(self, data: bytes, at: int) -> int | None:
        """End of the longest match that starts at ``at`` (an anchored automaton)."""
        step, class_of = self._lists()
        state, best = self.start, at if self.start >= self.accepts_from else None
        for i in range(at, len(data)):
            state = step[state + class_of[data[i]]]
            if state >= self.accepts_from:
                best = i + 1
            elif state == self.dead:
                break
        return best

    def _lists(self) -> tuple[list[int], list[int]]:
        if not hasattr(self, "_as_lists"):
            self._as_lists = self.step.tolist(), self.class_of.tolist()
        return self._as_lists

    def places(self, data: np.ndarray, chunk: int = 1024, warm: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """Backward pass over all bytes: where a state accepts, in order, and its rules' mask.

        The stream is cut into chunks that advance together, a byte a step.  Each starts from
        the state reached over the ``warm`` bytes beyond it; chunks for which that wasn't the
        state that the chunk beyond ended in are run again from the true one until all agree.
        """
        n = len(data)
        width = max(1, -(-n // chunk))
        classes = np.full((width + 1) * chunk, self.class_of[BREAK], dtype=np.uint8)
        classes[:n] = self.class_of[data]
        rows = np.ascontiguousarray(classes.reshape(width + 1, chunk).T[::-1])  # step, chunk; the last one is empty
        begin = np.full(width, self.start, dtype=np.int32)
        for i in range(chunk - min(warm, chunk), chunk):
            begin = self.step[begin + rows[i, 1:]]
        end, hit_at, hit_state = self._run(rows, np.arange(width), begin)
        while True:
            true = np.append(end[1:], np.int32(self.start))
            wrong = np.flatnonzero(true != begin)
            if not len(wrong):
                break
            begin[wrong] = true[wrong]
            again, at, state = self._run(rows, wrong, begin[wrong])
            end[wrong] = again
            stays = ~np.isin(hit_at // chunk, wrong)
            hit_at, hit_state = np.concatenate([hit_at[stays], at]), np.concatenate([hit_state[stays], state])
        order = np.argsort(hit_at)
        return hit_at[order], self.rules[hit_state[order] // self.n_classes]

    def _run(self, rows: np.ndarray, chunks: np.ndarray, state: np.ndarray):
        """States after a run over the given chunks, and the places and states that accept."""
        size = len(rows)
        at, found = [], []
        own = rows if len(chunks) == rows.shape[1] - 1 else np.ascontiguousarray(rows[:, chunks])
        for i in range(size):
            state = self.step[state + own[i, :len(chunks)]]
            hit = np.flatnonzero(state >= self.accepts_from)
            if len(hit):
                at.append(chunks[hit] * size + (size - 1 - i))
                found.append(state[hit])
        none = np.zeros(0, dtype=np.int64)
        return state, np.concatenate(at) if at else none, np.concatenate(found) if found else none
