"""State of the streaming rate limit (W1), one instance per task.

The rule is sequential per key, and a micro-batch hands a key's rows over in no order.  They
are sorted outside memory: every Arrow batch becomes a sorted run, cut into pages that lie
in the state store (RocksDB: on disk), and the runs are merged with one page of each in
memory.  A key whose rows come in one Arrow batch needs no pages.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAGE = 1024     # rows of a page in the state store
OUT = 10_000    # rows of a frame handed on


class Admissions(StatefulProcessor):
    """Admitted and late flags of a key's requests in (stamp, ``order``) order; the last two
    columns of the rows are ``order`` and the stamp in microseconds.

    State per key: the admitted stamps of the last window (at most ``limit``), the last stamp
    and the timer that removes both.
    """

    def __init__(self, keys: list[str], order: str, limit: int, window_us: int):
        self.keys, self.order, self.limit, self.window = keys, order, limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "stamps array<bigint>, last bigint, timer bigint")
        self.pages = handle.getMapState("pages", "run int, page int", "us array<bigint>, ord array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stamps, last, timer = [], None, None
        if self.held.exists():
            stamps, last, timer = self.held.get()
            stamps = list(stamps)
        head, out = 0, []
        for t, o in self._sorted(rows):
            late = last is not None and t < last - self.window
            ok = False
            if not late:
                while head < len(stamps) and stamps[head] < t - self.window:
                    head += 1
                if head > 4 * self.limit:  # only the live window is kept
                    stamps, head = stamps[head:], 0
                ok = len(stamps) - head < self.limit
                if ok:
                    bisect.insort(stamps, t, head)  # a later batch may begin before the last stamp
                last = t if last is None else max(last, t)
            out.append((o, ok, late))
            if len(out) == OUT:
                yield self._frame(key, out)
                out = []
        if out:
            yield self._frame(key, out)
        if last is None:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        # a stamp that comes before the watermark has passed the window still meets the state
        timer = max((last + self.window) // 1000, timerValues.getCurrentWatermarkInMs()) + 1
        self.handle.registerTimer(timer)
        self.held.update((stamps[head:], last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _frame(self, key, out: list) -> pd.DataFrame:
        order, ok, late = zip(*out)
        return pd.DataFrame({**{k: [v] * len(out) for k, v in zip(self.keys, key)},
                             self.order: order, "admitted": ok, "late": late})

    def _sorted(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
        """All rows of the key as (stamp, order), sorted; one run at least stays in memory."""
        first, lengths = None, []
        for frame in rows:
            # by place: names that aren't identifiers don't reach a state processor
            own = frame.iloc[:, -2:].set_axis(["ord", "us"], axis=1).astype("int64").sort_values(["us", "ord"])
            run = (own["us"].tolist(), own["ord"].tolist())
            if first is None:
                first = run
                continue
            lengths.append(self._store(len(lengths), run))
        if first is None:
            return
        yield from heapq.merge(zip(*first), *[self._load(r, n) for r, n in enumerate(lengths)])
        if lengths:
            self.pages.clear()

    def _store(self, run: int, columns: tuple[list, list]) -> int:
        pages = range(0, len(columns[0]), PAGE)
        for page, a in enumerate(pages):
            self.pages.updateValue((run, page), tuple(c[a:a + PAGE] for c in columns))
        return len(pages)

    def _load(self, run: int, pages: int) -> Iterator[tuple[int, int]]:
        for page in range(pages):
            us, order = self.pages.getValue((run, page))
            yield from zip(us, order)
