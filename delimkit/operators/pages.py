"""A cache of pages in front of a view, for callers that scroll."""

from __future__ import annotations

from collections import OrderedDict
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock

from ..model import CACHED_PAGES, PAGE_ROWS
from .view import View


class PageCache:
    """Pages of PAGE_ROWS rows, the CACHED_PAGES last used ones; each is read once even if it is asked for while being read.

    ``reset`` begins a new generation, for another view: pages still being read for an
    earlier one are given to those who asked, but not kept.
    """

    def __init__(self, view: View, threads: int = 2):
        self.view, self.generation = view, 0
        self._pages: OrderedDict[int, list] = OrderedDict()
        self._reading: dict[int, Future] = {}
        self._lock, self._pool = Lock(), ThreadPoolExecutor(threads)

    def reset(self, view: View | None = None) -> None:
        with self._lock:
            self.view, self.generation = view or self.view, self.generation + 1
            self._pages.clear()
            self._reading.clear()

    def _ask(self, n: int) -> Future | list:
        with self._lock:
            if n in self._pages:
                self._pages.move_to_end(n)
                return self._pages[n]
            if n not in self._reading:
                self._reading[n] = self._pool.submit(self._read, n, self.view, self.generation)
            return self._reading[n]

    def _read(self, n: int, view: View, generation: int) -> list:
        try:
            rows = view.page(n * PAGE_ROWS, PAGE_ROWS).collect()
        except BaseException:
            with self._lock:
                if generation == self.generation:
                    self._reading.pop(n, None)
            raise
        with self._lock:
            if generation == self.generation:
                self._reading.pop(n, None)
                self._pages[n] = rows
                while len(self._pages) > CACHED_PAGES:
                    self._pages.popitem(last=False)
        return rows

    def rows(self, start: int, count: int, direction: int = 0) -> list:
        """Rows from the start-th visible one; ``direction`` 1 or -1 also reads the next page that way, without waiting."""
        start, count = max(0, int(start)), max(0, min(PAGE_ROWS, int(count)))
        if not count:
            return []
        first, last = start // PAGE_ROWS, (start + count - 1) // PAGE_ROWS
        asked = [self._ask(n) for n in range(first, last + 1)]
        ahead = last + 1 if direction > 0 else first - 1
        if direction and ahead >= 0:
            self._ask(ahead)
        got = [r for x in asked for r in (x.result() if isinstance(x, Future) else x)]
        return got[start - first * PAGE_ROWS :][:count]

    def close(self) -> None:
        self._pool.shutdown(wait=False, cancel_futures=True)
