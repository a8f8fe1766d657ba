"""Driver loop for upkeep tasks: by priority, then in order of arrival, in time slices."""

from __future__ import annotations

import heapq
import itertools
import time
from collections.abc import Callable


class IdleScheduler:
    """Runs enqueued tasks one at a time; a failing task is reported and the next goes on; stop is final."""

    def __init__(self, slice_s: float = 0.005, on_error: Callable[[str, Exception], None] | None = None):
        self.slice_s, self.on_error = slice_s, on_error or (lambda name, error: None)
        self._heap: list = []
        self._count = itertools.count()
        self.stopped = False

    def enqueue(self, name: str, task: Callable[[], object], priority: int = 0) -> None:
        if self.stopped:
            raise RuntimeError("the scheduler was stopped")
        heapq.heappush(self._heap, (-priority, next(self._count), name, task))

    def __len__(self) -> int:
        return len(self._heap)

    def run_turn(self) -> int:
        """Run tasks until the slice is over (one at least); the number that ran."""
        began, n = time.monotonic(), 0
        while self._heap and not self.stopped and (n == 0 or time.monotonic() - began < self.slice_s):
            _, _, name, task = heapq.heappop(self._heap)
            n += 1
            try:
                task()
            except Exception as error:
                self.on_error(name, error)
        return n

    def run_all(self) -> int:
        n = 0
        while self._heap and not self.stopped:
            n += self.run_turn()
        return n

    def stop(self) -> None:
        self.stopped = True
        self._heap.clear()
