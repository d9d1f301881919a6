"""Peak resident memory of the driver process, and an end to a run that exceeds its budget."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from pathlib import Path


def resident_bytes() -> int:
    found = re.search(r"^VmRSS:\s+(\d+) kB", Path("/proc/self/status").read_text(), re.M)
    return int(found[1]) * 1024 if found else 0


class Watchdog:
    """Polls every ``interval`` seconds until stopped; calls ``over`` once if the budget (bytes, None: none) is exceeded."""

    def __init__(self, budget: int | None = None, interval: float = 0.15, over: Callable[[int], None] | None = None, read: Callable[[], int] = resident_bytes) -> None:
        self.peak, self.budget, self.over, self.read = 0, budget, over, read
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._poll, args=(interval,), daemon=True)

    def __enter__(self) -> Watchdog:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()

    def _poll(self, interval: float) -> None:
        told = False
        while True:
            now = self.read()
            self.peak = max(self.peak, now)
            if self.budget is not None and now > self.budget and not told:
                told = True
                if self.over:
                    self.over(now)
            if self._stop.wait(interval):
                return
