"""How far a running job is: rows done, rows a second and seconds left, while its tasks work."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark import Accumulator
from pyspark.sql import SparkSession

#: Takes rows done, rows in all, rows a second and seconds left.
Report = Callable[[int, int, float, float], None]


def progress(done: int, total: int, seconds: float) -> tuple[float, float]:
    """Rows a second and seconds left; zeros where there is nothing to divide by."""
    rate = done / seconds if seconds > 0 else 0.0
    return rate, (total - done) / rate if rate > 0 else 0.0


class Watch:
    """Within `with`, calls `report` every `every` seconds when the count has risen, and once at the end, unless the job fails.

    Tasks add to `done`, which reaches the driver when a task ends. A task that is tried again adds again, so counts on the
    way are held at the total; `finished` takes the exact one."""

    def __init__(self, spark: SparkSession, total: int, report: Report, every: float = 1.0):
        self.done: Accumulator[int] = spark.sparkContext.accumulator(0)
        self.total, self.report, self.every = total, report, every
        self.exact: int | None = None
        self._over = threading.Event()

    def _tell(self, done: int) -> None:
        self.report(done, self.total, *progress(done, self.total, time.monotonic() - self._begun))

    def _look(self) -> None:
        last = 0
        while not self._over.wait(self.every):
            now = min(self.done.value, self.total)
            if now > last:
                last = now
                self._tell(now)

    def __enter__(self) -> Watch:
        self._begun = time.monotonic()
        self._thread = threading.Thread(target=self._look, daemon=True)
        self._thread.start()
        return self

    def finished(self, exact: int) -> None:
        self.exact = exact

    def __exit__(self, failed, *_: object) -> None:
        self._over.set()
        self._thread.join()
        if failed is None:
            self._tell(min(self.done.value, self.total) if self.exact is None else self.exact)
