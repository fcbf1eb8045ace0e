"""Progress of a running job: counters that tasks add to, read by a thread of the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import Accumulator


@contextmanager
def watched(done: Accumulator, failed: Accumulator, progress: Callable[[int, int], None] | None, every: float = 0.2) -> Iterator[None]:
    """Calls ``progress(done, failed)`` whenever the counts have changed, and once at the end.

    Counts come with each task that ends. Tasks that run again count again, so a report may run ahead of the result, which is what counts.
    """
    if progress is None:
        yield
        return
    over, told = threading.Event(), [None]

    def tell() -> None:
        now = (done.value, failed.value)
        if now != told[0]:
            told[0] = now
            progress(*now)

    def watch() -> None:
        while not over.wait(every):
            tell()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        tell()
