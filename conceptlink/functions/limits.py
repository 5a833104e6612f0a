"""Rates and batch sizes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check_rate(rate_limit: int | None) -> None:
    if rate_limit is not None and rate_limit <= 0:
        raise ValueError("the rate limit must be positive")


def reserve(n_docs: int, rate: float, next_allowed: float, now: float) -> tuple[float, float]:
    """(seconds to wait, when the next batch may go) for ``rate`` documents a minute, reserving ahead."""
    start = max(now, next_allowed)
    return start - now, start + n_docs * 60 / rate


#: Tasks that share a rate; each has its part of it.
PACED_TASKS = 4


class Pacer:
    """Waits so that a task and its threads send ``rate`` documents a minute at most; None: never waits."""

    def __init__(self, rate: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.clock, self.sleep, self.next, self.lock = rate, clock, sleep, 0.0, threading.Lock()

    def wait(self, n_docs: int = 1) -> None:
        if self.rate is None:
            return
        with self.lock:
            seconds, self.next = reserve(n_docs, self.rate, self.next, self.clock())
        if seconds > 0:
            self.sleep(seconds)


def paced(df: DataFrame, rate_limit: int | None) -> tuple[DataFrame, float | None]:
    """The frame in as many tasks as share the rate, and the rate of each."""
    check_rate(rate_limit)
    return (df, None) if rate_limit is None else (df.repartition(PACED_TASKS), rate_limit / PACED_TASKS)


def schedule(batches: DataFrame, rate: float, group: str | None = None, order: str = "batch", size: str = "n_docs") -> DataFrame:
    """start_s of each batch: the documents of all batches before it at ``rate`` a minute."""
    check_rate(rate)
    window = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    before = F.sum(size).over(window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return batches.withColumn("start_s", F.coalesce(before, F.lit(0)) * 60 / F.lit(float(rate)))


def estimated_batch_size(free_gib: float, small: tuple[int, float], large: tuple[int, float], reserve_gib: float = 1.5) -> int:
    """The batch that fits, from the memory of two measured batches (size, GiB); one at least."""
    slope = (large[1] - small[1]) / (large[0] - small[0])
    if slope <= 0:
        return max(1, large[0])
    return max(1, int((free_gib - reserve_gib) / slope))


def docs_per_second(n: Column, seconds: Column) -> Column:
    """Zero where no time has passed."""
    return F.coalesce(F.try_divide(n, F.nullif(seconds, F.lit(0.0))), F.lit(0.0))
