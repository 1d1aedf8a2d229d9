"""Independent model fits submitted side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

T = TypeVar("T")

# Fits in flight.  Each is a series of small jobs that leaves cores idle between them.
PARALLEL_FITS = 4


def run_all(tasks: Sequence[Callable[[], T]], parallel: int = PARALLEL_FITS) -> list[T]:
    """Results in the order of ``tasks``; Spark schedules the jobs of concurrent tasks together."""
    if len(tasks) <= 1 or parallel <= 1:
        return [task() for task in tasks]
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(lambda task: task(), [inherit(t) for t in tasks]))


def fit_all(jobs: Sequence[tuple[Estimator, DataFrame]], parallel: int = PARALLEL_FITS) -> list[Model]:
    return run_all([lambda e=estimator, d=data: e.fit(d) for estimator, data in jobs], parallel)
