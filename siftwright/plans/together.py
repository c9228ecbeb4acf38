"""Independent Spark jobs side by side: while one waits for stragglers, another uses the slots."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Jobs in flight at once; each keeps its own driver thread.
AT_ONCE = 8


def together(spark: SparkSession, tasks: list[Callable]) -> list:
    """Results of the tasks in order; the first error is raised after all have ended."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(AT_ONCE, len(tasks))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]
    return [r.result() for r in running]
