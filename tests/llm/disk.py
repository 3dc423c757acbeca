"""Bytes that Spark's tasks write: shuffles, spills and tables in the shared folder."""

from __future__ import annotations

import os

from parley.session import shared_dir


def written(spark, run) -> int:
    """Bytes that a run shuffles and spills in a local session, and those of the files that it leaves in the shared folder."""

    def moved() -> int:
        source = spark._jvm.org.apache.spark.SparkEnv.get().metricsSystem().getSourcesByName("executor").head()
        counters = source.metricRegistry().getCounters()
        return sum(counters[name].getCount() for name in ("shuffleBytesWritten", "diskBytesSpilled"))

    def files() -> dict[str, int]:
        folder = shared_dir(spark).removeprefix("file:")
        return {f"{d}/{n}": os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(folder) for n in names}

    moved_before, before = moved(), files()
    run()
    return moved() - moved_before + sum(n for name, n in files().items() if name not in before)
