"""Session set-up."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(f: Callable) -> Callable:
    """`f` (spark, ...) with this package on the path of the session's Python workers, wherever the driver was started.

    Where executors do not share the driver's file system, ship the package with --py-files as usual.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if _ROOT not in paths.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (paths, _ROOT) if p)
        return f(spark, *args, **kwargs)

    return run
