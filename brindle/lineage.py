"""Cutting the lineage of DataFrames that loops build up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine where that is unset (tests)."""
    if not (set_ := spark.conf.get("spark.checkpoint.dir", None)) and not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return set_ or _fallback[0]


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from the folder in spark.checkpoint.dir.

    That folder is shared by driver and executors, so a lost executor loses
    nothing.  Only where the setting is absent (tests on one machine) is a
    temporary folder set.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return _measured(df.checkpoint(eager=True))


def _estimate(plan) -> int:
    try:
        return plan.stats().sizeInBytes()
    except ValueError:  # more digits than Python reads
        return 2**63


def _measured(done: DataFrame) -> DataFrame:
    """The checkpoint `done`, as a table of unknown size where its estimated size has outgrown all sense.

    A checkpoint keeps the estimate of the plan that it replaces, and a join's
    is the product of both sides: a loop squares it in every round, and soon
    the driver is filled with numbers of millions of digits.  From 2^63 bytes
    on it is forgotten; adaptive execution goes by the sizes that it meets.
    """
    plan = done._jdf.queryExecution().analyzed()
    if _estimate(plan) < 2**63:
        return done
    session = done.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.rdd(), done._jdf.schema(), False), session)


def parts(spark: SparkSession) -> int:
    """Partitions for shuffles of what Python works on: the session's number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
