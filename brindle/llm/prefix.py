"""Running totals over a whole table in order, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut, parts


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`rows` with a column for each of `sums`: the total over all rows before it in `order`, which no two rows share.

    A range shuffle sorts the rows into partitions; the totals of partitions,
    one row each, are what the driver sees and sends back; within a partition a
    window runs.
    """
    spark = rows.sparkSession
    dealt = cut(
        rows.select("*", *[c.alias(f"_order{i}") for i, c in enumerate(order)], *[c.alias(f"_of_{name}") for name, c in sums.items()])
        .repartitionByRange(parts(spark), *[f"_order{i}" for i in range(len(order))]).withColumn("_part", F.spark_partition_id())
    )
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_of_{name}").alias(name) for name in sums]).orderBy("_part").collect()
    before, so_far = [], [0] * len(sums)
    for r in totals:
        before.append((r["_part"], *so_far))
        so_far = [a + b for a, b in zip(so_far, r[1:])]
    kinds = [dealt.select(F.sum(f"_of_{name}")).schema[0].dataType.simpleString() for name in sums]
    schema = "_part int, " + ", ".join(f"_before{i} {k}" for i, k in enumerate(kinds))
    cast = [float if k == "double" else int for k in kinds]
    offsets = spark.createDataFrame([(r[0], *[f(x) for f, x in zip(cast, r[1:])]) for r in before], schema)
    within = W.partitionBy("_part").orderBy(*[f"_order{i}" for i in range(len(order))]).rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(F.broadcast(offsets), "_part").select(
        *rows.columns, *[(F.col(f"_before{i}") + F.coalesce(F.sum(f"_of_{name}").over(within), F.lit(0))).alias(name) for i, name in enumerate(sums)]
    )
