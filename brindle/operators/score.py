"""A composite score from four dimensions, its grade and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as s

# Weights of the dimensions, in all 1.1, and lower bounds of grades.
WEIGHTS = {"complexity": 0.3, "maintainability": 0.3, "architecture": 0.3, "qa": 0.2}
GRADES = ((85, "F"), (70, "D"), (50, "C"), (30, "B"), (0, "A"))
#: breakdown, dimension, threshold, priority, advice
RECOMMENDATIONS = (
    ("high_complexity", "complexity", 30, 1, "split functions with many branches"),
    ("long_functions", "complexity", 30, 2, "shorten long functions"),
    ("deep_nesting", "complexity", 30, 2, "return early instead of nesting"),
    ("dead_code", "maintainability", 30, 1, "remove code that nothing uses"),
    ("large_files", "maintainability", 30, 2, "split large files"),
    ("duplication", "maintainability", 30, 1, "extract what is duplicated"),
    ("pattern", "maintainability", 20, 3, "unify repeated patterns"),
    ("cycles", "architecture", 30, 1, "break dependency cycles"),
    ("orphans", "architecture", 30, 3, "attach or remove orphans"),
    ("coupling", "architecture", 30, 2, "reduce coupling"),
)
_IMPACT = {"complexity": 0.35, "maintainability": 0.3, "architecture": 0.2, "qa": 0.2}


def _share(a: Column, b: Column, cap: bool = False) -> Column:
    r = s.ratio(a, b)
    return F.least(r, F.lit(1.0)) if cap else r


def complexity_dimension(files: DataFrame) -> DataFrame:
    """One row from a table of files with functions, most, average, cognitive and params."""
    n = F.sum("functions")
    parts = files.agg(
        (_share(F.count_if(F.col("most") > 10), n) * 100).alias("high_complexity"), (_share(F.count_if(F.col("average") > 5), n) * 100).alias("long_functions"),
        (_share(F.count_if(F.col("cognitive") > 15), n) * 100).alias("deep_nesting"), (_share(F.count_if(F.col("params") > 5), n) * 100).alias("many_params"),
    )
    c = F.col
    return parts.withColumn("score", s.round2(c("high_complexity") * 0.4 + c("long_functions") * 0.25 + c("deep_nesting") * 0.2 + c("many_params") * 0.15))


def maintainability_dimension(counts: DataFrame) -> DataFrame:
    """One row from one row of dead, symbols, large, files, duplicated, patterns."""
    c = F.col
    parts = counts.select(
        (_share(c("dead"), c("symbols"), True) * 100).alias("dead_code"), (_share(c("large"), c("files"), True) * 100).alias("large_files"),
        (_share(c("duplicated"), c("files"), True) * 100).alias("duplication"), (_share(c("patterns"), c("files"), True) * 100).alias("pattern"),
    )
    return parts.withColumn("score", s.round2(c("dead_code") * 0.35 + c("large_files") * 0.2 + c("duplication") * 0.2 + c("pattern") * 0.25))


def architecture_dimension(counts: DataFrame) -> DataFrame:
    """One row from one row of cycles, orphans, coupled and files."""
    c = F.col
    parts = counts.select(
        F.least(c("cycles") * 10.0, F.lit(100.0)).alias("cycles"), (_share(c("orphans"), c("files")) * 100).alias("orphans"), (_share(c("coupled"), c("files")) * 100).alias("coupling"),
    )
    return parts.withColumn("score", s.round2(c("cycles") * 0.6 + c("orphans") * 0.25 + c("coupling") * 0.15))


def qa_dimension(counts: DataFrame) -> DataFrame:
    """One row from one row of type_issues, error_issues, naming_issues, security_issues, tests and files; every part is 0 to 100."""
    c = F.col
    cap = lambda x: F.least(x.cast("double"), F.lit(100.0))
    parts = counts.select(
        cap(c("type_issues") * 5).alias("type_safety"), (F.lit(100.0) - _share(c("tests"), c("files"), True) * 100).alias("missing_tests"),
        cap(c("error_issues") * 5).alias("error_handling"), cap(c("naming_issues") * 2).alias("naming"), cap(c("security_issues") * 10).alias("security"),
    )
    return parts.withColumn(
        "score", s.round2(c("type_safety") * 0.3 + c("missing_tests") * 0.25 + c("error_handling") * 0.2 + c("naming") * 0.15 + c("security") * 0.1)
    )


def combine(complexity: DataFrame, maintainability: DataFrame, architecture: DataFrame, qa: DataFrame) -> DataFrame:
    """(dimension, score, weight, weighted): four rows from the dimensions' one row each."""
    out = None
    for name, df in (("complexity", complexity), ("maintainability", maintainability), ("architecture", architecture), ("qa", qa)):
        row = df.select(F.lit(name).alias("dimension"), "score", F.lit(WEIGHTS[name]).alias("weight"), s.round2(F.col("score") * WEIGHTS[name]).alias("weighted"))
        out = row if out is None else out.unionByName(row)
    return out


def grade(score: Column) -> Column:
    """Half-open ranges, and scores beyond 100 in the last one."""
    out = F.lit(GRADES[-1][1])
    for bound, name in reversed(GRADES[:-1]):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def total(dimensions: DataFrame) -> DataFrame:
    return dimensions.agg(s.round2(F.sum(F.col("score") * F.col("weight"))).alias("total")).withColumn("grade", grade(F.col("total")))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECOMMENDATIONS, "breakdown string, dimension string, threshold int, priority int, advice string")


def recommendations(breakdowns: DataFrame) -> DataFrame:
    """(breakdown, priority, impact, advice) from (breakdown, value): what is above its threshold; one priority up above 50."""
    rules = F.broadcast(rule_table(breakdowns.sparkSession))
    factor = F.create_map(*[F.lit(x) for kv in _IMPACT.items() for x in kv])
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("dimension"))
    return breakdowns.join(rules, "breakdown").where(F.col("value") > F.col("threshold")).select(
        "breakdown", F.greatest(F.lit(1), F.col("priority") - (F.col("value") > 50).cast("int")).alias("priority"),
        s.round_half_up(F.col("value") * weight * F.element_at(factor, F.col("dimension"))).cast("int").alias("impact"), "advice",
    )


def top_issues(candidates: DataFrame, limit: int = 10, key: str = "path") -> DataFrame:
    """The worst of (key, type, score): score desc, then type and key."""
    return candidates.orderBy(F.desc("score"), "type", key).limit(limit)


class GateError(ValueError):
    """The score is above what is allowed."""


def gate(total_row: DataFrame, most: float) -> None:
    score = total_row.first()["total"]
    if score > most:
        raise GateError(f"score {score} is above {most}")
