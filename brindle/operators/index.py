"""Queries over symbol and file tables, and their incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s


def exact(symbols: DataFrame, name: str, column: str = "name", order: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Rows of one name, score 1; the first `limit` in the given order, or of all columns that can be ordered."""
    found = symbols.where(F.col(column) == name).withColumn("score", F.lit(1.0))
    return found.orderBy(*(order or [c for c, t in symbols.dtypes if not t.startswith("map")])).limit(limit)


def of_type(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.col("type") == kind)


def fuzzy(symbols: DataFrame, text: str, column: str = "name", tie: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Names that hold the characters of `text` in order, scored by how much of them it is."""
    name = F.col(column)
    score = F.lit(0.1) if not text else F.lit(float(len(text))) / F.greatest(F.length(name), F.lit(len(text)))
    return symbols.where(name.rlike(s.subsequence(text))).withColumn("score", score).orderBy(F.desc("score"), column, *tie).limit(limit)


def substring_score(name: Column, text: str) -> Column:
    """1 for equal, 0.8 for a prefix, 0.6 for a part, in any case; null otherwise."""
    low, t = F.lower(name), text.lower()
    return F.when(low == t, 1.0).when(low.startswith(t), 0.8).when(low.contains(t), 0.6)


def by_glob(symbols: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Names by a glob of * and ?, anchored."""
    regex = "^" + "".join({"*": ".*", "?": "."}.get(c) or s.escape_regex(c) for c in pattern) + "$"
    return symbols.where(F.col(column).rlike(regex))


def structural(
    symbols: DataFrame, path: str | None = None, kind: str | None = None, name: str | None = None, attribute: str | None = None,
    modifier: str | None = None, implements: str | None = None, superclass: str | None = None,
) -> DataFrame:
    """The conjunction of those conditions that are given."""
    out = symbols
    if path:
        out = out.where(F.col("path").rlike(s.glob_regex(path)))
    if kind:
        out = out.where(F.col("type") == kind)
    if name:
        out = by_glob(out, name)
    for column, value in (("attributes", attribute), ("modifiers", modifier), ("implements", implements)):
        if value:
            out = out.where(F.coalesce(F.array_contains(column, value), F.lit(False)))
    if superclass:
        out = out.where(F.col("superclass") == superclass)
    return out


def in_scope(symbols: DataFrame, key: str) -> DataFrame:
    return symbols.where(s.scope_key(F.col("scope")) == key)


def stats(symbols: DataFrame, *dimensions: str) -> DataFrame:
    """Counts by each dimension alone and in total, in one pass: (dimension, value, n)."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = symbols.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(dimensions)) - 1
    label, value = F.lit("total"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("_g") == full - (1 << (len(dimensions) - 1 - i))
        label, value = F.when(here, d).otherwise(label), F.when(here, F.col(d).cast("string")).otherwise(value)
    return grouped.select(label.alias("dimension"), value.alias("value"), "n")


def size_estimate(path: Column, symbols: Column, dependencies: Column) -> Column:
    """Bytes that an in-memory index of a file takes."""
    return F.length(path) * 2 + 64 + symbols * 128 + dependencies * 64


def stale(indexed: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose file is gone."""
    return indexed.join(listed.select(key), key, "left_anti")


def outdated(indexed: DataFrame, listed: DataFrame, key: str = "path", mtime: str = "mtime") -> DataFrame:
    """Listed files that are new or newer than their entry."""
    known = indexed.select(F.col(key).alias("_k"), F.col(mtime).alias("_m"))
    return listed.join(known, (F.col(key) == F.col("_k")) & (F.col("_m") >= F.col(mtime)), "left_anti")


def merge(current: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "path") -> DataFrame:
    """`current` with the rows of changed keys replaced and those of removed keys gone."""
    gone = changed.select(key)
    if removed is not None:
        gone = gone.unionByName(removed.select(key))
    return current.join(gone.distinct(), key, "left_anti").unionByName(changed)
