"""Files to lines, with offsets, context and enclosing declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FUNCTION = r"(?:function\s+(\w+)|func\s+(\w+)|def\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()"
CLASS = r"(?:class|struct|interface|protocol)\s+(\w+)"


def to_lines(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",), context: int = 0) -> DataFrame:
    """One row a line: `keep`, line (from 1), text; with `context`, arrays before and after of so many lines.

    Context is cut from the split text of the same row, so no window and no shuffle.
    """
    split = files.select(*keep, F.split(F.col(content), "\n").alias("_lines"))
    lines = split.select(*keep, *(["_lines"] if context else []), F.posexplode("_lines").alias("_at", "text"))
    out = [*keep, (F.col("_at") + 1).alias("line"), "text"]
    if context:
        begin = F.greatest(F.col("_at") - context, F.lit(0))
        out += [
            F.slice("_lines", begin + 1, F.col("_at") - begin).alias("before"),
            F.slice("_lines", F.col("_at") + 2, F.lit(context)).alias("after"),
        ]
    return lines.select(*out)


def with_offsets(lines: DataFrame, key: str = "path") -> DataFrame:
    """`lines` with the offset of each line's first character in its file."""
    order = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("long"))


def enclosing(lines: DataFrame, pattern: str = FUNCTION, key: str = "path", name: str = "function") -> DataFrame:
    """`lines` with the name that the nearest line at or before it declares."""
    groups = pattern.replace(r"\(", "").replace("(?", "").count("(")
    declared = F.lit(None).cast("string")
    for g in range(1, groups + 1):
        declared = F.coalesce(declared, F.nullif(F.regexp_extract("text", pattern, g), F.lit("")))
    order = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(declared, ignorenulls=True).over(order))
