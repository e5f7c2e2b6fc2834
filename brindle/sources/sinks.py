"""Outputs: JSON and Parquet tables, and renderings of small results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes through the commit protocol, so a reader sees all files of a job or none."""
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_dot(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) as lines of the DOT language, without the braces around them."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(";")).alias("value"))


def render(df: DataFrame, style: str = "plain") -> Iterator[str]:
    """Lines of a result for a console: json, minimal, plain, list, markdown or summary; rows come one by one."""
    columns = df.columns
    if style == "summary":
        yield f"{df.count()} rows"
        return
    if style == "markdown":
        yield "| " + " | ".join(columns) + " |"
        yield "|" + "---|" * len(columns)
    if style == "json":
        for row in as_json(df).toLocalIterator():
            yield row[0]
        return
    for i, row in enumerate(df.toLocalIterator(), 1):
        values = ["" if v is None else str(v) for v in row]
        if style == "markdown":
            yield "| " + " | ".join(v.replace("|", "\\|") for v in values) + " |"
        elif style == "list":
            yield f"{i}. " + ", ".join(f"{c}: {v}" for c, v in zip(columns, values))
        elif style == "minimal":
            yield ":".join(values)
        else:
            yield "\t".join(values)
