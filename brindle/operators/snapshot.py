"""Content-hash snapshots, their differences, and compressed views of code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s

# Short codes of symbol types.
SYMBOL_CODES = {
    "function": "f", "class": "c", "variable": "v", "interface": "i", "type": "t", "enum": "e", "module": "m", "property": "p", "parameter": "pm", "constant": "ct",
}


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def file_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", file_hash(F.col(content)).alias("hash"), F.size(F.split(F.col(content), "\n")).alias("lines"))


def project_hash(hashes: DataFrame, buckets: int = 256) -> DataFrame:
    """One hash of all files: a two-level tree, so that no task sees more than a bucket of them.

    Within a bucket 'path:hash' are sorted and joined by '|'; then the buckets' hashes, in order of bucket.
    """
    entry = F.concat_ws(":", "path", "hash")
    leaf = hashes.groupBy(F.pmod(F.crc32("path"), F.lit(buckets)).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "|"), 256).alias("h"))
    return leaf.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "|"), 256).alias("project_hash"), F.count("*").alias("buckets"))


def flat_project_hash(hashes: DataFrame) -> DataFrame:
    """The hash of all sorted 'path:hash' joined by '|', for projects that fit one task."""
    return hashes.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "hash"))), "|"), 256).alias("project_hash"))


def structure(files: DataFrame, content: str = "content") -> DataFrame:
    """(dir, files, lines, exports, imports) of each folder."""
    t = F.col(content)
    return files.groupBy(s.dirname(F.col("path")).alias("dir")).agg(
        F.count("*").alias("files"), F.sum(F.size(F.split(t, "\n"))).alias("lines"),
        F.sum(F.regexp_count(t, F.lit(r"(?m)^\s*export\s"))).alias("exports"), F.sum(F.regexp_count(t, F.lit(r"(?m)^\s*import\s"))).alias("imports"),
    )


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, lines_changed) between two tables of `file_hashes`: added, deleted, modified."""
    a, b = old.toDF("path", "h1", "l1"), new.toDF("path", "h2", "l2")
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "deleted").when(F.col("h1") != F.col("h2"), "modified")
    lines = F.abs(F.coalesce("l2", F.lit(0)) - F.coalesce("l1", F.lit(0)))
    return a.join(b, "path", "full_outer").select("path", change.alias("change"), lines.alias("lines_changed")).where("change is not null")


def apply_diff(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """`old` with the changes of `diff` taken from `new`; equals `new` if all are applied."""
    stays = old.join(changes.select("path"), "path", "left_anti")
    return stays.unionByName(new.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi"))


def compress_medium(text: Column) -> Column:
    """Without comments and blank lines, blanks collapsed, lines trimmed."""
    t = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    t = F.regexp_replace(t, r"(?<!:)//[^\n]*", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _map_text(files: DataFrame, column: str, f, out: str) -> DataFrame:
    names = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [None if t is None else f(t) for t in b[column]]
            yield b

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c in names)
    return files.mapInPandas(run, f"{schema}, `{out}` string")


def signatures(text: str) -> str:
    """Lines that open a declaration at depth 0 or 1, bodies left out."""
    depth, out = 0, []
    head = re.compile(r"^\s*(?:export|import|public|private|protected|internal|static|abstract|async|default|class|struct|protocol|interface|type|enum|function|func|const|let|var|namespace|extension)\b")
    for line in text.split("\n"):
        if depth <= 1 and head.match(line):
            out.append(re.sub(r"\s*\{\s*$", "", line).rstrip())
        depth = max(0, depth + line.count("{") - line.count("}"))
    return "\n".join(out)


def compress_minimal(files: DataFrame, content: str = "content", out: str = "compressed") -> DataFrame:
    return _map_text(files, content, signatures, out)


def short_names() -> Iterator[str]:
    """a, b, ..., z, aa, ab, ..."""
    n = 0
    while True:
        n, name, k = n + 1, "", n + 1
        while k:
            k, r = divmod(k - 1, 26)
            name = chr(97 + r) + name
        yield name


def rename_locals(text: str) -> str:
    """Declared variables of two letters and more, not capitalised, get short names that the text does not use yet; all at once."""
    declared = dict.fromkeys(re.findall(r"\b(?:const|let|var)\s+([a-z_$][\w$]+)", text))
    used = set(re.findall(r"[A-Za-z_$][\w$]*", text))
    free = (n for n in short_names() if n not in used)
    new = {d: next(free) for d in declared}
    return re.sub(r"(?<![\w$.])[A-Za-z_$][\w$]*", lambda m: new.get(m[0], m[0]), text) if new else text


def compress_full(files: DataFrame, content: str = "content", out: str = "compressed") -> DataFrame:
    return _map_text(files.withColumn("_medium", compress_medium(F.col(content))), "_medium", rename_locals, out).drop("_medium")


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(text) / 4)


def compression_ratio(original: Column, compressed: Column) -> Column:
    return s.round2((1 - s.ratio(compressed, original)) * 100)


def symbol_code(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYMBOL_CODES.items() for x in kv]), kind), F.substring(kind, 1, 2))


def stats(files: DataFrame, symbols: DataFrame | None = None, content: str = "content") -> DataFrame:
    """One row: files, lines, estimated tokens and the largest language."""
    out = files.agg(
        F.count("*").alias("files"), F.sum(F.size(F.split(F.col(content), "\n"))).alias("lines"), F.sum(token_estimate(F.col(content))).alias("tokens"), F.mode("language").alias("language")
    )
    return out if symbols is None else out.crossJoin(symbols.agg(F.count("*").alias("symbols")))
