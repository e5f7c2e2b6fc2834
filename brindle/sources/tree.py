"""Scans of source trees and adapters that read other tables as files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as s

# Extensions and the languages they stand for.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".swift": "swift", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".vue": "vue",
}
DEFAULT_EXCLUDES = ("**/node_modules/**", "**/dist/**", "**/.git/**", "**/coverage/**", "**/build/**", "**/.build/**")
MAX_FILE_SIZE = 1_048_576


def language_of(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("unknown"))


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the globs matches the path."""
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{s.glob_regex(p)})" for p in dict.fromkeys(patterns)))


def included(path: Column, extensions: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    ok = ~excluded(path, exclude)
    if extensions:
        ok &= F.lower(s.extension(path)).isin([e.lower() for e in extensions])
    if include:
        ok &= excluded(path, include)
    return ok


def contains_component(path: Column, names: tuple[str, ...]) -> Column:
    """Substring semantics of the dependency scan: a path is left out if it contains one of the names."""
    found = F.lit(False)
    for n in names:
        found |= path.contains(n)
    return found


def read_tree(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(LANGUAGES), include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = DEFAULT_EXCLUDES, max_size: int = MAX_FILE_SIZE, max_depth: int | None = None,
) -> DataFrame:
    """The FILES table of a folder.

    Names, sizes and depth are filtered on file metadata, so files left out are
    not read.  Larger files than `max_size` are skipped.
    """
    base = re.sub(r"/+$", "", root)
    glob = "*{" + ",".join(extensions) + "}" if extensions else "*"
    raw = (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
        .select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    )
    path = F.regexp_replace(F.regexp_replace("file_path", "^file:/+", "/"), "^.*?" + s.escape_regex(base.split(":")[-1]) + "/+", "")
    files = raw.withColumn("path", path).where(F.col("file_size") <= max_size).where(included(F.col("path"), (), include, exclude))
    if max_depth is not None:
        files = files.where(s.path_depth(F.col("path")) - 1 <= max_depth)
    return as_files(files, "path", "value", "file_size", "file_modification_time")


def as_files(df: DataFrame, path: str | Column, content: str | Column, size=None, mtime=None) -> DataFrame:
    """Any table with a path and a text as FILES."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    path, content = c(path), c(content)
    ext = s.extension(path)
    return df.select(
        path.alias("path"), content.alias("content"),
        (c(size) if size is not None else F.octet_length(content)).cast("long").alias("size"),
        (c(mtime) if mtime is not None else F.lit(None)).cast("timestamp").alias("mtime"),
        ext.alias("extension"), language_of(ext).alias("language"), F.sha2(content, 256).alias("sha256"),
    )


def documents_as_files(documents: DataFrame) -> DataFrame:
    """documents -> FILES at source/lang/doc_id."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return as_files(documents, path, "text")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration file as one row."""
    return spark.read.option("multiLine", True).json(path)


def merged_options(*layers: dict) -> dict:
    """Later layers override earlier ones; values of None do not."""
    out: dict = {}
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None}
    return out
