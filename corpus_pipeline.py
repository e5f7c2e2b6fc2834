"""From raw documents to packed token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything that the one
before it kept; all but the last return the columns of documents.  Rows travel
as one struct beside what a stage adds, so columns of any other names pass
through untouched.  A stage on an empty table returns an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.lineage import cut, shared_folder
from brindle.llm.decontam import decontaminate
from brindle.llm.mixing import mix
from brindle.llm.neardup import near_duplicates
from brindle.llm.packing import pack_tokens
from brindle.llm.quality import score_quality, train
from brindle.llm.queries import vocabulary
from brindle.session import reachable


def _wrapped(docs: DataFrame, *columns) -> DataFrame:
    """The rows as a struct `row`, and the columns that the stage works on."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on all labels, rejects.

    Null and empty texts are scored like others, as documents without words;
    repeated rows are scored alike.  Labels of unknown or null ids and null
    labels count for nothing, and without a positive label all rows stay.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "true")
    return score_quality(_wrapped(docs, "text"), model).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id.

    Rows of one id are one document: where it is kept, each of its different
    texts stays, once; of rows that differ in other columns alone one stays,
    chosen by a hash of the row.  Null, empty and blank texts are like nothing
    and stay, and so do rows without an id.
    """
    found = near_duplicates(docs).where("kept and doc_id is not null")
    kept = cut(found.groupBy("doc_id").agg(F.count("*").alias("rows")))
    given = _wrapped(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ids grow with the table: joined by a shuffle, not sent to the driver and around
    own = given.join(kept.hint("merge"), "doc_id")
    stays = own.where("rows = 1").select("row")
    if not kept.where("rows > 1").isEmpty():
        stays = stays.unionByName(own.where("rows > 1").groupBy("doc_id", "text").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row"))
    return stays.unionByName(given.where("doc_id is null").select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go alike;
    without items all rows stay.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their targets.

    Null is a source of its own; null, empty and blank texts stay once.  Rows
    that agree in id, source and text share the largest number of copies that
    one of them gets; null ids are compared like others.
    """
    key = (F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("digest"))
    mixed = mix(docs.select(*key, "text"), keep=("digest",))
    copies = mixed.groupBy(*[F.col(c).alias(f"of_{c}") for c in ("doc_id", "source", "digest")]).agg(F.max("copies").alias("copies")).where("copies > 0")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("doc_id", "source", "digest")]
    return _wrapped(docs, *key).join(copies, same).select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids; null and empty texts are an end id alone, repeated rows are packed each."""
    return pack_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", reachable(quality)),
    ("near_dedup", reachable(near_dedup)),
    ("decontamination", reachable(decontamination)),
    ("mixing", reachable(mixing)),
    ("packing", reachable(packing)),
]

#: Fitting a classifier and encoding are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage wrote is removed when the next one is through."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
