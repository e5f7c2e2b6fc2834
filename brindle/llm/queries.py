"""Queries that apply each operator to its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontam import contaminated
from .lattice import lattice_scores
from .mixing import mix
from .neardup import near_duplicates
from .packing import pack_tokens
from .pii import pseudonymise
from .quality import score_quality, train
from .sharding import kd_shards
from .tokencount import count_tokens

#: Of the pseudonyms' permutations; a deployment passes its own.
PSEUDONYM_KEY = b"brindle example key, not a secret"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lattice_scores(
        _table(spark, sf_dir, "documents"), "pmod(crc32(cast(doc_id as string)), 5) <> 1", vocabulary("piece_bpe_32k.model")
    )
    return scores.withColumn("held_out", F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 5) = 1, true)"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), "pmod(crc32(cast(doc_id as string)), 4) <> 2")
    return score_quality(docs, model).select(
        "doc_id", F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 4) = 2, true)").alias("held_out"), "score", "predicted"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"), shards=8)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontamination, op2_packing, op3_lattice, op4_near_duplicates, op5_mixing,
        op6_token_counts, op7_pseudonyms, op8_quality, op9_sharding, op10_neighbours,
    )
    return {f.__name__: f for f in own}


_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.doc_id = d.doc_id
"""

_NEAREST = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, g.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (g.v[i] - q.v[i]) * (g.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM good q JOIN good g ON g.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": _NEAR, "op10_neighbours": _NEAREST}
