import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from brindle.llm.sharding import kd_shards


def check(rows, shards, near=None):
    slots, size, texts = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        texts[r.text_crc32, r["size"]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if near:
        mean = sum(size.values()) / shards
        assert max(size.values()) - min(size.values()) <= near * mean
    return texts


def test_balanced_whole_groups(spark, docs):
    rows = kd_shards(docs, shards=8).collect()
    want = {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want and len(rows) == len(want)
    assert all(len(s) == 1 for s in check(rows, 8, near=0.15).values())
    again = {r.doc_id: (r.shard, r.slot) for r in kd_shards(docs.repartition(5), shards=8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_target_bytes_and_compact_leaves(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"), F.lit("en").alias("lang"))
    rows = kd_shards(df, target_bytes=19 * 500).collect()
    assert {r.shard for r in rows} == set(range(8))
    check(rows, 8, near=0.01)
    # only one dimension is wide, so shards are runs of it
    by = sorted((r.doc_id, r.shard) for r in rows)
    assert sum(a[1] != b[1] for a, b in zip(by, by[1:])) == 7


def test_hot_text_is_dealt_in_pieces(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a very common text").otherwise(F.concat(F.lit("text number "), F.lpad(F.col("id").cast("string"), 6, "0"))).alias("text")
    )
    texts = check(kd_shards(df, shards=8).collect(), 8, near=0.05)
    assert sum(len(s) > 1 for s in texts.values()) == 1


def test_strings_with_a_long_common_prefix_are_a_dimension(spark):
    df = spark.range(2000).select(
        F.expr("pmod(hash(id), 100000)").cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("text"),
        F.concat(F.lit("https://a.very.long.host.example/path/"), F.lpad((F.col("id") % 500).cast("string"), 4, "0")).alias("url"),
    )
    rows = kd_shards(df, shards=4, dimensions=("url",)).collect()
    check(rows, 4, near=0.01)
    url = {(r.doc_id, r.text_crc32): r.url for r in df.withColumn("text_crc32", F.crc32(F.encode("text", "UTF-8"))).collect()}
    spans = defaultdict(list)
    for r in rows:
        spans[r.shard].append(url[r.doc_id, r.text_crc32])
    ends = sorted((min(u), max(u)) for u in spans.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_a_third_of_the_rows_repeated(spark, monkeypatch):
    from brindle.llm import sharding

    monkeypatch.setattr(sharding, "SLOT_DOCS", 50)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same row").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = kd_shards(df, shards=8).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in rows) == Counter((r.doc_id, zlib.crc32(r.text.encode())) for r in df.collect())
    check(rows, 8, near=0.05)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = kd_shards(odd_docs, shards=8).collect()
    assert len(rows) == odd_docs.count()
    check(rows, 8)
    by = {r.doc_id: r for r in rows}
    assert by[1]["size"] == by[2]["size"] == 1 and by[1].text_crc32 == 0
    assert kd_shards(no_docs, shards=8).count() == 0
    assert kd_shards(odd_docs.select("doc_id", "text"), shards=1, dimensions=()).count() == odd_docs.count()
