import datetime as dt

from pyspark.sql import functions as F

from brindle.streaming import changes

T0 = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame([(p, c, T0 + dt.timedelta(seconds=s)) for p, c, s in rows], "path string, change string, ts timestamp")


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [("a", "add", 0), ("a", "change", 10), ("b", "add", 5), ("a", "unlink", 4000), ("c", "add", 9000)]
    batch = _events(spark, rows)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f in (
        ("debounced", lambda df, d=None: changes.debounced(df, "1 minute", d)), ("tumbling", lambda df, d=None: changes.tumbling(df, "1 hour", "path", d)),
        ("sessions", lambda df, d=None: changes.sessions(df, "path", "30 minutes", d)),
    ):
        q = f(stream, "1 minute").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(batch).collect()))


def test_index_upkeep_by_stream(spark, tmp_path):
    _events(spark, [("x/a.ts", "add", 0), ("x/a.ts", "unlink", 1), ("y/b.ts", "change", 2)]).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("path string, change string, ts timestamp").parquet(str(tmp_path / "in"))
    changes.start_index(stream, lambda b, i: seen.extend((r.path, r.change) for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("x/a.ts", "unlink"), ("y/b.ts", "change")]
    changes.start_index(stream, lambda b, i: seen.append("again"), str(tmp_path / "cp")).awaitTermination()
    assert "again" not in seen


def test_folded(spark):
    current = _events(spark, [("d/a", "add", 0), ("d/sub/b", "add", 0), ("e", "add", 0), ("f", "add", 0)]).drop("change")
    todo = _events(spark, [("d", "unlinkDir", 10), ("d/c", "add", 20), ("e", "unlink", 5), ("g", "add", 6)])
    assert sorted(r.path for r in changes.folded(current, todo).collect()) == ["d/c", "f", "g"]


def test_filters(spark):
    df = _events(spark, [("a.ts", "add", 0), ("a.md", "add", 0), ("node_modules/x.ts", "add", 0), ("dir", "unlinkDir", 0), ("b.ts", "odd", 0)])
    assert sorted(r.path for r in changes.accepted(df, (".ts",), ("**/node_modules/**",)).collect()) == ["a.ts", "dir"]


def test_histories_and_caches(spark):
    df = spark.createDataFrame([(1, i, T0 + dt.timedelta(seconds=i)) for i in range(5)], "k long, event_id long, ts timestamp")
    assert sorted(r.event_id for r in changes.capped_history(df, "k", 2).collect()) == [3, 4]
    assert [r.event_id for r in changes.as_of(df, "k", T0 + dt.timedelta(seconds=2)).collect()] == [2]
    health = spark.range(1).select(changes.cache_health(F.lit(90), F.lit(10), F.lit(0), F.lit(0.0), F.lit(5)).alias("h")).first().h
    assert health == 36 + 30 + 20 + 5
    items = spark.createDataFrame([("a", 1, 9, 5, 3), ("b", 2, 1, 7, 9), ("c", 3, 4, 1, 2)], "key string, created int, accessed int, uses int, expires int")
    first = lambda p, **k: [r.key for r in changes.evicted(items, p, 1, **k).collect()]
    assert (first("lru"), first("lfu"), first("fifo"), first("ttl", now=5)) == (["b"], ["c"], ["a"], ["c"])
