import time

from brindle.streaming.changes import Caches, Watch


def test_pause_resume_and_flush_lose_nothing(spark, tmp_path):
    source, seen = tmp_path / "events", []
    source.mkdir()

    def put(k):
        df = spark.createDataFrame([(f"f{k}", "change", k)], "path string, change string, n int").selectExpr("path", "change", "timestamp_seconds(n) as ts")
        df.coalesce(1).write.mode("append").parquet(str(source))

    put(1)
    schema = spark.read.parquet(str(source)).schema
    watch = Watch(lambda: spark.readStream.schema(schema).parquet(str(source)), lambda batch, _: seen.extend(r.path for r in batch.collect()), str(tmp_path / "state"))
    watch.flush()
    assert seen == ["f1"] and not watch.active and watch.status()["batches"] >= 1
    watch.resume("100 milliseconds")
    put(2)
    for _ in range(100):
        if "f2" in seen:
            break
        time.sleep(0.2)
    assert watch.active and "f2" in seen
    watch.pause()
    put(3)
    assert not watch.active and "f3" not in seen
    watch.flush()
    assert sorted(seen) == ["f1", "f2", "f3"]


def test_caches_by_name(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    caches = Caches()
    caches.warm_up({"a.x": make, "b": make})
    assert caches.get("a.x", make).count() == 5 and len(made) == 2
    assert caches.stats() == [("a.x", 1, 1, True), ("b", 0, 1, True)]
    assert caches.invalidate("a.") == ["a.x"] and caches.stats()[0] == ("a.x", 1, 1, False)
    caches.invalidate()
