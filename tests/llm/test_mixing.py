from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm.mixing import mix, source_targets


def by_water_level(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what is above a cap is shared anew until none is."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target = sum(sizes.values()), {}
    open_ = set(order)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 5, "d": 1000, None: 3}, {"x": 7}, {"a": 1, "b": 1, "c": 10_000, "é": 500, "z": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([("n" if k is None else "s" + k, k, v) for k, v in sizes.items()], "key string, source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(by_water_level(sizes))


def test_mix_meets_targets_and_repeats(spark, docs):
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and 0 <= r.rate <= 3
        taken[r.source] += r.taken
        target[r.source] = r.target
    sizes = {s: sum(r.size for r in rows if r.source == s) for s in target}
    assert target == pytest.approx(by_water_level(sizes))
    for s in target:
        # within the smallest documents that could still be added or taken away
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 60)
    again = sorted((r.doc_id, r.taken) for r in mix(docs.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in rows)


def test_rates_are_an_exponential_tilt(spark, docs):
    import math

    rows = [r for r in mix(docs).collect() if r.size and 1e-9 < r.rate < 3 - 1e-9]
    slopes = defaultdict(set)
    for r in rows:
        slopes[r.source].add(round(math.log(2 * r.rate / (3 - r.rate)) / r.size, 7))
    assert all(max(v) - min(v) < 1e-5 for v in slopes.values())
    total = defaultdict(float)
    for r in mix(docs).collect():
        total[r.source] += r.rate * r.size
    want = {r.source: r.target for r in mix(docs).collect()}
    assert dict(total) == pytest.approx(want, rel=1e-6)


def test_hot_cell_is_salted(spark, monkeypatch):
    from brindle.llm import mixing

    monkeypatch.setattr(mixing, "CELL_DOCS", 50)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = {r.source: (r.t, r.target) for r in mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) <= 2 for t, target in got.values())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mix(no_docs).count() == 0
    assert mix(odd_docs.where("doc_id <= 3")).agg(F.sum("taken")).first()[0] == 0


def test_one_id_a_third_of_all_rows(spark, monkeypatch):
    from brindle.llm import mixing

    monkeypatch.setattr(mixing, "CELL_DOCS", 50)
    df = spark.range(1200).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("three words each").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    rows = mix(df).collect()
    assert len(rows) == 1200
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)


def test_many_sources(spark):
    sizes = {f"source {i:04d}": 1 + (i * 7919) % 1000 for i in range(1500)} | {None: 17}
    df = spark.createDataFrame([("n" if k is None else "s" + k, k, v) for k, v in sizes.items()], "key string, source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(by_water_level(sizes))
