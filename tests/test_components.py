import random

from brindle.lineage import cut
from brindle.operators import components
from brindle.operators.components import connected


def estimate(df):
    """Bytes that Spark plans with; as a string where Python does not read the number."""
    stats = df._jdf.queryExecution().analyzed().stats()
    try:
        return stats.sizeInBytes()
    except ValueError:
        return stats.simpleString()


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_paths_stars_and_random_edges(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
        edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 - i) for i in range(50)]
        got = {x.node: x.component for x in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == union_find(edges)


def test_no_edges_loops_and_nulls(spark):
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None), (5, 4), (5, 4)], "u long, v long")
    assert sorted((r.node, r.component) for r in connected(odd).collect()) == [(4, 4), (5, 4)]


def test_names(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert {r.node: r.component for r in connected(edges, "src", "dst").collect()} == {"a": "a", "b": "a", "c": "a"}


def test_estimates_do_not_grow_with_rounds(spark, monkeypatch):
    found = []

    def seen(df):
        found.append(cut(df))
        return found[-1]

    monkeypatch.setattr(components, "cut", seen)
    ids = random.Random(1).sample(range(400), 400)
    got = connected(spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(i, 0) for i in range(400)]
    assert len(found) > 20 and [x for df in found if isinstance(x := estimate(df), str) or x >= 2**63] == []


def test_cut_keeps_rows_and_columns_and_small_estimates(spark):
    df = spark.createDataFrame([(1, "a", [1, None], None), (None, None, None, 2.5)], "id long, text string, list array<int>, `odd.name` double")
    rows = df.collect()
    small = cut(df)
    assert small.collect() == rows and estimate(small) == estimate(df) < 2**63
    large = df
    for k in range(8):
        other = large.select(*[large[f"`{c}`"].alias(f"{c}_{k}") for c in df.columns])
        large = cut(large.join(other, large.id.eqNullSafe(other[f"id_{k}"])).select("id", "text", "list", "`odd.name`"))
        assert estimate(large) < 2**63
    assert sorted(large.collect(), key=str) == sorted(rows, key=str) and large.schema == df.schema
    # joined with itself, as other tables are
    assert large.alias("a").join(large.alias("b"), "id").count() == 1
