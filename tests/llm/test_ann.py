import numpy as np
import pytest

from brindle.llm.ann import Centroids, Settings, balanced_centroids, fitted, nearest
from brindle.llm.queries import oracle_sql, queries

from .. import oracle


def exact(rows, is_query, k=10):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    out = {}
    for q, v in rows:
        if is_query(q):
            d = np.sqrt(((m - np.array(v)) ** 2).sum(1))
            ok = ids != q
            out[q] = ids[ok][np.lexsort((ids[ok], d[ok]))][:k].tolist()
    return out


def test_as_sql(spark, sf):
    name = "op10_neighbours"
    assert oracle.compare(queries()[name](spark, sf), oracle.connection(sf), oracle_sql()[name]) == ""


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 2
    v = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact(rows, lambda i: i % 20 == 0)
    got = {}
    for r in nearest(df, "vec_id % 20 = 0", settings=Settings(per_list=60, least=0)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    found = sum(len({v for _, v in got[q]} & set(w)) for q, w in want.items())
    assert found / sum(map(len, want.values())) >= 0.9
    assert all(sorted(r for r, _ in g) == list(range(1, 11)) for g in got.values())


def searched(v, per_list, probes=50, **given):
    """Recall at 10 by brute force, the shares of lists and of rows that are read, and copies of a row in lists."""
    s = Settings(per_list=per_list, **given)
    c = fitted(np.unique(v[: s.sample], axis=0), len(v) // per_list, 10, s)
    posts, use = c.posts(v)
    own = np.bincount(posts[:, 0], minlength=len(c.centres))
    at = np.linspace(0, len(v) - 1, probes).astype(int)
    found = rows = lists = 0
    for i, read in zip(at, c.read(v[at], own, 11)):
        d = np.linalg.norm(v - v[i], axis=1)
        d[i] = np.inf
        seen = (np.isin(posts, read) & use).any(1)
        found, rows, lists = found + seen[np.argsort(d, kind="stable")[:10]].sum(), rows + seen.mean(), lists + len(read) / len(c.centres)
    return found / probes / 10, lists / probes, rows / probes, use.sum(1).mean()


@pytest.mark.parametrize("count, per_list", [(12_000, 20), (60_000, 25)])
def test_recall_of_what_is_read_without_structure(count, per_list):
    v = np.random.default_rng(6).normal(size=(count, 64))
    recall, *_ = searched(v / np.linalg.norm(v, axis=1)[:, None], per_list)
    assert recall >= 0.98


def test_pruning_and_replication_act_on_clusters():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 32))[rng.integers(0, 200, 30_000)] + 0.3 * rng.normal(size=(30_000, 32))
    recall, lists, rows, copies = searched(v, 40)
    assert recall >= 0.98 and lists < 0.33 and rows < 0.33 and copies > 1.05, (recall, lists, rows, copies)


def test_queries_on_their_own_centroid_get_all_they_ask_for(spark):
    # one common vector and ten others far apart: every query is the centroid of its list
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(1, 2971)] + [(10_000 * (i + 1), [0.0, float(i + 2), float(i * i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, "vec_id % 10000 = 0").groupBy("query_id").count().collect()
    assert [r["count"] for r in got] == [10] * 10
    few = nearest(df, "vec_id % 10000 = 0", settings=Settings(per_list=2, prune=1.0, least=0)).groupBy("query_id").count().collect()
    assert [r["count"] for r in few] == [10] * 10


def test_recall_of_the_operator_with_hundreds_of_lists(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(6000, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = exact(rows, lambda i: i % 300 == 0), {}
    for r in nearest(df, "vec_id % 300 = 0", settings=Settings(per_list=10, least=0)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.98


def test_small_lists_are_read_on(spark):
    # every list has two equal vectors, so the nearest one's distance is 0 and no other is within a ratio of it
    rows = [(i, [float(i // 2 * 100), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, "vec_id % 20 = 0", settings=Settings(per_list=2, least=0)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(g) for q, g in got.items()} == {0: 10, 20: 10}


def test_walk_finds_the_nearest():
    rng = np.random.default_rng(4)
    c = Centroids(balanced_centroids(rng.normal(size=(3000, 8)), 200))
    q = rng.normal(size=(100, 8))
    at, d = c.walk(q, 32)
    assert (np.diff(d) >= 0).all() and all(len(set(x)) == 32 for x in at.tolist())
    assert 4 * 32 < len(c.centres)
    every = np.linalg.norm(q[:, None] - c.centres, axis=2)
    assert (at[:, 0] == every.argmin(1)).mean() >= 0.97
    assert np.allclose(np.take_along_axis(every, at, 1), d)


def test_hot_vector_and_small_parts(spark, monkeypatch):
    from brindle.llm import ann

    monkeypatch.setattr(ann, "PART_ROWS", 16)
    monkeypatch.setattr(ann, "PART_QUERIES", 4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i % 17), float(i % 5), 1.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [0.5, 0.5]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (100, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1.0 as score", "7 as rank")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(df, "vec_id % 100 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9), (0, 2, 8), (0, 3, 100), (100, 1, 8), (100, 2, 0), (100, 3, 9)]
    assert nearest(df.limit(0), "vec_id % 100 = 0").count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest(one, "vec_id % 100 = 0").count() == 0


def test_huge_and_tiny_numbers(spark):
    rows = [(i, [float(10.0 ** (200 - i)), 1e-200 * i, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows, lambda i: i % 20 == 0)
