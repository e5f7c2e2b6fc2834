from collections import Counter

import pytest

from .test_decontam import tiles_by_definition
from .test_neardup import brute_force

import corpus_pipeline as p


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in p.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(spark, sf, stages):
    want = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(df.columns == want for df in stages[:4])


def test_quality(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = ids(stages[0])
    assert all(n == 1 for n in kept.values())
    right = [(kept[d] == 1) == (q == 1) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.9


def test_near_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    assert ids(stages[1]) == Counter(i for i, (_, _, kept) in brute_force(rows, 5, 80).items() if kept)


def test_decontamination(spark, sf, stages):
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def holds(text, item):
        w = words(text)
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if not any(tuple(item[k : k + 5]) in have for k in range(len(item) - 4)):
            return False
        return tiles_by_definition(item, w, 5) >= 0.5 * len(item)

    want = Counter(r.doc_id for r in stages[1].collect() if not any(holds(r.text, i) for i in items))
    assert ids(stages[2]) == want and sum(want.values()) < stages[1].count()


def test_mixing(stages):
    before, after = ids(stages[2]), ids(stages[3])
    assert set(after) <= set(before) and max(after.values()) <= 3
    words = lambda df: sum(len(r.text.split()) for r in df.select("text").collect())
    assert abs(words(stages[3]) / words(stages[2]) - 1) < 0.02


def test_packing(stages):
    packed = Counter(d for r in stages[4].collect() for d, k in zip(r.doc_ids, r.pieces) if k == 0)
    assert packed == ids(stages[3])


def test_run(spark, sf, stages):
    assert p.run(spark, sf).count() == pytest.approx(stages[4].count(), abs=2)
    assert p.ORACLE_SQL is None


@pytest.fixture(scope="module")
def clashing(spark, odd_docs):
    """Odd rows with columns of every name that a stage might use."""
    names = ("score", "predicted", "_id", "_copies", "_copy", "copies", "copy", "row", "size", "key", "rate", "kept", "rows", "digest", "of_source")
    return odd_docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"'{n} of ' || coalesce(text, '-') as `{n}`" for n in names])


def whole(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES], ids=[n for n, _ in p.STAGES])
def test_stages_on_odd_rows_and_no_rows(spark, sf, clashing, stage):
    none = stage(spark, clashing.limit(0), sf)
    assert none.count() == 0
    got = stage(spark, clashing, sf)
    if stage is p.STAGES[-1][1]:
        assert {d for r in got.collect() for d in r.doc_ids} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
        return
    assert got.columns == clashing.columns == none.columns
    before, after = whole(clashing), whole(got)
    # values of all columns come through as they were
    assert set(after) <= set(before)
    left = Counter(r[0] for r in after.elements())
    if stage is p.STAGES[1][1]:
        assert left == {1: 1, 2: 1, 3: 1, None: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1}
    if stage is p.STAGES[2][1]:
        assert after == before
    if stage is p.STAGES[3][1]:
        assert all(left[i] == 1 for i in (1, 2, 3)) and max(after.values()) <= 6


def test_every_text_of_an_id_is_kept_once(spark, sf):
    text = [f"a{i}" for i in range(40)]
    rows = [(1, "quite another text", "a"), (1, " ".join(text), "a"), (1, " ".join(text), "b"), (3, " ".join(text[:39] + ["changed"]), "a"), (None, "x", "a"), (None, "x", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = p.near_dedup(spark, df, sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == {(1, "quite another text"): 1, (1, " ".join(text)): 1, (None, "x"): 2}


def test_rows_without_ids_do_not_share_their_copies(spark, sf):
    rows = [(None, f"words {i} of the one", "a") for i in range(300)] + [(i, f"words {i} of the other", "b") for i in range(300)]
    got = p.mixing(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"a": 200, "b": 400}


def test_run_leaves_only_the_result(spark, sf):
    import glob
    import urllib.parse

    files = p.run(spark, sf).inputFiles()
    folder = urllib.parse.urlparse(files[0]).path.rsplit("/", 2)[0]
    assert [f.rsplit("/", 1)[1] for f in glob.glob(f"{folder}/*")] == ["packing"]


def test_near_dedup_plans_with_small_estimates_on_long_chains(spark, sf, monkeypatch):
    from brindle.operators import components

    from ..test_components import estimate

    found, cut = [], components.cut

    def seen(df):
        found.append(cut(df))
        return found[-1]

    monkeypatch.setattr(components, "cut", seen)
    # each text is like its neighbours in the chain only, and ids are in no order
    rows = [(k * 37 % 120, " ".join(f"c{j}" for j in range(2 * k, 2 * k + 50))) for k in range(120)]
    got = p.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert [r.doc_id for r in got] == [0]
    assert [x for df in found if isinstance(x := estimate(df), str) or x >= 2**63] == []


def test_workers_need_little_beside_their_texts():
    import tracemalloc

    import pyarrow as pa

    from brindle.llm import decontam, neardup, quality, textkit

    texts = pa.array([" ".join(f"w{i * 7 + j * j % 911}" for j in range(400)) for i in range(1_500)])
    assert texts.nbytes > 2_000_000
    textkit._cache.clear()
    tracemalloc.start()
    try:
        assert len(quality.features(texts)) == len(texts)
        assert sum(b - a for a, b, *_ in neardup._sets(texts, 5)) == len(texts)
        assert sum(b - a for a, b, *_ in decontam._plain_words(texts)) == len(texts)
        # executors hold a worker for each core, which keep what they once had
        assert tracemalloc.get_traced_memory()[1] < 40_000_000
    finally:
        tracemalloc.stop()
