import zlib

import numpy as np
import pytest

from brindle.llm import quality
from brindle.llm.queries import queries


def test_held_out_labels(spark, sf):
    rows = {r.doc_id: r for r in queries()["op8_quality"](spark, sf.replace("0.001", "0.01")).collect()}
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()
    held = [(rows[x.doc_id].score, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([(s >= 0.7) == q for s, q in held]) > 0.9


def test_labels_of_other_rows_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rule = "pmod(crc32(cast(doc_id as string)), 4) <> 2"
    flipped = labels.selectExpr("doc_id", f"if({rule}, quality, 1 - quality) as quality")
    a, b = (quality.train(docs, x, rule) for x in (labels, flipped))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_labels_of_bad_documents_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.train(docs, x, "true") for x in (labels, labels.where("quality = 1")))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_without_negatives(share):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1.2, 1, (8000, 6)), rng.normal(-1.2, 1, (4000, 6))
    n = int(4000 * share)
    got = quality.estimate_prior(good[4000:], np.concatenate([good[:n], bad[: 4000 - n]]))
    assert abs(got - share) < 0.06


def test_fit_by_numerical_descent():
    """The gradient steps end where a plain search of the same risk ends."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (300, 2)), np.concatenate([rng.normal(1, 1, (300, 2)), rng.normal(-1, 1, (300, 2))])
    model = quality.fit(p, u, 0.5, decay=0.0)

    def risk(w, b):
        z = lambda x: np.logaddexp(0, -(model.design(x) @ w + b))
        n = lambda x: np.logaddexp(0, model.design(x) @ w + b)
        return 0.5 * z(p).mean() + max(0.0, n(u).mean() - 0.5 * n(p).mean())

    least = risk(model.weight, model.bias)
    for step in np.concatenate([np.eye(3), -np.eye(3), rng.normal(size=(50, 3))]):
        for size in (0.3, 0.05, 0.01):
            assert risk(model.weight + size * step[:2], model.bias + size * step[2]) > least - 1e-4


def test_repeated_rows_do_not_fill_the_sample(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    many = docs.unionByName(docs.limit(1).crossJoin(spark.range(500)).drop("id"))
    a, b = (quality.train(d, labels, "true") for d in (docs, many))
    assert np.array_equal(a.weight, b.weight)


def test_risk_is_not_below_zero_for_long():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(1.5, 1, (400, 5)), rng.normal(-1.5, 1, (400, 5))
    model = quality.fit(positive[:200], np.concatenate([positive[200:300], negative[:100]]), 0.5)
    assert (model.score(positive[300:]) > 0.5).mean() > 0.95 and (model.score(negative[100:]) < 0.5).mean() > 0.95


def test_features_by_hand():
    import pyarrow as pa

    x = dict(zip(quality.FEATURES, quality.features(pa.array(["a a b\nB!!\n\na a b", None]))[0]))
    assert x["distinct words"] == 3 / 7 and x["repeats of the word before"] == 2 / 7 and x["repeated lines"] == 1 / 3 and x["words ending in a mark"] == 1 / 7


def test_odd_rows(spark, odd_docs, no_docs, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, "true")
    scored = quality.score_quality(odd_docs, model)
    assert set(scored.columns) == {*odd_docs.columns, "predicted"}
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(no_docs, model).count() == 0
    assert quality.train(docs, labels.limit(0), "true") is None
    assert {r.predicted for r in quality.score_quality(odd_docs, None).collect()} == {1}
    assert quality.train(odd_docs, spark.createDataFrame([(4, 1), (None, 1), (6, None), (6, 0)], "doc_id long, quality int"), "true") is not None
