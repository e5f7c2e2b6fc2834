import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import allpairs, clones


def _jaccard(p, q):
    return len(set(p) & set(q)) / len(set(p) | set(q))


def _distance(p, q):
    row = list(range(len(q) + 1))
    for i, a in enumerate(p, 1):
        old, row = row, [i]
        for j, b in enumerate(q, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return row[-1]


def _variants(seed: int, families: int, sizes: tuple) -> list[list[int]]:
    """Sequences in families, some long enough for wide sketches, over words of which many are common to all."""
    r = random.Random(seed)
    out = []
    for f in range(families):
        base = [r.randrange(60) if r.random() < 0.4 else r.randrange(10**6) for _ in range(r.choice(sizes))]
        out += [[r.randrange(10**6) if r.random() < share else t for t in base[: len(base) - r.randrange(1 + len(base) // 8)]] for share in (0, 0.05, 0.1, 0.15, 0.2, 0.3)]
    return out


def test_edit_distance_is_that_of_the_table():
    r = random.Random(3)
    for _ in range(300):
        p, q = ([r.randrange(5) for _ in range(r.randrange(90))] for _ in range(2))
        assert clones.edit_distance(p, q) == _distance(p, q)


@pytest.mark.parametrize("sides", [1, 5])
def test_no_alike_pair_is_lost_and_few_others_are_kept(spark, monkeypatch, sides):
    monkeypatch.setattr(allpairs, "LEAST_SIDES", sides)
    rows = list(enumerate(sorted(set(x)) for x in _variants(1, 14, (1, 3, 40, 300, 900))))
    sets = spark.createDataFrame(rows, "id long, tokens array<long>")
    want = {(a, b): x for a, p in rows for b, q in rows if a < b and (x := _jaccard(p, q)) >= 0.8}
    assert len(want) > 20
    assert {(r.a, r.b): r.jaccard for r in clones.similar_pairs(sets, 0.8).collect()} == pytest.approx(want)
    found = allpairs.candidates(allpairs.sketches(sets, False), len(rows), False, 0.8, allpairs.jaccard_bound(0.8)).collect()
    assert set(want) <= {(r.a, r.b) for r in found} and len({(r.a, r.b) for r in found}) == len(found)
    # within a family every two share words; joins on shared words had all these as candidates
    assert len(found) < len(want) + 20


def test_approximate_over_long_texts_by_brute_force(spark):
    texts = [" ".join(f"w{t}" for t in x) for x in _variants(2, 5, (30, 200, 560))]
    rows = list(enumerate(texts))
    want = {}
    for a, p in rows:
        for b, q in rows:
            if a < b and p != q:
                u, v = p.split(), q.split()
                most = max(len(u), len(v))
                x = 0.5 * (1 - _distance(u, v) / most) + 0.3 * _jaccard(u, v) + 0.2 * min(len(u), len(v)) / most
                if 0.7 - 1e-12 <= x < 0.95:
                    want[a, b] = x
    got = clones.approximate(spark.createDataFrame(rows, "path long, code string"))
    assert len(want) > 10 and {(r.a, r.b): r.similarity for r in got.collect()} == pytest.approx(want)


def test_keys_may_be_strings_and_sets_empty(spark):
    sets = spark.createDataFrame([("b", [1, 2, 3]), ("a", [3, 2, 1]), ("c", []), ("d", None), ("e", [9])], "id string, tokens array<long>")
    assert [tuple(r) for r in clones.similar_pairs(sets, 0.8).collect()] == [("a", "b", 1.0)]
    assert clones.similar_pairs(sets.where(F.lit(False)), 0.8).count() == 0


def test_sketches_differ_in_no_more_bits_than_tokens():
    r = np.random.default_rng(5)
    for n in (1, 20, 600):
        p = r.integers(-(2**62), 2**62, n)
        q = np.r_[p[: n - n // 10], r.integers(-(2**62), 2**62, n // 10), p[:2]]
        for x, y in zip(allpairs._sketch(p, True)[2:], allpairs._sketch(q, True)[2:]):
            if x and y:
                apart = np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()
                assert apart <= 2 * (n // 10) + 2
