import random
import re

import pytest

from brindle.llm.neardup import near_duplicates
from brindle.llm.queries import oracle_sql, queries

from .. import oracle


def brute_force(rows, n, percent):
    """Exact components over all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    component = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(component[a], component[b])
            if component[a] != m or component[b] != m:
                component[a] = component[b] = m
                changed = True
    return {i: (len(sets[i]), component[i], component[i] == i) for i in ids}


@pytest.mark.parametrize("words", [4, 5])
def test_as_brute_force(spark, docs, words):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=words).collect()}
    assert got == brute_force(rows, words, 80)


def test_as_sql(spark, sf):
    name = "op4_near_duplicates"
    assert oracle.compare(queries()[name](spark, sf), oracle.connection(sf), oracle_sql()[name]) == ""


def test_families_chains_and_thresholds(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(40)]  # a family of near copies
    rows += [(100 + k, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 50))) for k in range(6)]  # each overlaps the next
    rows += [(200 + k, "shared passage of many words that is in all of them " + " ".join(f"u{k}x{j}" for j in range(30))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=4).collect()}
    assert got == brute_force(rows, 4, 80)


def test_blocks_in_pieces(spark, monkeypatch):
    from brindle.llm import neardup

    monkeypatch.setattr(neardup, "PIECE_DOCS", 7)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=4).collect()}
    assert got == brute_force(rows, 4, 80)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_docs, words=4).collect())
    assert got[0] == (0, 1, None, True)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert got.count((5, 1, 5, True)) == 2
    assert (6, 2, 6, True) in got and (7, 2, 6, False) in got
    assert near_duplicates(no_docs).count() == 0


def test_ids_with_several_texts_and_none(spark):
    text = [f"a{i}" for i in range(40)]
    near, other = text[:39] + ["changed"], [f"b{i}" for i in range(40)]
    rows = [(1, " ".join(other)), (1, " ".join(text)), (3, " ".join(near)), (2, " ".join(other)), (None, " ".join(text)), (1, " ".join(text)), (9, "z " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, 37, 1, True), (1, 37, 1, True), (1, 37, 1, True), (3, 37, 1, False), (2, 37, 1, False), (9, 1, 9, True)])
    for some in (df, df.orderBy("text"), df.orderBy("doc_id")):
        got = [tuple(r) for r in near_duplicates(some, words=4).collect()]
        assert sorted(r for r in got if r[0] is not None) == want and [r for r in got if r[0] is None] == [(None, 37, None, True)]


def test_large_families_of_several_parts_with_outsiders(spark, monkeypatch):
    from brindle.llm import neardup

    monkeypatch.setattr(neardup, "PIECE_DOCS", 5)
    rows = []
    for k in range(3):
        # a chain: each text is like the next one only, and many lists are shared by all
        words = [f"k{k}w{i}" for i in range(90)]
        rows += [(100 * k + i, " ".join(words[i : i + 60] + [f"k{k}c{j}" for j in range(30)])) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words=4).collect()}
    assert got == brute_force(rows, 4, 80)


def test_estimates_stay_small_on_long_chains(spark, monkeypatch):
    from brindle.llm import neardup
    from brindle.operators import components

    from ..test_components import estimate

    found, cut = [], components.cut

    def seen(df):
        found.append(cut(df))
        return found[-1]

    for module in (neardup, components):
        monkeypatch.setattr(module, "cut", seen)
    # each text is like its neighbours in the chain only, and ids are in no order
    ids = random.Random(2).sample(range(150), 150)
    rows = [(i, " ".join(f"c{j}" for j in range(3 * k, 3 * k + 50))) for k, i in enumerate(ids)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == brute_force(rows, 4, 80)
    assert [x for df in found if isinstance(x := estimate(df), str) or x >= 2**63] == []
