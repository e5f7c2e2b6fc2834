import random

from brindle.llm.decontam import contaminated, decontaminate, tile
from brindle.llm.textkit import stream


def tiles_by_definition(a, b, least):
    """Greedy string tiling by comparing everything with everything."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= least:
                    best.append((n, i, j))
        if not best:
            return sum(n for n, _, _ in out)
        n, i, j = min(best, key=lambda m: (-m[0], m[1], m[2]))
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        out.append((n, i, j))


def test_tiles_as_defined():
    rng, values = random.Random(3), stream(6, 1)
    for _ in range(150):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(3, 25))] for _ in "ab")
        if rng.random() < 0.7:
            b[5:5] = a[len(a) // 2 :] + [0] + a[: len(a) // 2]
        got = tile(values[a], values[b], 3)
        covered = [k for i, _, n in got for k in range(i, i + n)]
        assert len(covered) == len(set(covered))
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
        assert sum(n for _, _, n in got) == tiles_by_definition(a, b, 3)


def _items(spark):
    return spark.createDataFrame(
        [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."), (2, "too short"), (3, None), (4, ""), (5, "quite another item of the test set, never seen in a text")],
        "item_id long, text string",
    )


def test_copies_reordered_passages_and_clean_texts(spark):
    texts = [
        (1, "before Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. after"),
        (2, "ETA!! THETA, iota kappa lambda mu ... and then: alpha beta gamma delta epsilon zeta"),
        (3, "alpha beta gamma delta and nothing more of it"), (4, "too short"), (5, None), (6, ""),
        (7, "filler " * 20_000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " + "filler " * 20_000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.item_words, r.covered_words, r.tiles) for r in contaminated(df, _items(spark)).collect()}
    assert got == {1: (1, 12, 12, 1), 2: (1, 12, 12, 2), 7: (1, 12, 12, 1), 4: (2, 2, 2, 1)}
    assert {r.doc_id for r in decontaminate(df, _items(spark)).collect()} == {3, 5, 6}


def test_covered_words_as_defined_with_runs_far_apart(spark):
    rng, texts, items = random.Random(11), [], []
    for k in range(12):
        items.append((k, [f"i{rng.randrange(40)}" for _ in range(rng.randrange(6, 40))]))
    for k in range(60):
        words = [f"t{rng.randrange(500)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(1, 7)):
            item = rng.choice(items)[1]
            a = rng.randrange(len(item))
            words += item[a : a + rng.randrange(3, 14)] + [f"t{rng.randrange(500)}" for _ in range(rng.choice((0, 1, 2, 50)))]
        texts.append((k, words))
    want = {}
    for d, t in texts:
        for i, w in items:
            n = tiles_by_definition(w, t, 5)
            if n >= 0.4 * len(w):
                want[d, i] = (len(w), n)
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string")
    of = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_words, r.covered_words) for r in contaminated(df, of, coverage=0.4).collect()}
    assert got == want and len(want) > 30


def test_two_runs_fifty_words_apart_cover_both(spark):
    item = " ".join([f"h{i}" for i in range(1, 6)] + ["x"] + [f"k{i}" for i in range(1, 6)] + [f"z{i}" for i in range(11)])
    text = " ".join([f"h{i}" for i in range(1, 6)] + ["k1"] + ["word"] * 50 + [f"k{i}" for i in range(1, 6)])
    row = contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.3).first()
    assert (row.item_words, row.covered_words) == (22, 10)


def test_other_alphabets_and_short_items(spark):
    items = [(1, "Съешь ещё этих мягких французских булок, да выпей чаю"), (2, "世界上最高的山峰是什么"), (3, "forty two"), (4, "Ｆｕｌｌ ｗｉｄｔｈ ｌｅｔｔｅｒｓ ｏｆ ａｎ ｉｔｅｍ"), (5, "!!! ...")]
    texts = [
        (1, "… СЪЕШЬ ЕЩЁ ЭТИХ МЯГКИХ «ФРАНЦУЗСКИХ» БУЛОК — ДА ВЫПЕЙ ЧАЮ!"), (2, "问题：世界上最高的山峰是什么？"), (3, "it is forty-two, they say"), (4, "forty of two"),
        (5, "full width letters of an item"), (6, "世界很大"),
    ]
    got = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in got} == {(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (5, 4, 1.0)}


def test_blocks_give_the_same(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, contaminated(docs, items).collect()))
    assert one == sorted(map(tuple, contaminated(docs, items, block_words=100).collect())) and one
    assert decontaminate(docs, items, block_words=200).count() == docs.count() - len({r[0] for r in one})


def test_odd_rows(spark, odd_docs, no_docs):
    assert contaminated(odd_docs, _items(spark)).count() == 0
    assert decontaminate(odd_docs, _items(spark)).count() == odd_docs.count()
    assert contaminated(no_docs, _items(spark)).count() == 0
    assert contaminated(odd_docs, _items(spark).limit(0)).count() == 0
    assert decontaminate(odd_docs, _items(spark).limit(0)).columns == odd_docs.columns
