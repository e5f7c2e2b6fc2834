import pytest
from pyspark.sql import functions as F

from brindle.operators import index, rewrite, symbols, textsearch
from brindle.operators.lines import to_lines
from brindle.operators.textsearch import Query


def test_names_are_exchanged_at_once(spark):
    df = spark.createDataFrame([(1, "foo bar foobar foo.bar"), (2, "none"), (3, None), (4, "bar")], "id long, content string")
    got = {r.id: r.content for r in rewrite.batch_rename(df, {"foo": "bar", "bar": "foo"}).collect()}
    assert got == {1: "bar foo foobar bar.foo", 2: "none", 3: None, 4: "foo"}
    for name in ("let", "enum", "interface", "from", "as", "type"):
        with pytest.raises(rewrite.RewriteError):
            rewrite.batch_rename(df, {"foo": name})


def test_columns_count_letters_of_the_line(spark):
    df = spark.createDataFrame([("a", "İİİ that THAT\n" + chr(0xE000) + "that")], "path string, content string")
    for q in (Query("that"), Query("that", regex=True)):
        rows = textsearch.search(df, q).select("line", "column", "match").collect()
        assert sorted(map(tuple, rows)) == [(1, 5, "that"), (1, 10, "THAT"), (2, 2, "that")]


def test_exact_is_cut_at_its_limit(spark):
    df = spark.createDataFrame([(k, "x") for k in range(9)], "id long, name string")
    assert [r.id for r in index.exact(df, "x", limit=3).collect()] == [0, 1, 2]


def test_unused_counts_lines(spark):
    text = "const used = 1\nconst alone = 2\nprint(used)\nexport const open = 3\nconst twice = 1, x = twice"
    files = spark.createDataFrame([("a.ts", text, "typescript")], "path string, content string, language string")
    found = symbols.unused(symbols.symbols(files), symbols.identifiers(files))
    assert {(r.name, r.start_line) for r in found.collect()} >= {("alone", 2)} and "used" not in {r.name for r in found.collect()}


def test_edits_are_worked_in_small_portions(spark):
    import pyarrow as pa

    rows = [(str(i), "the a\nthe the " * (i % 7) + "x" * (i * 100)) for i in range(60)] + [("none", None), ("empty", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    edits = rewrite.rename_edits(files, "the", "der")
    assert dict(map(tuple, rewrite.apply_edits(files, edits).collect())) == {p: t and t.replace("the", "der") for p, t in rows}
    assert dict(map(tuple, rewrite.apply_edits(rewrite.apply_edits(files, edits), rewrite.inverted(edits)).collect())) == dict(rows)
    batch = pa.RecordBatch.from_pydict({"content": [t for _, t in rows], "_e": [[{"a": 1}] * 5 if t else None for _, t in rows]})
    cut = list(rewrite.portions(batch, "content", 10_000))
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist() and len(cut) > 10
    assert all(b.num_rows == 1 or b.nbytes < 30_000 for b in cut)


@pytest.mark.parametrize("frequent", [1, 4, 1000])
def test_semantic_scores_do_not_depend_on_what_is_sent_to_all(spark, monkeypatch, frequent):
    import math
    from collections import Counter

    monkeypatch.setattr(textsearch, "FREQUENT_WORDS", frequent)
    # key 3 has two rows, which are one file; key 5 has no words
    rows = [(1, "the license the law"), (2, "a law of the land"), (3, "under license"), (3, "Under the tree"), (4, "rare words only"), (5, None)]
    words = {}
    for k, t in rows:
        words.setdefault(k, Counter()).update((t or "").lower().split())
    idf = {w: math.log((len(rows) + 1) / (sum(w in c for c in words.values()) + 1)) + 1 for c in words.values() for w in c}
    norm = lambda c: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
    asked = Counter({"license": 2, "under": 1, "the": 1})
    want = {k: sum(n * idf[w] ** 2 * asked[w] for w, n in c.items()) / norm(c) / norm(asked) for k, c in words.items() if set(c) & set(asked)}
    got = textsearch.semantic(spark.createDataFrame(rows, "doc_id long, text string"), "license under the License", 99, "text", "doc_id")
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx(want)
