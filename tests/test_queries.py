import pytest

from brindle.plans import queries as q

from . import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert oracle.compare(q.QUERIES[name](spark, sf), con, q.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_clones_advanced_by_brute_force(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog while the other one sleeps".split()
    texts = [" ".join(base[: len(base) - i % 4] + [f"w{i // 8}"] * (i % 5)) for i in range(24)] + [" ".join(f"x{i}_{k}" for k in range(9)) for i in range(6)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def similarity(p, q):
        row = list(range(len(q) + 1))
        for i, a in enumerate(p, 1):
            old, row = row, [i]
            for j, b in enumerate(q, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        u, v, most = set(p), set(q), max(len(p), len(q))
        return 0.5 * (1 - row[-1] / most) + 0.3 * len(u & v) / len(u | v) + 0.2 * min(len(p), len(q)) / most

    first = {}
    for i, text in enumerate(texts):
        first.setdefault(text, i)
    ids = sorted(first.values())
    want = {(a, b): x for a in ids for b in ids if a < b and 0.7 - 1e-12 <= (x := similarity(texts[a].split(), texts[b].split())) < 0.95}
    got = {(r.a, r.b): r.similarity for r in q.QUERIES["clones_advanced"](spark, str(tmp_path)).collect()}
    assert len(want) > 20 and got == pytest.approx(want)


@pytest.mark.parametrize("name, edges", [("graph_components_places", "_places"), ("graph_components_edges", "_edges")])
def test_components_of_whole_graphs_by_union_find(spark, sf, name, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in getattr(q, edges)(spark, sf).collect():
        a, b = sorted((root(r.src), root(r.dst)))
        parent[b] = a
    assert len(parent) > 100
    assert {r.node: r.component for r in q.QUERIES[name](spark, sf).collect()} == {x: root(x) for x in list(parent)}


def test_project_hash_of_documents_by_hand(spark, sf):
    import hashlib
    import zlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        path = f"{r.source}/{r.lang}/{r.doc_id}"
        leaves.setdefault(zlib.crc32(path.encode()) % 256, []).append(f"{path}:{sha(r.text)[:16]}")
    got = q.QUERIES["snapshot_project_hash_documents"](spark, sf).first()
    assert got.buckets == len(leaves) > 1
    assert got.project_hash == sha("|".join(sha("|".join(sorted(leaves[b]))) for b in sorted(leaves)))


@pytest.mark.parametrize("copies", [0, 200])
def test_scores_come_from_the_table(spark, tmp_path, copies):
    # names a and b are on many lines, each own name on one; half of the table are copies of one text, or none is
    texts = [f"a b\nown{i} a\nb" for i in range(400 - copies)] + ["a b\na\nb"] * copies
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = q.QUERIES["score_dimensions_measured"](spark, str(tmp_path)).first()
    own = 400 - copies
    assert row.dead_code == pytest.approx(100 * own / (own + 2)) and row.duplication == pytest.approx(100 * max(0, copies - 1) / 400)
    found = {r.breakdown for r in q.QUERIES["recommendations"](spark, str(tmp_path)).collect()}
    assert ("duplication" in found) == (copies > 0) and "dead_code" in found
