import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import scalar as s
from brindle.operators import clones, graph, index, metrics, rewrite, rules, score, snapshot, symbols, textsearch
from brindle.operators.lines import enclosing, to_lines, with_offsets
from brindle.operators.textsearch import Query
from brindle.plans.analysis import Project
from brindle.plans.workflow import Registry, Step, Workflow, WorkflowError
from brindle.sources import sinks, tree

SERVICE = """import { Store, type Key } from './store';
import * as path from 'path';
export { Key } from './store';
const lazy = () => import('../lib/late');

/* block
   comment with class Hidden {} */
export class UserService extends Base implements Saver, Loader {
  private cache: Map<string, any> = new Map();

  async find(id: string): Promise<User> {
    // const password = 'not a finding';
    const key = id as any;
    try { return this.load(key); } catch (e) {}
    if (id && key && this.cache || !id) { return null; }
    return this.load(key);
  }

  private helper(): void {
    eval('1');
  }
}

const apiKey = "abcdef123";
let _hidden = 1;
export const LIMIT = 42;
function unusedThing() { return 10; }
"""
STORE = "import { UserService } from './service';\nexport interface Store {\n  key: string;\n}\nexport type Key = string;\n"
SWIFT = "import SwiftUI\nstruct Home: View, Identifiable {\n  @State private var count = 0\n  func tap() {\n    let x = try! load()\n    print(x as! String)\n  }\n}\nfinal class Model: Base, ObservableObject {\n}\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("src/service.ts", SERVICE), ("src/store.ts", STORE), ("lib/late.js", "module.exports = require('./deep/index');\n"), ("lib/deep/index.js", "// nothing\n"), ("app/Home.swift", SWIFT)]
    return tree.as_files(spark.createDataFrame(rows, "p string, c string"), "p", "c").cache()


def test_search_modes(spark):
    df = spark.createDataFrame([("a", "Hello hello\nsay HELLO.world hello_x"), ("b", "école cole\nxx"), ("c", None)], "path string, content string")
    hit = lambda q: [(r.path, r.line, r.column, r.match) for r in textsearch.search(df, q).orderBy("path", "line", "column").collect()]
    assert hit(Query("hello")) == [("a", 1, 1, "Hello"), ("a", 1, 7, "hello"), ("a", 2, 5, "HELLO"), ("a", 2, 17, "hello")]
    assert hit(Query("hello", case_sensitive=True)) == [("a", 1, 7, "hello"), ("a", 2, 17, "hello")]
    assert [h[:3] for h in hit(Query("hello", whole_word=True))] == [("a", 1, 1), ("a", 1, 7), ("a", 2, 5)]
    assert hit(Query("cole", whole_word=True)) == [("b", 1, 2, "cole"), ("b", 1, 7, "cole")]
    assert hit(Query("l+o", regex=True)) == [("a", 1, 3, "llo"), ("a", 1, 9, "llo"), ("a", 2, 7, "LLO"), ("a", 2, 19, "llo")]
    assert hit(Query("hwd", fuzzy=True)) == [("a", 2, 5, "HELLO.world")]
    assert hit(Query("O.w")) == [("a", 2, 9, "O.w")] and hit(Query("")) == []
    assert sorted(r.path for r in textsearch.without_match(df, Query("hello")).collect()) == ["b", "c"]


def test_search_score_and_context(spark):
    df = spark.createDataFrame([("a", "one\nx needle\nthree\nNeedle")], "path string, content string")
    rows = textsearch.search(df, Query("needle"), context=1).collect()
    assert [(r.line, r.before, r.after) for r in rows] == [(2, ["one"], ["three"]), (4, ["three"], [])]
    assert rows[0].score == 1.0
    assert rows[1].score == pytest.approx(min(1, 0.8 + 0.2 + 0.2 + (1 - 6 / 200) * 0.1))
    lines = with_offsets(to_lines(df))
    assert [r.offset for r in lines.orderBy("line").collect()] == [0, 4, 13, 19]
    inside = enclosing(to_lines(spark.createDataFrame([("a", "x\nfunction f() {\n y\n}\nconst g = () => {\n z")], "path string, content string")))
    assert [r.function for r in inside.orderBy("line").collect()] == [None, "f", "f", "f", "g", "g"]


def test_suggestions(spark):
    log = spark.createDataFrame([("const x",), ("nothing",)], "query string")
    got = {r.suggestion: r.score for r in textsearch.suggest_all(log, "con", (("connect", 0.9),)).collect()}
    assert got["const"] == 0.8 and got["connect"] == 0.9 and got["const x"] == pytest.approx(3 / 7)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    L = F.lit
    assert one(s.round2(L(0.285))) == 0.28 and one(s.round_half_up(L(2.5))) == 3
    for p, want in (("/a/./b//../c", "/a/c"), ("a/../../b", "../b"), ("..", ".."), ("/..", "/"), ("", "."), ("a/b/..", "a")):
        assert one(s.normalize_path(L(p))) == want
    assert one(s.relative_path(L("/a/b"), L("/a/c/d"))) == "../c/d" and one(s.relative_path(L("/a"), L("/a/b"))) == "b"
    assert one(s.extension(L("a.b/c.d.ts"))) == ".ts" and one(s.extension(L(".env"))) == "" and one(s.stem(L("x/c.d.ts"))) == "c.d"
    assert one(s.change_extension(L("a/b.ts"), "js")) == "a/b.js" and one(s.is_sub_path(L("/a/b/c"), L("/a/b"))) and not one(s.is_sub_path(L("/a/b"), L("/a/b")))
    assert one(s.camel_case(L("hello big-world"))) == "helloBigWorld" and one(s.snake_case(L("helloBig World"))) == "hello_big_world" and one(s.kebab_case(L("aB"))) == "a-b"
    assert one(s.slugify(L(" Hé, 世界 x_y "))) == "hé-世界-x-y" and one(s.truncate(L("abcdef"), 3)) == "abc..." and one(s.strip_indent(L("  a\n    b"))) == "a\n  b"
    assert one(s.fill_template(L("{{a}} {{b}}"), F.create_map(L("a"), L("1")))) == "1 {{b}}"
    assert one(s.similarity(L("kitten"), L("sitting"))) == pytest.approx(4 / 7)
    arr = F.array(*map(L, (1, 2, 2, 3)))
    assert one(s.chunk(arr, 3)) == [[1, 2, 2], [3]] and one(s.difference(arr, F.array(L(1)))) == [2, 2, 3] and one(s.intersection(arr, F.array(L(2)))) == [2, 2]
    assert one(L("src/a/b.ts").rlike(s.glob_regex("src/**/*.ts"))) and one(L("src/b.ts").rlike(s.glob_regex("src/**/*.ts"))) and not one(L("src/a/b.ts").rlike(s.glob_regex("src/*.ts")))
    assert one(s.progress_percent(L(1), L(3))) == 33 and one(s.progress_percent(L(0), L(0))) == 100


def test_tree_and_sinks(spark, tmp_path):
    for p, t in {"a/x.ts": "x", "a/node_modules/y.ts": "y", "b/z.py": "z" * 100, "b/skip.bin": "q"}.items():
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text(t)
    got = {r.path: (r.language, r.size) for r in tree.read_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {"a/x.ts": ("typescript", 1), "b/z.py": ("python", 100)}
    assert [r.path for r in tree.read_tree(spark, str(tmp_path / "t"), max_size=50).collect()] == ["a/x.ts"]
    df = spark.createDataFrame([("a", "b|c")], "src string, dst string")
    assert list(sinks.render(df, "markdown"))[-1] == "| a | b\\|c |" and list(sinks.render(df, "json")) == ['{"src":"a","dst":"b|c"}']
    assert sinks.as_dot(df).first()[0] == '  "a" -> "b|c";'


def test_symbols_and_imports(files):
    got = {(r.path, r.type, r.name): r for r in symbols.symbols(files).collect()}
    cls = got["src/service.ts", "class", "UserService"]
    assert cls.start_line == 8 and cls.superclass == "Base" and cls.implements == ["Saver", "Loader"] and cls.modifiers == ["export"] and cls.scope == []
    helper = got["src/service.ts", "function", "helper"]
    assert helper.modifiers == ["private"] and [x.name for x in helper.scope] == ["UserService"]
    assert ("src/service.ts", "class", "Hidden") not in got and ("src/store.ts", "interface", "Store") in got and ("src/store.ts", "type", "Key") in got
    home = got["app/Home.swift", "struct", "Home"]
    assert home.implements == ["View", "Identifiable"] and home.superclass is None and got["app/Home.swift", "class", "Model"].superclass == "Base"
    assert got["app/Home.swift", "variable", "count"].attributes == ["@State"]
    imps = {(r.path, r.specifier, r.kind) for r in symbols.imports(files).collect()}
    assert imps >= {
        ("src/service.ts", "./store", "import"), ("src/service.ts", "path", "import"), ("src/service.ts", "./store", "export"), ("src/service.ts", "../lib/late", "dynamic_import"),
        ("lib/late.js", "./deep/index", "require"), ("app/Home.swift", "SwiftUI", "import"),
    }
    dead = {r.name for r in symbols.unused(symbols.symbols(files), symbols.identifiers(files)).collect()}
    assert "unusedThing" in dead and "Store" not in dead
    refs = [(r.line, r.kind) for r in symbols.references(files, "password").collect()]
    assert refs == [(12, "comment")]
    assert [r.name for r in index.structural(symbols.symbols(files), path="src/**", kind="class", implements="Saver").collect()] == ["UserService"]


def test_graph_of_files(files):
    edges = graph.edges_of(graph.resolve(symbols.imports(files), files))
    assert {(r.src, r.dst) for r in edges.collect()} == {("src/service.ts", "src/store.ts"), ("src/store.ts", "src/service.ts"), ("src/service.ts", "lib/late.js"), ("lib/late.js", "lib/deep/index.js")}
    found = graph.cycles(edges).collect()
    assert [(r.component, r.length, r.cycle, r.severity) for r in found] == [("src/service.ts", 2, ["src/service.ts", "src/store.ts"], "low")]
    assert {r.node for r in graph.reach(edges, files.where("path = 'src/service.ts'").selectExpr("path as node")).collect()} == {"src/store.ts", "src/service.ts", "lib/late.js", "lib/deep/index.js"}
    kinds = {r.node: r.kind for r in graph.export(edges, files).collect()}
    assert set(kinds.values()) == {"internal"}


def test_graphs_against_definitions(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(22)}
        edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
        nodes = {x for p in pairs for x in p}
        closure = set(pairs)
        while new := {(a, d) for a, b in closure for c, d in pairs if b == c} - closure:
            closure |= new
        start = spark.createDataFrame([(min(nodes),)], "node long")
        assert {r.node for r in graph.reach(edges, start).collect()} == {b for a, b in closure if a == min(nodes)}
        want = {n: min([n] + [m for m in nodes if (n, m) in closure and (m, n) in closure]) for n in nodes}
        assert {r.node: r.component for r in graph.strong_components(edges).collect()} == want
        levels = {r.node: r.level for r in graph.topological_levels(edges).collect()}
        cyclic = {n for n in nodes if (n, n) in closure or any((m, m) in closure and (m, n) in closure for m in nodes)}
        assert {n for n, l in levels.items() if l is None} == cyclic
        assert all(levels[a] < levels[b] for a, b in pairs if levels[a] is not None and levels[b] is not None)
        group = {n: n for n in nodes}
        for _ in nodes:
            for a, b in pairs:
                group[a] = group[b] = min(group[a], group[b])
        assert {r.node: r.component for r in graph.components(edges).collect()} == group


def test_metrics(spark):
    df = spark.createDataFrame([("a", "if (a && b) {\n  x = 12 + 7;\n}\n")], "path string, content string")
    h = metrics.halstead(df).first()
    assert (h.t2, h.h2) == (6, 6) and h.volume == pytest.approx(round((h.t1 + h.t2) * math.log2(h.h1 + h.h2), 2), abs=0.01)
    assert [r[0] for r in spark.createDataFrame([(85.0,), (84.9,), (70.0,), (50.0,), (25.0,), (24.9,)], "v double").select(metrics.grade(F.col("v"))).collect()] == list("ABBCDF")
    assert df.select(metrics.cyclomatic_words(F.col("content"))).first()[0] == 3
    assert [r.value for r in metrics.magic_numbers(to_lines(df)).collect()] == ["12"]
    deep = {r.line: r.depth for r in metrics.nesting(to_lines(df)).collect()}
    assert deep == {1: 0, 2: 1, 3: 1, 4: 0}
    many = spark.createDataFrame([("a", "same long line\n" * 4)], "path string, content string")
    assert [r.line for r in metrics.repeated_lines(to_lines(many)).orderBy("line").collect()] == [1, 2]


def test_rules(files):
    got = {(r.path, r.line, r.type) for r in rules.issues(files).collect()}
    assert got == {
        ("src/service.ts", 13, "as-any"), ("src/service.ts", 14, "empty-catch"), ("src/service.ts", 20, "eval"),
        ("src/service.ts", 24, "hardcoded-secret"), ("src/service.ts", 12, "hardcoded-secret"), ("src/service.ts", 25, "underscore"), ("app/Home.swift", 5, "force-try"), ("app/Home.swift", 6, "force-cast"),
    }
    row = rules.deductions(rules.issues(files)).first()
    assert (row.type_safety, row.error_handling, row.naming) == (100 - 20, 100 - 20, 97)
    assert {r.pattern for r in rules.patterns(files).collect()} >= {"try-catch", "async", "state-wrapper"}


def test_clones(spark):
    a, b, c = "const total = price * 2;\nreturn total;", "const sum = cost * 7;\nreturn sum;", "while (true) { stop(); }"
    df = spark.createDataFrame([("f1", a), ("f2", a), ("f3", b), ("f4", c)], "path string, code string")
    assert [(r.members, r.first) for r in clones.exact(df).collect()] == [(2, "f1")]
    assert [(r.files, r.variants) for r in clones.normalised(df).collect()] == [(3, 2)]
    near = spark.createDataFrame([("x", " ".join(f"t{i}" for i in range(20))), ("y", " ".join(f"t{i}" for i in range(19)) + " other"), ("z", "t1 t2")], "path string, code string")
    assert [(r.a, r.b) for r in clones.similar_pairs(clones.token_sets(near), 0.8).collect()] == [("x", "y")]
    rows = clones.approximate(near).collect()
    assert [(r.a, r.b) for r in rows] == [("x", "y")] and rows[0].similarity == pytest.approx(0.5 * 0.95 + 0.3 * 19 / 21 + 0.2)


def test_fragments_and_blocks(files, spark):
    got = {(r.kind, r.start_line) for r in clones.fragments(files.where("path = 'src/service.ts'")).collect()}
    assert ("method", 11) in got and ("method", 19) in got
    blocks = clones.blocks(spark.createDataFrame([("a", "\n".join(map(str, range(25))))], "path string, content string")).orderBy("start_line").collect()
    assert [(b.start_line, b.end_line) for b in blocks] == [(1, 10), (11, 20), (21, 25)]


def test_scores(spark, files):
    one = lambda v: spark.range(1).select(score.grade(F.lit(v))).first()[0]
    assert [one(v) for v in (0.0, 29.5, 30.0, 50.0, 70.0, 85.0, 110.0)] == list("AABCDFF")
    dims = Project(files).score()
    rows = {r.dimension: r for r in dims.collect()}
    assert set(rows) == set(score.WEIGHTS) and all(r.score >= 0 for r in rows.values())
    total = score.total(dims)
    assert total.first().total == pytest.approx(sum(r.score * r.weight for r in rows.values()), abs=0.01)
    with pytest.raises(score.GateError):
        score.gate(total, -1)
    recs = score.recommendations(spark.createDataFrame([("dead_code", 60.0), ("large_files", 31.0), ("pattern", 20.0)], "breakdown string, value double"))
    assert {r.breakdown: (r.priority, r.impact) for r in recs.collect()} == {"dead_code": (1, 5), "large_files": (2, 3)}


def test_snapshots(spark, files):
    h = snapshot.file_hashes(files)
    assert snapshot.diff(h, h).count() == 0
    other = h.where("path <> 'lib/late.js'").withColumn("hash", F.when(F.col("path") == "src/store.ts", "changed").otherwise(F.col("hash")))
    d = snapshot.diff(h, other)
    assert {(r.path, r.change) for r in d.collect()} == {("lib/late.js", "deleted"), ("src/store.ts", "modified")}
    assert sorted(map(tuple, snapshot.apply_diff(h, other, d).collect())) == sorted(map(tuple, other.collect()))
    assert snapshot.project_hash(h).first().project_hash == snapshot.project_hash(h.repartition(3)).first().project_hash != snapshot.project_hash(other).first().project_hash
    medium = files.where("path = 'src/service.ts'").select(snapshot.compress_medium(F.col("content"))).first()[0]
    assert "password" not in medium and "Hidden" not in medium and "\n\n" not in medium
    minimal = snapshot.compress_minimal(files).where("path = 'src/store.ts'").first().compressed
    assert minimal == "import { UserService } from './service';\nexport interface Store\nexport type Key = string;"
    assert snapshot.rename_locals("const total = a; let other = total + b.total;") == "const c = a; let d = c + b.total;"
    names = snapshot.short_names()
    assert [next(names) for _ in range(28)][-3:] == ["z", "aa", "ab"]


def test_rename_and_edits(spark):
    df = spark.createDataFrame([("a", "foo(foo_x, foo);\n// foo\nbar.foo"), ("b", "nothing")], "path string, content string")
    edits = rewrite.rename_edits(df, "foo", "longer")
    assert edits.count() == 4 and rewrite.preview(edits).first().files == 1
    by_edits = {r.path: r.content for r in rewrite.apply_edits(df, edits).collect()}
    assert by_edits == {r.path: r.content for r in rewrite.rename(df, "foo", "longer").collect()} and by_edits["a"].startswith("longer(foo_x, longer)")
    back = rewrite.apply_edits(rewrite.apply_edits(df, edits), rewrite.inverted(edits))
    assert {r.path: r.content for r in back.collect()} == {r.path: r.content for r in df.collect()}
    for bad in ("class", "1x", "a-b", ""):
        with pytest.raises(rewrite.RewriteError):
            rewrite.rename(df, "foo", bad)
    twice = edits.unionByName(edits.withColumn("new_text", F.lit("zz")))
    with pytest.raises(Exception, match="overlap"):
        rewrite.apply_edits(df, twice).collect()


def test_moves(spark, files):
    moves = spark.createDataFrame([("src/store.ts", "src/data/store.ts")], "src string, dst string")
    imps = symbols.imports(files)
    got = {(r.path, r.old, r.new) for r in rewrite.move_updates(imps, files, moves).collect()}
    assert got == {("src/service.ts", "./store", "./data/store"), ("src/data/store.ts", "./service", "../service")}
    after = {r.path: r.content for r in rewrite.apply_moves(files, imps, moves).collect()}
    assert "src/store.ts" not in after and "from './data/store'" in after["src/service.ts"] and "from '../service'" in after["src/data/store.ts"]


def test_function_refactorings():
    text = "function f(a, b) {\n  const c = a + 1;\n  const d = c * b;\n  return d;\n}"
    out = rewrite.extract_function(text, 2, 3, "compute")
    assert "const d = compute(a, b);" in out and "function compute(a, b) {\n  const c = a + 1;\n  const d = c * b;\n  return d;\n}" in out
    with pytest.raises(rewrite.RewriteError):
        rewrite.extract_function(text, 1, 2, "x")
    assert rewrite.inline_function("function add(x, y) { return x + y; }\nconst z = add(1, g(2));", "add") == "const z = (1 + (g(2)));"
    with pytest.raises(rewrite.RewriteError):
        rewrite.inline_function("function f(x) { return f(x - 1); }", "f")
    assert "static getInstance(): A" in rewrite.apply_singleton("class A {\n}", "A")


def test_workflows():
    log = []
    ok = Workflow("w", [Step("a", lambda r: 1, next="c"), Step("b", lambda r: log.append("b")), Step("c", lambda r: r["a"] + 1)])
    assert ok.run() == {"a": 1, "c": 2} and not log
    tries = []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "up"

    assert Workflow("w", [Step("a", flaky, retries=2)], base_seconds=0).run() == {"a": "up"}
    bad = Workflow("w", [Step("a", lambda r: 1, rollback=lambda r: log.append("undo a")), Step("b", lambda r: 1 / 0)], base_seconds=0)
    with pytest.raises(WorkflowError):
        bad.run()
    assert log == ["undo a"]
    registry = Registry()
    registry.register("w", "general", lambda: ok)
    assert registry.names("general") == ["w"] and registry.make("w") is ok and registry.unregister("w") and not registry.exists("w")
