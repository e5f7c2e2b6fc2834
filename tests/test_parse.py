from pyspark.sql import functions as F

from brindle.operators import parse, symbols as by_lines

TS = '''import {
  A,
  type B as C,
} from "./a";
import d, { e } from '../d';
export * from './all'; // import x from 'comment'
const lazy = import('./lazy'), old = require("old");

/** class Ghost {} */
@Injectable({ providedIn: 'root' })
export abstract class Outer<T extends Base>
  extends Parent<T>
  implements First,
    Second<string> {
  private readonly size: number = 3;
  items?: string[];
  constructor(private http: Client) { super(); }
  async load(
    id: string,
    options: { deep: boolean },
  ): Promise<{ a: number }> {
    const local = (x) => x + 1;
    function helper() { return "} class Fake {"; }
    return helper();
  }
  get value(): number { return this.size }
}
namespace Deep {
  export namespace Deeper {
    export class Inner { run(): void { } }
  }
}
export interface Shape { area(): number; name: string }
export type Id = string | number;
export const enum Kind { A, B }
let counter = 0
'''

COMPLEX = '''
function simpleFunction(a) { return a }
function multipleBranches(x) {
  if (x === 1) { return 'a' } else if (x === 2) { return 'b' } else if (x === 3) { return 'c' } else if (x === 4) { return 'd' }
  return 'e'
}
function nestedComplexity(a, b, c) {
  if (a) {
    for (const x of b) {
      while (c) {
        if (x && c) { c = x ? 1 : 0 }
      }
    }
  }
}
const arrow = (a, b) => a && b
'''


def table(spark, text, language="typescript"):
    return spark.createDataFrame([("f", text, language), ("none", None, language), ("empty", "", language)], "path string, content string, language string")


def test_symbols_with_ends_and_scopes(spark):
    rows = {(r.name, r.type): r for r in parse.symbols(table(spark, TS)).collect()}
    outer = rows["Outer", "class"]
    lines = TS.split("\n")
    first = next(i for i, t in enumerate(lines, 1) if "class Outer" in t)
    last = next(i for i, t in enumerate(lines, 1) if i > first and t == "}")
    assert (outer.start_line, outer.end_line, outer.superclass, outer.implements) == (first, last, "Parent", ["First", "Second"])
    assert outer.modifiers == ["export", "abstract"] and outer.attributes == ["@Injectable"]
    scope = lambda k: [(s.type, s.name) for s in rows[k].scope]
    assert scope(("load", "function")) == [("class", "Outer")] and rows["load", "function"].end_line - rows["load", "function"].start_line == 7
    assert rows["size", "property"].modifiers == ["private", "readonly"] and ("items", "property") in rows and ("value", "function") in rows
    assert scope(("run", "function")) == [("namespace", "Deep"), ("namespace", "Deeper"), ("class", "Inner")]
    assert not {"Ghost", "Fake", "local", "helper"} & {n for n, _ in rows}
    assert {("Shape", "interface"), ("area", "function"), ("name", "property"), ("Id", "type"), ("Kind", "enum"), ("counter", "variable"), ("lazy", "constant")} <= set(rows)
    inside = {r.name for r in parse.symbols(table(spark, TS), locals_=True).collect()}
    assert {"local", "helper"} <= inside
    at = by_lines.innermost(parse.symbols(table(spark, TS), locals_=True), rows["load", "function"].start_line + 5, 30).first()
    assert at.name == "helper"


def test_imports_over_lines(spark):
    rows = [(r.line, r.specifier, r.kind, r.is_relative, r.imported) for r in parse.imports(table(spark, TS)).collect()]
    assert rows == [
        (1, "./a", "import", True, ["A", "B"]), (5, "../d", "import", True, ["e"]), (6, "./all", "export", True, []),
        (7, "./lazy", "dynamic_import", True, []), (7, "old", "require", False, []),
    ]


def test_complexity_of_functions(spark):
    rows = {r.name: r for r in parse.functions(table(spark, COMPLEX)).collect()}
    assert (rows["simpleFunction"].cyclomatic, rows["simpleFunction"].cognitive) == (1, 0)
    assert rows["multipleBranches"].cyclomatic == 5
    nested = rows["nestedComplexity"]
    assert nested.cyclomatic == 7 and nested.cognitive > nested.cyclomatic and nested.nesting == 4 and nested.params == 3
    assert rows["arrow"].cyclomatic == 2 and rows["arrow"].params == 2


def test_swift(spark):
    text = '''@testable import Core
import struct Foundation.URL
public final class Model: Base, Codable {
    @Published private(set) var items: [String] = []
    let id = 1
    init(id: Int) { }
    func load<T>(from url: URL, deep: Bool = false) async throws -> [T] where T: Codable {
        guard deep else { return [] }
        for x in items where x.isEmpty { if deep && x == "" { print("}") } }
        return []
    }
    enum Kind: String, CaseIterable { case a, b }
}
extension Model: Equatable { }
'''
    rows = {(r.name, r.type): r for r in parse.symbols(table(spark, text, "swift")).collect()}
    model = rows["Model", "class"]
    assert (model.superclass, model.implements, model.start_line, model.end_line) == ("Base", ["Codable"], 3, 13)
    assert rows["Kind", "enum"].superclass is None and rows["Kind", "enum"].implements == ["String", "CaseIterable"]
    assert rows["items", "variable"].attributes == ["@Published"] and ("init", "function") in rows
    assert [(s.type, s.name) for s in rows["load", "function"].scope] == [("class", "Model")]
    got = {r.name: r for r in parse.functions(table(spark, text, "swift")).collect()}["load"]
    assert (got.cyclomatic, got.params, got.start_line, got.end_line) == (5, 2, 7, 11)
    assert [r.specifier for r in parse.imports(table(spark, text, "swift")).collect()] == ["Core", "Foundation.URL"]


def test_odd_texts(spark):
    for text in ("}}}", "{{{", "class", "class A", "function (", "const = {", "/* open", "'", "a\\", "class A { m( { ", "import { from 'x'", "type T = ", "x => {"):
        for language in ("typescript", "swift"):
            for f in (parse.symbols, parse.functions, parse.imports):
                f(table(spark, text, language)).collect()


def test_small_files_of_one_split_are_dealt_out(spark):
    rows = [(f"/f{i}.ts", "typescript", f"const a{i} = 1\nexport const b = a{i % 5}") for i in range(200)]
    files = spark.createDataFrame(rows, "path string, language string, content string").coalesce(1)
    tasks = parse.symbols(files).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in tasks) == 400
    from brindle.plans.analysis import Project

    got = {r.type: (r.n, r.dead) for r in Project(files).dead_by_type().collect()}
    assert got == {"constant": (400, 195), "total": (400, 195)}
