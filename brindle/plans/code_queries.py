"""Queries over source code that is written from the tables, and over operators that other queries do not reach.

Every supplier is a TypeScript file in its nation's folder, every nation an index
file there, so what operators read from the code can be told from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import clones, graph, index, metrics, parse, rewrite, rules, score, snapshot, symbols, textsearch
from ..sources import tree
from ..streaming import changes
from .analysis import Project
from .queries import _SQL_PLACES, _events, _places, _symbols, _t, query

_PATH = "'/src/n' || s_nationkey || '/s' || s_suppkey || '.ts'"


def _code(spark, sf_dir) -> DataFrame:
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    lit = F.lit
    text = F.concat_ws(
        "\n", lit("import { Base, Other as O } from '../base'"), lit("import type { Index } from './index'"),
        F.concat(lit("export class Supplier"), k, lit(" extends Base implements Index {")), lit("  private balance: number;"), lit("  total(x) {"),
        lit("    if (x > 10 && x < 100) {"), lit("      return x"), lit("    }"), F.concat(lit("    return "), k), lit("  }"), lit("}"),
        F.concat(lit("// Supplier"), k, lit(" in a comment")), F.concat(lit("const helper"), k, lit(" = 1")),
        F.concat(lit("export const shared = "), F.when(F.col("s_suppkey") % 5 == 0, F.concat(lit("helper"), k)).otherwise("0")), lit("const fs = require('fs')"),
    )
    supplier = _t(spark, sf_dir, "supplier").select(F.concat(lit("/src/n"), n, lit("/s"), k, lit(".ts")).alias("path"), text.alias("content"))
    m, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    nation = _t(spark, sf_dir, "nation").select(
        F.concat(lit("/src/n"), m, lit("/index.ts")).alias("path"),
        F.concat(lit("import { r } from '../../regions/r"), r, lit("'\nexport interface Index {\n}")).alias("content"),
    )
    return tree.as_files(supplier.unionByName(nation), "path", "content")


# --- sources

_DOC_PATH = "source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.test.ts' WHEN doc_id % 3 = 1 THEN '.ts' ELSE '.md' END"


def _paths(spark, sf_dir) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, ".test.ts").when(F.col("doc_id") % 3 == 1, ".ts").otherwise(".md")
    return _t(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), "text")


@query(f"""
WITH p AS (SELECT {_DOC_PATH} AS path FROM documents)
SELECT path FROM p WHERE regexp_matches(path, '[.]ts$') AND regexp_matches(path, '/(en|fr)/[^/]*$') AND NOT regexp_matches(path, '^src1[^/]*/')""")
def paths_included(spark, sf_dir):
    return _paths(spark, sf_dir).where(tree.included(F.col("path"), (".TS",), ("**/en/*", "**/fr/*"), ("src1*/**",))).select("path")


@query(f"WITH p AS (SELECT {_DOC_PATH} AS path FROM documents) SELECT path, contains(path, 'src1') OR contains(path, '/de/') AS found FROM p")
def paths_with_component(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", tree.contains_component(F.col("path"), ("src1", "/de/")).alias("found"))


@query(f"""
WITH p AS (SELECT {_DOC_PATH} AS path, text FROM documents)
SELECT path, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN path LIKE '%.ts' THEN '.ts' ELSE '.md' END AS extension, CASE WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'unknown' END AS language, sha256(text) AS sha256 FROM p""")
def files_of_documents(spark, sf_dir):
    return tree.as_files(_paths(spark, sf_dir), "path", "text").select("path", "size", "extension", "language", "sha256")


@query(f"WITH p AS (SELECT {_DOC_PATH} AS path FROM documents) SELECT path, path LIKE '%.test.ts' AS is_test FROM p")
def test_files(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", symbols.is_test_file(F.col("path")).alias("is_test"))


# --- symbols and imports

_SQL_DECLARED = f"""d AS (
  SELECT {_PATH} AS path, 'Supplier' || s_suppkey AS name, 'class' AS type, 3 AS line, 14 AS col, '' AS scope, 'export' AS modifiers FROM supplier
  UNION ALL SELECT {_PATH}, 'balance', 'property', 4, 11, 'class:Supplier' || s_suppkey, 'private' FROM supplier
  UNION ALL SELECT {_PATH}, 'total', 'function', 5, 3, 'class:Supplier' || s_suppkey, '' FROM supplier
  UNION ALL SELECT {_PATH}, 'helper' || s_suppkey, 'constant', 13, 7, '', '' FROM supplier
  UNION ALL SELECT {_PATH}, 'shared', 'constant', 14, 14, '', 'export' FROM supplier
  UNION ALL SELECT {_PATH}, 'fs', 'constant', 15, 7, '', '' FROM supplier
  UNION ALL SELECT '/src/n' || n_nationkey || '/index.ts', 'Index', 'interface', 2, 18, '', 'export' FROM nation)"""


@query(f"WITH {_SQL_DECLARED} SELECT path, name, type, line AS start_line, col AS start_col, scope, modifiers FROM d")
def code_symbols(spark, sf_dir):
    found = symbols.symbols(_code(spark, sf_dir))
    return found.select("path", "name", "type", "start_line", "start_col", s.scope_key(F.col("scope")).alias("scope"), F.array_join("modifiers", " ").alias("modifiers"))


@query(f"SELECT {_PATH} AS path, 'Supplier' || s_suppkey AS name, 'Base' AS superclass, 'Index' AS implements FROM supplier")
def code_heritage(spark, sf_dir):
    found = index.of_type(symbols.symbols(_code(spark, sf_dir)), "class")
    return found.select("path", "name", "superclass", F.array_join("implements", ",").alias("implements"))


@query("SELECT name FROM (VALUES ('balance'), ('total')) v(name), supplier WHERE s_suppkey = 7")
def code_in_scope(spark, sf_dir):
    return index.in_scope(symbols.symbols(_code(spark, sf_dir)), "class:Supplier7").select("name")


_SQL_ENDS = "CASE type WHEN 'class' THEN 11 WHEN 'function' THEN 10 WHEN 'interface' THEN 3 ELSE line END"


@query(f"WITH {_SQL_DECLARED} SELECT path, name, type, line AS start_line, col AS start_col, CAST({_SQL_ENDS} AS INTEGER) AS end_line, scope, modifiers FROM d")
def code_parsed_symbols(spark, sf_dir):
    found = parse.symbols(_code(spark, sf_dir))
    return found.select("path", "name", "type", "start_line", "start_col", "end_line", s.scope_key(F.col("scope")).alias("scope"), F.array_join("modifiers", " ").alias("modifiers"))


@query(f"SELECT {_PATH} AS path, 'total' AS name, 5 AS start_line, 10 AS end_line, 1 AS params, 3 AS cyclomatic, 2 AS cognitive, 1 AS nesting FROM supplier")
def code_functions(spark, sf_dir):
    return parse.functions(_code(spark, sf_dir))


@query(f"SELECT {_PATH} AS path, 'total' AS name FROM supplier")
def code_innermost(spark, sf_dir):
    """What holds line 7, column 9 of each file."""
    return symbols.innermost(parse.symbols(_code(spark, sf_dir)), 7, 9).select("path", "name")


@query(f"""
WITH {_SQL_DECLARED}, n AS (SELECT type, count(*) AS n, 0 AS dead FROM d GROUP BY type), u AS (SELECT count(*) AS k FROM supplier WHERE s_suppkey % 5 <> 0),
x AS (SELECT type, n, CASE WHEN type = 'constant' THEN k ELSE 0 END AS dead FROM n, u), t AS (SELECT type, n, dead FROM x UNION ALL SELECT 'total', sum(n), sum(dead) FROM x)
SELECT type, CAST(n AS BIGINT) AS n, CAST(dead AS BIGINT) AS dead, floor(dead / n * 100 * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS percent FROM t""")
def code_dead_by_type(spark, sf_dir):
    return Project(_code(spark, sf_dir)).dead_by_type()


@query(f"WITH {_SQL_DECLARED} SELECT path, name FROM d WHERE type IN ('class', 'function', 'interface')")
def code_abstract(spark, sf_dir):
    return parse.symbols(_code(spark, sf_dir)).where(symbols.is_abstract_declaration(F.col("type"))).select("path", "name")


_SQL_IMPORTS = f"""i AS (
  SELECT {_PATH} AS path, 1 AS line, '../base' AS specifier, 'import' AS kind, true AS is_relative, 'Base,Other' AS imported FROM supplier
  UNION ALL SELECT {_PATH}, 2, './index', 'import', true, 'Index' FROM supplier
  UNION ALL SELECT {_PATH}, 15, 'fs', 'require', false, '' FROM supplier
  UNION ALL SELECT '/src/n' || n_nationkey || '/index.ts', 1, '../../regions/r' || n_regionkey, 'import', true, 'r' FROM nation)"""


@query(f"WITH {_SQL_IMPORTS} SELECT * FROM i")
def code_imports(spark, sf_dir):
    return symbols.imports(_code(spark, sf_dir)).withColumn("imported", F.array_join("imported", ","))


@query(f"""
SELECT {_PATH} AS path, 'Base' AS name, 1 AS line, 10 AS col, 'usage' AS kind FROM supplier
UNION ALL SELECT {_PATH}, 'Base', 3, CAST(31 + len(s_suppkey::VARCHAR) AS INTEGER), 'usage' FROM supplier
UNION ALL SELECT {_PATH}, 'Supplier7', 3, 14, 'definition' FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT {_PATH}, 'Supplier7', 12, 4, 'comment' FROM supplier WHERE s_suppkey = 7""")
def code_references(spark, sf_dir):
    code = _code(spark, sf_dir)
    return symbols.references(code, "Base").unionByName(symbols.references(code, "Supplier7"))


@query(f"SELECT {_PATH} AS path, 'helper' || s_suppkey AS name, 13 AS start_line, 0.95::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 5 <> 0")
def code_unused(spark, sf_dir):
    code = _code(spark, sf_dir)
    return symbols.unused(symbols.symbols(code), symbols.identifiers(code)).select("path", "name", "start_line", "confidence")


@query("SELECT name FROM (VALUES ('balance'), ('total')) v(name), supplier WHERE s_suppkey = 3 UNION ALL SELECT 'helper3' FROM supplier WHERE s_suppkey = 3")
def code_structural(spark, sf_dir):
    found = symbols.symbols(_code(spark, sf_dir))
    inner = index.structural(index.in_scope(found, "class:Supplier3"), path="/src/**")
    return inner.select("name").unionByName(index.exact(found, "helper3").select("name"))


@query(f"WITH {_SQL_IMPORTS} SELECT * FROM i")
def code_parsed_imports(spark, sf_dir):
    return parse.imports(_code(spark, sf_dir)).withColumn("imported", F.array_join("imported", ","))


# --- graph

_SQL_RESOLVED = f"""r AS (
  SELECT {_PATH} AS src, './index' AS specifier, '/src/n' || s_nationkey || '/index.ts' AS dst, true AS found FROM supplier
  UNION ALL SELECT {_PATH}, '../base', '/src/base', false FROM supplier
  UNION ALL SELECT '/src/n' || n_nationkey || '/index.ts', '../../regions/r' || n_regionkey, '/regions/r' || n_regionkey, false FROM nation)"""


def _resolved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    code = _code(spark, sf_dir)
    return code, graph.resolve(symbols.imports(code), code)


@query(f"WITH {_SQL_RESOLVED} SELECT * FROM r")
def code_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)[1]


@query(f"""
WITH {_SQL_RESOLVED}, f AS (SELECT {_PATH} AS path FROM supplier UNION ALL SELECT '/src/n' || n_nationkey || '/index.ts' FROM nation), n AS (SELECT path AS node FROM f UNION SELECT dst FROM r)
SELECT node, (SELECT count(*) FROM r WHERE r.dst = n.node) AS in_degree, (SELECT count(*) FROM r WHERE r.src = n.node) AS out_degree,
  CASE WHEN node IN (SELECT path FROM f) THEN 'internal' ELSE 'external' END AS kind FROM n""")
def code_export(spark, sf_dir):
    code, resolved = _resolved(spark, sf_dir)
    return graph.export(graph.edges_of(resolved), code)


@query(f"SELECT {_PATH} AS path, 2::BIGINT AS specifiers FROM supplier")
def code_high_coupling(spark, sf_dir):
    return graph.high_coupling(symbols.imports(_code(spark, sf_dir)), 1)


@query(f"WITH {_SQL_RESOLVED} SELECT src AS node FROM r WHERE found")
def code_without_importers(spark, sf_dir):
    """Files that no file imports."""
    code, resolved = _resolved(spark, sf_dir)
    edges = graph.edges_of(resolved)
    roots = graph.orphans(edges, graph.nodes(edges, code), "root")
    return roots.join(code.select(F.col("path").alias("node")), "node", "left_semi").where(~F.col("node").endswith("index.ts") | F.lit(False))


@query("""
WITH e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey % 7 = 0)
SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT dst FROM e) AND c_custkey NOT IN (SELECT src FROM e)""")
def orphans_with_few_orders(spark, sf_dir):
    edges = _t(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return graph.orphans(edges, customers, "isolated").join(customers, "node", "left_semi")


@query(f"""
WITH {_SQL_PLACES}, a AS (SELECT dst AS origin, count(*) AS direct FROM e GROUP BY dst), two AS (SELECT b.dst AS origin, count(DISTINCT x.src) AS n FROM e b JOIN e x ON x.dst = b.src GROUP BY b.dst),
t AS (SELECT 'r' || r_regionkey AS origin FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation),
s AS (SELECT b.dst AS origin, x.src AS node FROM e b JOIN e x ON x.dst = b.src UNION SELECT dst, src FROM e),
n AS (SELECT origin, count(*) FILTER (node LIKE 's%') AS tests FROM s GROUP BY origin)
SELECT t.origin, coalesce(a.direct, 0) AS direct, coalesce(a.direct, 0) + coalesce(two.n, 0) AS transitive, coalesce(n.tests, 0) AS tests,
  coalesce(a.direct, 0) * 3 + coalesce(a.direct, 0) + coalesce(two.n, 0) + coalesce(n.tests, 0) * 0.5::DOUBLE AS impact_score
FROM t LEFT JOIN a ON a.origin = t.origin LEFT JOIN two ON two.origin = t.origin LEFT JOIN n ON n.origin = t.origin""")
def places_impact(spark, sf_dir):
    """Who depends on a region or nation; suppliers stand for tests."""
    targets = _t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node")).unionByName(
        _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    )
    return graph.impact(_places(spark, sf_dir), targets, lambda n: n.startswith("s"))


@query("""
WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT count(*) AS total FROM customer)
SELECT nation, CASE WHEN n > 10 THEN 'high' WHEN n > 3 THEN 'medium' ELSE 'low' END AS level, least(100.0::DOUBLE, floor(n / total * 200 + 0.5)) AS score FROM c, t""")
def places_impact_level(spark, sf_dir):
    customer = _t(spark, sf_dir, "customer")
    counts = customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(customer.agg(F.count("*").alias("total"))))
    level, share = graph.impact_level(F.col("n"), F.col("total"))
    return counts.select("nation", level.alias("level"), share.cast("double").alias("score"))


@query(f"WITH {_SQL_PLACES} SELECT DISTINCT src, dst FROM e WHERE src <> 'n3' AND dst <> 'n3' AND src <> 'c1' UNION ALL SELECT 'c1', 'n999'")
def places_changed(spark, sf_dir):
    """A nation is removed, and a customer's file analysed again."""
    edges = graph.remove_node(_places(spark, sf_dir).distinct(), "n3")
    changed = spark.createDataFrame([("c1", "n999")], "src string, dst string")
    return graph.replace_out_edges(edges, changed, spark.createDataFrame([("c1",)], "path string"))


# --- index

@query("SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS name, 1.0::DOUBLE AS score FROM part WHERE split_part(p_name, ' ', 2) = 'ring' ORDER BY id LIMIT 100")
def symbol_exact_operator(spark, sf_dir):
    named = _symbols(spark, sf_dir).drop("name").join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.split("p_name", " "), 2).alias("name")), "id")
    return index.exact(named.select("id", "name"), "ring", order=("id",))


@query("""
SELECT p_partkey AS id, p_name AS name, 3 / greatest(len(p_name), 3) AS score FROM part WHERE regexp_matches(p_name, '(?i)r.*i.*g') ORDER BY score DESC, name, id LIMIT 100""")
def symbol_fuzzy_hits(spark, sf_dir):
    return index.fuzzy(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "rig", tie=("id",))


@query("""
SELECT p_partkey AS id, CASE WHEN lower(p_name) = 'hot ring' THEN 1.0 WHEN starts_with(lower(p_name), 'hot ring') THEN 0.8 WHEN contains(lower(p_name), 'hot ring') THEN 0.6 END::DOUBLE AS whole,
  CASE WHEN lower(p_name) = 'hot' THEN 1.0 WHEN starts_with(lower(p_name), 'hot') THEN 0.8 WHEN contains(lower(p_name), 'hot') THEN 0.6 END::DOUBLE AS part FROM part WHERE contains(lower(p_name), 'hot')""")
def symbol_score_hits(spark, sf_dir):
    n = F.col("p_name")
    scored = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), index.substring_score(n, "Hot Ring").alias("whole"), index.substring_score(n, "hot").alias("part"))
    return scored.where("part is not null")


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'ECONOMY'")
def symbols_of_type(spark, sf_dir):
    return index.of_type(_symbols(spark, sf_dir), "ECONOMY").select("id")


@query("SELECT o_custkey AS path, max(o_orderdate) AS mtime FROM orders GROUP BY o_custkey HAVING max(o_orderdate) > TIMESTAMP '1998-01-01'")
def outdated_entries(spark, sf_dir):
    listed = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max("o_orderdate").alias("mtime"))
    entries = listed.select("path", F.least("mtime", F.lit("1998-01-01").cast("timestamp_ntz").cast(listed.schema["mtime"].dataType)).alias("mtime"))
    return index.outdated(entries, listed)


@query("SELECT user_id, CAST(CASE WHEN count(*) = 0 THEN 100 ELSE floor(count(*) FILTER (event_type = 'click') / count(*) * 100 + 0.5) END AS INTEGER) AS percent FROM events GROUP BY user_id")
def progress_by_user(spark, sf_dir):
    n = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count("*").alias("b"))
    return n.select("user_id", s.progress_percent(F.col("a"), F.col("b")).alias("percent"))


# --- metrics and rules

_SQL_METRICS = r"""l AS (SELECT doc_id, text, regexp_extract_all(text, '\(([^)\n]*)\)', 1) AS p FROM documents),
m AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\bfunction\b')) + len(regexp_extract_all(text, '=>')) AS INTEGER) AS methods,
  CAST(len(regexp_extract_all(text, '(?m)^\s*(?:public|private|protected|readonly|static|let|const|var)\s+\w+\s*[:=;]')) AS INTEGER) AS fields,
  CAST(CASE WHEN len(p) = 0 THEN 0 ELSE floor(list_sum(list_transform(p, lambda x: CASE WHEN trim(x, ' ') = '' THEN 0 ELSE len(string_split(x, ',')) END)) / len(p) + 0.5) END AS INTEGER) AS params,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS INTEGER) AS loc FROM l)"""


@query(f"WITH {_SQL_METRICS} SELECT * FROM m")
def code_metrics_parts(spark, sf_dir):
    got = metrics.code_metrics(_t(spark, sf_dir, "documents"), "text")
    return got.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("methods", "fields", "params", "loc")])


@query(f"""
WITH {_SQL_METRICS} SELECT doc_id, 'long-method' AS smell, CASE WHEN loc > 100 THEN 'high' ELSE 'medium' END AS severity FROM m WHERE loc > 50
UNION ALL SELECT doc_id, 'large-class', 'high' FROM m WHERE methods > 20 OR fields > 15 UNION ALL SELECT doc_id, 'long-parameter-list', CASE WHEN params > 8 THEN 'high' ELSE 'medium' END FROM m WHERE params > 5""")
def size_smells(spark, sf_dir):
    return metrics.size_smells(metrics.code_metrics(_t(spark, sf_dir, "documents"), "text"), "doc_id")


@query("""
SELECT o_orderkey, CASE WHEN v <= 5 THEN 'simple' WHEN v <= 10 THEN 'moderate' WHEN v <= 20 THEN 'complex' ELSE 'very-complex' END AS evaluation FROM (SELECT o_orderkey, o_orderkey % 30 AS v FROM orders)""")
def complexity_evaluation(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", metrics.evaluation(F.col("o_orderkey") % 30).alias("evaluation"))


@query("""
WITH f AS (SELECT l_orderkey AS path, 'f' || l_linenumber || '_' || l_partkey AS name, CAST(l_quantity AS BIGINT) AS cyclomatic, CAST(floor(l_quantity * 1.2) AS BIGINT) AS cognitive FROM lineitem)
SELECT path, CAST(sum(cyclomatic) AS BIGINT) AS cyclomatic, CAST(sum(cognitive) AS BIGINT) AS cognitive, count(*) AS functions, floor(avg(cyclomatic) * 1e6 + 0.5) AS average, max(cyclomatic) AS most, max_by(name, (cyclomatic, name)) AS most_complex,
  CASE WHEN max(cyclomatic) <= 5 THEN 'simple' WHEN max(cyclomatic) <= 10 THEN 'moderate' WHEN max(cyclomatic) <= 20 THEN 'complex' ELSE 'very-complex' END AS evaluation FROM f GROUP BY path""")
def complexity_of_files(spark, sf_dir):
    c = F.col("l_quantity").cast("long")
    functions = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("name"), c.alias("cyclomatic"), metrics.cognitive_from(c).alias("cognitive")
    )
    return metrics.roll_up(functions).withColumn("average", F.floor(F.col("average") * 1e6 + 0.5))


@query(f"SELECT {_PATH} AS path, 4::BIGINT AS cognitive FROM supplier UNION ALL SELECT '/src/n' || n_nationkey || '/index.ts', 0 FROM nation")
def code_cognitive(spark, sf_dir):
    from ..operators.lines import to_lines

    return metrics.cognitive(to_lines(_code(spark, sf_dir)))


@query(r"""
SELECT count(*) FILTER (regexp_matches(text, '\basync\b')) AS async_files, bool_or(contains(text, 'Promise')) AS promises, bool_or(regexp_matches(text, '\binterface\b')) AS interfaces,
  bool_or(regexp_matches(text, '<[A-Z]\w*>')) AS generics, bool_or(regexp_matches(text, '\benum\b')) AS enums FROM documents""")
def code_presence(spark, sf_dir):
    return rules.presence(_t(spark, sf_dir, "documents"), "text")


@query("SELECT p_partkey, NOT regexp_matches(replace(p_name, ' ', '_'), '^(?:[a-z0-9]+(?:[-.][a-z0-9]+)*|[a-zA-Z][a-zA-Z0-9]*)$') AS odd FROM part")
def file_name_styles(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", rules.file_name_style(F.concat(F.lit("/x/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".ts"))).alias("odd"))


# --- clones

_TOKEN_SQL = clones.TOKENS.replace("'", "''")


@query(f"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{_TOKEN_SQL}'), lambda x: NOT starts_with(x, '//')) AS t, len(string_split(text, chr(10))) AS lines FROM documents),
g AS (SELECT md5(array_to_string(t, '')) AS hash, count(*) AS members, CAST(max(lines) AS INTEGER) AS lines, min(doc_id) AS first FROM t WHERE len(t) >= 5 GROUP BY ALL HAVING count(*) > 1)
SELECT *, CASE WHEN members >= 5 OR lines >= 50 THEN 'high' WHEN members >= 3 OR lines >= 20 THEN 'medium' ELSE 'low' END AS severity FROM g""")
def clones_exact_operator(spark, sf_dir):
    return clones.exact(_t(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"""
SELECT {_PATH} AS path, 'method' AS kind, 5 AS start_line, 10 AS end_line FROM supplier""")
def code_fragments(spark, sf_dir):
    return clones.fragments(_code(spark, sf_dir)).select("path", "kind", "start_line", "end_line").where("kind = 'method'")


@query("""
WITH g AS (SELECT s_suppkey % 5 = 0 AS five, len(s_suppkey::VARCHAR) AS n FROM supplier)
SELECT count(DISTINCT s_suppkey) AS files, count(DISTINCT s_suppkey) AS variants FROM supplier""")
def clones_normalised_operator(spark, sf_dir):
    """Methods that differ in one number alone."""
    found = clones.normalised(clones.fragments(_code(spark, sf_dir)).where("kind = 'method'"))
    return found.select("files", "variants")


# --- score

@query("""
WITH f AS (SELECT o_custkey AS path, count(*) AS functions, max(o_orderkey % 23) AS most, avg(o_orderkey % 9)::DOUBLE AS average, sum(o_orderkey % 4) AS cognitive, max(o_orderkey % 8) AS params FROM orders GROUP BY ALL),
p AS (SELECT count(*) FILTER (most > 10) / sum(functions) * 100 AS high_complexity, count(*) FILTER (average > 5) / sum(functions) * 100 AS long_functions,
  count(*) FILTER (cognitive > 15) / sum(functions) * 100 AS deep_nesting, count(*) FILTER (params > 5) / sum(functions) * 100 AS many_params FROM f)
SELECT *, floor((high_complexity * 0.4::DOUBLE + long_functions * 0.25::DOUBLE + deep_nesting * 0.2::DOUBLE + many_params * 0.15::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM p""")
def score_complexity(spark, sf_dir):
    return score.complexity_dimension(_functions(spark, sf_dir))


def _functions(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(
        F.count("*").alias("functions"), F.max(k % 23).alias("most"), F.avg(k % 9).alias("average"), F.sum(k % 4).alias("cognitive"), F.max(k % 8).alias("params")
    )


def _architecture(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").agg(
        F.count_if(F.col("c_acctbal") < -950).alias("cycles"), F.count_if(F.col("c_nationkey") == 3).alias("orphans"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("coupled"), F.count("*").alias("files")
    )


_SQL_ARCHITECTURE = """a AS (SELECT least(cycles * 10.0::DOUBLE, 100.0::DOUBLE) AS cycles, orphans / files * 100 AS orphans, coupled / files * 100 AS coupling FROM (
  SELECT count(*) FILTER (c_acctbal < -950) AS cycles, count(*) FILTER (c_nationkey = 3) AS orphans, count(*) FILTER (c_mktsegment = 'MACHINERY') AS coupled, count(*) AS files FROM customer)),
b AS (SELECT *, floor((cycles * 0.6::DOUBLE + orphans * 0.25::DOUBLE + coupling * 0.15::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM a)"""


@query(f"WITH {_SQL_ARCHITECTURE} SELECT * FROM b")
def score_architecture(spark, sf_dir):
    return score.architecture_dimension(_architecture(spark, sf_dir))


def _qa(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").agg(
        F.count_if(F.col("n_chars") > 30000).alias("type_issues"), F.count_if(F.col("n_chars") < 12).alias("error_issues"), F.count_if(F.col("lang") == "es").alias("naming_issues"),
        F.count_if(F.col("n_chars") > 60000).alias("security_issues"), F.count_if(F.col("doc_id") % 3 == 0).alias("tests"), F.count("*").alias("files"),
    )


_SQL_QA = """c AS (SELECT count(*) FILTER (n_chars > 30000) AS t, count(*) FILTER (n_chars < 12) AS e, count(*) FILTER (lang = 'es') AS n, count(*) FILTER (n_chars > 60000) AS s, count(*) FILTER (doc_id % 3 = 0) AS tests, count(*) AS files FROM documents),
q AS (SELECT least((t * 5)::DOUBLE, 100.0::DOUBLE) AS type_safety, 100.0::DOUBLE - least(tests / files, 1.0::DOUBLE) * 100 AS missing_tests, least((e * 5)::DOUBLE, 100.0::DOUBLE) AS error_handling, least((n * 2)::DOUBLE, 100.0::DOUBLE) AS naming, least((s * 10)::DOUBLE, 100.0::DOUBLE) AS security FROM c),
z AS (SELECT *, floor((type_safety * 0.3::DOUBLE + missing_tests * 0.25::DOUBLE + error_handling * 0.2::DOUBLE + naming * 0.15::DOUBLE + security * 0.1::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM q)"""


@query(f"WITH {_SQL_QA} SELECT * FROM z")
def score_qa(spark, sf_dir):
    return score.qa_dimension(_qa(spark, sf_dir))


@query(f"""
WITH {_SQL_ARCHITECTURE}, {_SQL_QA}, d AS (SELECT b.score AS a, z.score AS q FROM b, z),
t AS (SELECT floor((a * 0.3::DOUBLE + a * 0.3::DOUBLE + a * 0.3::DOUBLE + q * 0.2::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS total FROM d)
SELECT total, CASE WHEN total >= 85 THEN 'F' WHEN total >= 70 THEN 'D' WHEN total >= 50 THEN 'C' WHEN total >= 30 THEN 'B' ELSE 'A' END AS grade FROM t""")
def score_total(spark, sf_dir):
    """Architecture stands for three of the dimensions."""
    one = score.architecture_dimension(_architecture(spark, sf_dir))
    return score.total(score.combine(one, one, one, score.qa_dimension(_qa(spark, sf_dir))))


# --- snapshots and rewrites

@query(r"""
WITH f AS (SELECT '/src/n' || s_nationkey AS dir, 15 AS lines, 2 AS exports, 2 AS imports FROM supplier UNION ALL SELECT '/src/n' || n_nationkey, 3, 1, 1 FROM nation)
SELECT dir, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(exports) AS BIGINT) AS exports, CAST(sum(imports) AS BIGINT) AS imports FROM f GROUP BY dir""")
def code_structure(spark, sf_dir):
    return snapshot.structure(_code(spark, sf_dir))


@query("""
WITH a AS (SELECT doc_id AS path, sha256(text) AS h, len(string_split(text, chr(10))) AS l FROM documents WHERE lang <> 'es'),
b AS (SELECT doc_id AS path, sha256(text || chr(10) || 'one more') AS h, len(string_split(text, chr(10))) + 1 AS l FROM documents WHERE lang <> 'de')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, CAST(abs(coalesce(b.l, 0) - coalesce(a.l, 0)) AS INTEGER) AS lines_changed
FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def snapshot_lines_changed(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang", F.col("text").alias("content"))
    more = files.withColumn("content", F.concat("content", F.lit("\none more")))
    return snapshot.diff(snapshot.file_hashes(files.where("lang <> 'es'")), snapshot.file_hashes(more.where("lang <> 'de'")))


@query("""
SELECT p_partkey, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'c' WHEN 'rod' THEN 'f' WHEN 'bolt' THEN 'pm' ELSE 'zz' END AS code FROM part""")
def symbol_codes(spark, sf_dir):
    word = F.element_at(F.split("p_name", " "), 2)
    kind = F.when(word == "ring", "class").when(word == "rod", "function").when(word == "bolt", "parameter").otherwise("zzz")
    return _t(spark, sf_dir, "part").select("p_partkey", snapshot.symbol_code(kind).alias("code"))


@query("""
SELECT doc_id, floor((1 - len(trim(text, ' ')) / len(text)) * 100 * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS ratio FROM documents WHERE len(text) > 0""")
def compression_ratios(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("length(text) > 0")
    return docs.select("doc_id", snapshot.compression_ratio(F.length("text"), F.length(F.trim("text"))).alias("ratio"))


@query(r"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '\bthe\b', chr(1), 'g'), '\band\b', 'the', 'g'), chr(1), 'and')) AS hash FROM documents")
def rename_exchanged(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return rewrite.batch_rename(files, {"the": "and", "and": "the"}).select("doc_id", F.md5("content").alias("hash"))


@query("SELECT doc_id::VARCHAR AS path, md5(text) AS hash FROM documents")
def rename_undone(spark, sf_dir):
    """A rename by edits, and its inverse by edits."""
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    edits = rewrite.rename_edits(files, "the", "der")
    back = rewrite.apply_edits(rewrite.apply_edits(files, edits), rewrite.inverted(edits))
    return back.select("path", F.md5("content").alias("hash"))


@query(r"""
SELECT count(DISTINCT doc_id) FILTER (n > 0) AS files, CAST(sum(n) AS BIGINT) AS edits, CAST(sum(n) * 10 AS BIGINT) AS millis FROM (SELECT doc_id, len(regexp_extract_all(text, '\bthe\b')) AS n FROM documents)""")
def rename_preview(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return rewrite.preview(rewrite.rename_edits(files, "the", "der"))


@query("""
SELECT p_partkey, regexp_matches(w, '^[a-zA-Z_][a-zA-Z0-9_]*$') AND w NOT IN ('let', 'case') AS valid FROM (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'let' WHEN 1 THEN p_name WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN '9' || p_name ELSE 'case' END AS w FROM part)""")
def valid_names(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "let").when(k == 1, F.col("p_name")).when(k == 2, F.element_at(F.split("p_name", " "), 1)).when(k == 3, F.concat(F.lit("9"), "p_name")).otherwise("case")
    return _t(spark, sf_dir, "part").select("p_partkey", rewrite.valid_name(name).alias("valid"))


@query(f"SELECT '/lib/s' || s_suppkey || '.ts' AS path, 2 AS line, './index' AS old, '../src/n' || s_nationkey || '/index' AS new FROM supplier WHERE s_suppkey % 10 = 0")
def move_updates(spark, sf_dir):
    code = _code(spark, sf_dir)
    return rewrite.move_updates(symbols.imports(code), code, _moves(spark, sf_dir))


def _moves(spark, sf_dir) -> DataFrame:
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    return _t(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(
        F.concat(F.lit("/src/n"), n, F.lit("/s"), k, F.lit(".ts")).alias("src"), F.concat(F.lit("/lib/s"), k, F.lit(".ts")).alias("dst")
    )


@query(f"""
SELECT CASE WHEN s_suppkey % 10 = 0 THEN '/lib/s' || s_suppkey || '.ts' ELSE {_PATH} END AS path,
  CASE WHEN s_suppkey % 10 = 0 THEN 'import type {{ Index }} from ''../src/n' || s_nationkey || '/index''' ELSE 'import type {{ Index }} from ''./index''' END AS line2 FROM supplier""")
def move_applied(spark, sf_dir):
    code = _code(spark, sf_dir)
    moved = rewrite.apply_moves(code, symbols.imports(code), _moves(spark, sf_dir))
    return moved.where(~F.col("path").endswith("index.ts")).select("path", F.get(F.split("content", "\n"), 1).alias("line2"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/src/app/' || p_name WHEN 1 THEN './' || p_name WHEN 2 THEN '/' || p_name ELSE p_name END AS path, CASE p_partkey % 4 WHEN 0 THEN 'alias' WHEN 1 THEN 'relative' WHEN 2 THEN 'absolute' ELSE 'package' END AS kind FROM part""")
def alias_specifiers(spark, sf_dir):
    k = F.col("p_partkey") % 4
    spec = F.concat(F.when(k == 0, "@app/").when(k == 1, "./").when(k == 2, "/").otherwise(""), "p_name")
    aliases = {"@app/*": "/src/app/*"}
    return _t(spark, sf_dir, "part").select("p_partkey", rewrite.alias_path(spec, aliases).alias("path"), rewrite.specifier_kind(spec, aliases).alias("kind"))


# --- streams, sessions, caches

def _changes(spark, sf_dir) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("click", "change", "view", "add", "purchase", "unlink", "signup", "other", "error", "addDir")])
    name = F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string"), F.lit("/f"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".ts").otherwise(".md"))
    return _events(spark, sf_dir).select(name.alias("path"), "ts", F.element_at(kind, F.col("event_type")).alias("change"), "event_id")


_SQL_CHANGES = """c AS (SELECT 'd' || user_id % 7 || '/f' || user_id || CASE WHEN event_id % 2 = 0 THEN '.ts' ELSE '.md' END AS path, ts, event_id,
  CASE event_type WHEN 'click' THEN 'change' WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'unlink' WHEN 'signup' THEN 'other' ELSE 'addDir' END AS change FROM events)"""


@query(f"WITH {_SQL_CHANGES} SELECT event_id, path, change FROM c WHERE change <> 'other' AND (change = 'addDir' OR path LIKE '%.ts') AND NOT starts_with(path, 'd3/')")
def changes_accepted(spark, sf_dir):
    return changes.accepted(_changes(spark, sf_dir), (".ts",), ("d3/**",)).select("event_id", "path", "change")


@query(f"""
WITH {_SQL_CHANGES}, l AS (SELECT path, max_by(change, (ts, change)) AS change, max(ts) AS ts FROM c GROUP BY path), old AS (SELECT DISTINCT 'd' || user_id % 7 || '/f' || user_id || '.js' AS path FROM events UNION SELECT path FROM c)
SELECT path FROM old WHERE path NOT IN (SELECT path FROM l WHERE change IN ('add', 'change', 'unlink')) UNION SELECT path FROM l WHERE change IN ('add', 'change')""")
def changes_folded(spark, sf_dir):
    found = _changes(spark, sf_dir)
    start = F.lit("2000-01-01").cast("timestamp").alias("ts")
    current = found.select(F.regexp_replace("path", r"\.(?:ts|md)$", ".js").alias("path")).unionByName(found.select("path")).distinct().select("path", start)
    return changes.folded(current, found.select("path", "ts", "change")).select("path")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id % 5 DESC, ts, event_id) AS INTEGER) AS place FROM events")
def events_by_priority(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), (F.col("event_id") % 5).alias("priority"), "ts")
    return changes.by_priority(e).select(F.col("id").alias("event_id"), "place")


@query("SELECT user_id FROM events GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-02-01' - INTERVAL 30 MINUTE")
def sessions_expired(spark, sf_dir):
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("ended"))
    return changes.expired(last.select("user_id", F.to_timestamp(F.date_format("ended", "yyyy-MM-dd HH:mm:ss")).alias("ended")), "2024-02-01 00:00:00").select("user_id")


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type <> 'click') AS hits, count(*) FILTER (event_type = 'click') AS misses, count(*) FILTER (event_type = 'error') AS evictions, count(*) * 10 AS bytes, (user_id % 9)::DOUBLE AS millis FROM events GROUP BY user_id)
SELECT CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(evictions) AS BIGINT) AS evictions, CAST(sum(bytes) AS BIGINT) AS bytes, floor(sum(millis * (hits + misses)) / sum(hits + misses) * 1e9 + 0.5) AS millis FROM c""")
def cache_stats_merged(spark, sf_dir):
    t = F.col("event_type")
    c = _events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(t != "click").alias("hits"), F.count_if(t == "click").alias("misses"), F.count_if(t == "error").alias("evictions"), (F.count("*") * 10).alias("bytes")
    ).withColumn("millis", (F.col("user_id") % 9).cast("double"))
    return changes.merge_cache_stats(c).withColumn("millis", F.floor(F.col("millis") * 1e9 + 0.5))


_SQL_ITEMS = "i AS (SELECT user_id AS key, min(ts) AS created, max(ts) AS accessed, count(*) AS uses FROM events GROUP BY user_id)"


@query(f"""
WITH {_SQL_ITEMS} (SELECT 'lru' AS policy, key FROM i ORDER BY accessed, key LIMIT 7) UNION ALL (SELECT 'lfu', key FROM i ORDER BY uses, accessed, key LIMIT 7) UNION ALL (SELECT 'fifo', key FROM i ORDER BY created, key LIMIT 7)""")
def cache_evicted(spark, sf_dir):
    items = _events(spark, sf_dir).groupBy(F.col("user_id").alias("key")).agg(F.min("ts").alias("created"), F.max("ts").alias("accessed"), F.count("*").alias("uses"))
    out = None
    for policy in ("lru", "lfu", "fifo"):
        got = changes.evicted(items, policy, 7).select(F.lit(policy).alias("policy"), "key")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT user_id AS module, event_type AS type, count(*) AS n, epoch_us(max(ts)) AS last_ts FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL")
def errors_by_module(spark, sf_dir):
    errors = _events(spark, sf_dir).where("event_type in ('error', 'signup')").select(F.col("user_id").alias("module"), F.col("event_type").alias("type"), "ts")
    return changes.error_stats(errors)[0].withColumn("last_ts", F.unix_micros("last_ts"))


@query("""
SELECT event_id, CAST(least(30000, 1000 * power(2, event_id % 8)) AS BIGINT) AS doubled, CAST(least(30000, 1000 * (event_id % 8 + 1)) AS BIGINT) AS linear FROM events""")
def retry_backoff(spark, sf_dir):
    n = F.col("event_id") % 8 + 1
    return _t(spark, sf_dir, "events").select("event_id", changes.backoff_millis(n).alias("doubled"), changes.backoff_millis(n, kind="linear").alias("linear"))


# --- scalars

_SQL_WORDS = "w AS (SELECT doc_id, list_filter(string_split(left(text, 300), ' '), lambda x: x <> '') AS w FROM documents)"


def _words(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.substring("text", 1, 300), " "), lambda x: x != "").alias("w"))


@query(f"""
WITH {_SQL_WORDS} SELECT doc_id, array_to_string(list_transform(range(0, len(w), 3), lambda i: array_to_string(w[i + 1 : i + 3], '-')), '|') AS chunks,
  array_to_string(list_filter(w, lambda x: x NOT IN ('the', 'de', 'la')), ' ') AS rest, array_to_string(list_filter(w, lambda x: x IN ('the', 'de', 'la')), ' ') AS common, array_to_string(list_filter(w, lambda x: len(x) > 4), ' ') AS long FROM w""")
def array_functions(spark, sf_dir):
    w, some = F.col("w"), F.array(*map(F.lit, ("the", "de", "la")))
    return _words(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(s.chunk(w, 3), lambda c: F.array_join(c, "-")), "|").alias("chunks"), F.array_join(s.difference(w, some), " ").alias("rest"),
        F.array_join(s.intersection(w, some), " ").alias("common"), F.array_join(s.partition(w, lambda x: F.length(x) > 4)["yes"], " ").alias("long"),
    )


@query("""
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, a || upper(b[1]) || substr(b, 2) AS camel, a || '-' || b AS slug, 'part ' || a || ' of {{c}}' AS filled FROM p""")
def name_functions(spark, sf_dir):
    n = F.col("p_name")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", s.camel_case(n).alias("camel"), s.slugify(F.concat(F.lit(" "), F.upper(n), F.lit("!? "))).alias("slug"),
        s.fill_template(F.lit("part {{a}} of {{c}}"), F.create_map(F.lit("a"), F.element_at(F.split(n, " "), 1))).alias("filled"),
    )


@query("""
WITH p AS (SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1) || '.html' AS p FROM pages), l AS (SELECT page_id, p, string_split(p, '/') AS l FROM p)
SELECT page_id, array_to_string(l[1 : len(l) - 1], '/') AS dir, l[-1] AS base, CASE WHEN l[-1] = '.html' THEN '' ELSE '.html' END AS ext,
  CASE WHEN l[-1] = '.html' THEN '.html' ELSE regexp_replace(l[-1], '[.]html$', '') END AS stem, CASE WHEN l[-1] = '.html' THEN p || '.md' ELSE regexp_replace(p, '[.]html$', '.md') END AS changed, CAST(len(list_filter(l, lambda x: x <> '')) AS INTEGER) AS depth, starts_with(p, l[1] || '/') AS below FROM l""")
def path_functions(spark, sf_dir):
    p = F.concat(F.element_at(F.split(F.regexp_replace("url", "^[a-z]+://", ""), r"\?"), 1), F.lit(".html"))
    at = F.col("p")
    return _t(spark, sf_dir, "pages").select("page_id", p.alias("p")).select(
        "page_id", s.dirname(at).alias("dir"), s.basename(at).alias("base"), s.extension(at).alias("ext"), s.stem(at).alias("stem"), s.change_extension(at, "md").alias("changed"),
        s.path_depth(at).alias("depth"), s.is_sub_path(at, F.element_at(F.split(at, "/"), 1)).alias("below"),
    )


@query("""
WITH n AS (SELECT doc_id, n_chars * 64 AS n FROM documents), u AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 1 WHEN n < 1048576 THEN 1024 ELSE 1048576 END AS u FROM n)
SELECT doc_id, format('{:.2f}', floor(n / u * 100 + 0.5) / 100) || CASE u WHEN 1 THEN ' B' WHEN 1024 THEN ' KB' ELSE ' MB' END AS size FROM u""")
def size_names(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", s.format_bytes(F.col("n_chars") * 64).alias("size"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'click') / count(*) AS rate FROM events GROUP BY user_id")
def hit_rates(spark, sf_dir):
    t = F.col("event_type")
    n = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(t != "click").alias("h"), F.count_if(t == "click").alias("m"))
    return n.select("user_id", s.hit_rate(F.col("h"), F.col("m")).alias("rate"))


@query("""
SELECT p_partkey, coalesce(array_to_string(list_sort(map_keys(m)), ','), '') AS picked FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN MAP {'a': 1, 'b': 2} ELSE MAP {'b': 2} END AS m FROM part)""")
def object_functions(spark, sf_dir):
    """a is there for even parts; c and d are merged in, and d and e taken away again."""
    lit = F.lit
    own = F.when(F.col("p_partkey") % 2 == 0, F.create_map(lit("a"), lit(1), lit("b"), lit(0))).otherwise(F.create_map(lit("b"), lit(0)))
    both = s.omit(s.merged(own, F.create_map(lit("b"), lit(2), lit("c"), lit(3), lit("d"), lit(4))), "d", "e")
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.map_keys(s.pick(both, "a", "b", "x"))), ",").alias("picked"))


@query(r"""
SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, false AS other FROM events""")
def object_paths(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", s.at_path(F.col("props"), "k").alias("k"), s.has_path(F.col("props"), "k.z").alias("other"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
i AS (SELECT w, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM c GROUP BY w), x AS (SELECT doc_id, w, n * idf AS x, idf FROM c JOIN i USING (w)),
d AS (SELECT doc_id, sum(x * idf * CASE w WHEN 'license' THEN 2 ELSE 1 END) FILTER (w IN ('license', 'under', 'the')) AS dot, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id),
q AS (SELECT sqrt(sum(power(idf * CASE w WHEN 'license' THEN 2 ELSE 1 END, 2))) AS q FROM i WHERE w IN ('license', 'under', 'the'))
SELECT doc_id, floor(dot / norm / q * 1e9 + 0.5) AS score FROM d, q WHERE dot IS NOT NULL""")
def search_semantic(spark, sf_dir):
    found = textsearch.semantic(_t(spark, sf_dir, "documents"), "license under the License", (1 << 31) - 1, "text", "doc_id")
    return found.select("doc_id", F.floor(F.col("score") * 1e9 + 0.5).alias("score"))


@query(r"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'type' WHEN 1 THEN 'dev' ELSE 'runtime' END AS category, CASE p_partkey % 4 WHEN 2 THEN './a/' || p_name WHEN 1 THEN '@types/' || p_name ELSE p_name END AS path FROM part""")
def dependency_categories(spark, sf_dir):
    k = F.col("p_partkey") % 4
    spec = F.when(k == 2, F.concat(F.lit(".\\a\\"), "p_name", F.lit("?raw#x"))).when(k == 1, F.concat(F.lit("@types/"), "p_name", F.lit("#y"))).otherwise(F.col("p_name"))
    return _t(spark, sf_dir, "part").select("p_partkey", symbols.dependency_category(spec, k == 0).alias("category"), symbols.clean_specifier(spec).alias("path"))
