"""Queries that run the operators on the test tables, and their SQL.

The tables hold no source code, so adapters stand in: documents are files and
lines, pages are files with links, conversations are files, events are change
and session streams, parts are symbols, and consecutive parts of an order are
the edges of a graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as s
from ..operators import clones, graph, index, metrics, rewrite, rules, score, snapshot, textsearch
from ..operators.lines import enclosing, to_lines
from ..operators.textsearch import Query
from ..sources.tree import documents_as_files
from ..streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir, context: int = 0) -> DataFrame:
    return to_lines(_t(spark, sf_dir, "documents"), "text", ("doc_id",), context)


_SQL_LINES = """lines AS (
  SELECT doc_id, CAST(i AS INTEGER) AS line, l[i] AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
)"""
_SQL_HITS = """hits AS (
  SELECT doc_id, line, text, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + (i - 1) * len(q) + 1 AS INTEGER) AS col
  FROM (SELECT doc_id, line, text, q, p, unnest(range(1, len(p))) AS i
        FROM (SELECT doc_id, line, text, 'that' AS q, string_split(lower(text), 'that') AS p FROM lines))
)"""


# --- search

@query(f"""
WITH {_SQL_LINES}, {_SQL_HITS}, m AS (SELECT *, substr(text, col, 4) AS match FROM hits)
SELECT doc_id, line, col AS "column", match,
  least(1.0::DOUBLE, (CASE WHEN match = 'that' THEN 1.0 WHEN lower(match) = 'that' THEN 0.8 ELSE 0.5 END)::DOUBLE + len(match) / 4 * 0.2::DOUBLE
    + (1 - (strpos(text, match) - 1) / len(text)) * 0.2::DOUBLE + (1 - least(len(text) / 200, 1.0::DOUBLE)) * 0.1::DOUBLE) AS score
FROM m ORDER BY score DESC, doc_id, line, col LIMIT 100""")
def search_literal_topk(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return textsearch.search(docs, Query("that"), 100, content="text", keep=("doc_id",)).select("doc_id", "line", "column", "match", "score")


@query(r"""
SELECT CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS files FROM (SELECT len(regexp_extract_all(text, '(?i)(?:tion|ing)[a-z]{2,}')) AS n FROM documents)""")
def search_regex_count(spark, sf_dir):
    return textsearch.total(_t(spark, sf_dir, "documents"), Query("(?:tion|ing)[a-z]{2,}", regex=True), "text")


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\bles\b')) AS INTEGER) AS hits FROM documents WHERE regexp_matches(text, '(?i)\bles\b')""")
def search_whole_word(spark, sf_dir):
    pattern = Query("les", whole_word=True).pattern()
    docs = _t(spark, sf_dir, "documents").where(F.col("text").rlike(pattern))
    return docs.select("doc_id", F.regexp_count("text", F.lit(pattern)).alias("hits"))


@query("SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'license')")
def search_invert(spark, sf_dir):
    return textsearch.without_match(_t(spark, sf_dir, "documents"), Query("license"), "text").select("doc_id")


@query(f"""
WITH {_SQL_LINES}, c AS (
  SELECT *, lag(text) OVER w AS before1, lead(text) OVER w AS after1 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)
) SELECT doc_id, line, text, before1, after1 FROM c WHERE contains(lower(text), 'license')""")
def search_context(spark, sf_dir):
    lines = _lines(spark, sf_dir, context=1).where(F.lower("text").contains("license"))
    return lines.select("doc_id", "line", "text", F.get("before", 0).alias("before1"), F.get("after", 0).alias("after1"))


@query(f"""
WITH {_SQL_LINES}, h AS (
  SELECT doc_id, line, last_value(nullif(regexp_extract(text, '^([A-Z][a-z]+)[.]$', 1), '') IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM lines
) SELECT doc_id, line, heading FROM h WHERE heading IS NOT NULL""")
def search_enclosing_heading(spark, sf_dir):
    return enclosing(_lines(spark, sf_dir), r"^([A-Z][a-z]+)[.]$", "doc_id", "heading").where("heading is not null").select("doc_id", "line", "heading")


@query(r"""
SELECT q.id AS query_id, CAST(sum(len(regexp_extract_all(text, q.p))) AS BIGINT) AS hits, count(*) FILTER (regexp_matches(text, q.p)) AS files
FROM documents, (VALUES ('license', '(?i)license'), ('numbers', '[0-9]{2,}'), ('und', '\b[Uu]nd\b')) q(id, p) GROUP BY q.id""")
def search_batch(spark, sf_dir):
    queries = {"license": Query("license"), "numbers": Query("[0-9]{2,}", regex=True, case_sensitive=True), "und": Query("[Uu]nd", regex=True, case_sensitive=True, whole_word=True)}
    return textsearch.batch(_t(spark, sf_dir, "documents"), queries, "text")


@query(f"""
WITH {_SQL_LINES} SELECT doc_id, line FROM lines WHERE regexp_matches(text, '(?i)t.*?h.*?e.*?r.*?o.*?n')""")
def search_fuzzy(spark, sf_dir):
    return _lines(spark, sf_dir).where(F.col("text").rlike(Query("theron", fuzzy=True).pattern())).select("doc_id", "line")


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT word AS suggestion, (greatest(len(word), 5) - levenshtein(lower(word), 'steal')) / greatest(len(word), 5) AS score
FROM w WHERE (greatest(len(word), 5) - levenshtein(lower(word), 'steal')) / greatest(len(word), 5) >= 0.3 ORDER BY score DESC, suggestion LIMIT 10""")
def suggest_levenshtein(spark, sf_dir):
    words = _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return textsearch.suggest(words, "steal", least=0.3)


@query("""
SELECT event_type AS query, count(*) AS times, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean_millis, max(ts) AS last_ts FROM events GROUP BY event_type""")
def query_stats(spark, sf_dir):
    return textsearch.query_stats(_t(spark, sf_dir, "events"), "event_type", "ts", "value").withColumn("mean_millis", F.floor(F.col("mean_millis") * 1e6 + 0.5) / 1e6)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def recent_queries(spark, sf_dir):
    return textsearch.recent(_t(spark, sf_dir, "events"), 5, ("user_id",), tie="event_id").select("user_id", "event_id")


# --- index

def _symbols(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.element_at(F.split("p_name", " "), 1).alias("name"), F.element_at(F.split("p_type", " "), 1).alias("type"), F.col("p_brand").alias("path"),
        F.split("p_type", " ").alias("modifiers"), F.col("p_size").alias("size"),
    )


_SQL_SYMBOLS = "s AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS name, string_split(p_type, ' ')[1] AS type, p_brand AS path, string_split(p_type, ' ') AS modifiers FROM part)"


@query("SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, max(source) AS last_source FROM documents GROUP BY lang")
def files_by_language(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.max("source").alias("last_source"))


@query("""
SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' ELSE 'total' END AS dimension,
  CASE WHEN GROUPING(lang) = 0 THEN lang WHEN GROUPING(source) = 0 THEN source END AS value, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def index_stats_grouping_sets(spark, sf_dir):
    return index.stats(_t(spark, sf_dir, "documents"), "lang", "source")


@query(f"WITH {_SQL_SYMBOLS} SELECT id, name, 1.0::DOUBLE AS score FROM s WHERE name = (SELECT min(name) FROM s)")
def symbol_exact(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    least = symbols.agg(F.min("name")).first()[0]
    return index.exact(symbols.select("id", "name"), least, order=("id",), limit=(1 << 31) - 1)


@query(f"""
WITH {_SQL_SYMBOLS} SELECT id, name, 3 / greatest(len(name), 3) AS score FROM s WHERE regexp_matches(name, '(?i)s.*e.*l') ORDER BY score DESC, name, id LIMIT 100""")
def symbol_fuzzy(spark, sf_dir):
    return index.fuzzy(_symbols(spark, sf_dir), "sel", tie=("id",)).select("id", "name", "score")


@query(f"WITH {_SQL_SYMBOLS} SELECT id, name FROM s WHERE regexp_matches(name, '^s.*l.$')")
def symbol_glob(spark, sf_dir):
    return index.by_glob(_symbols(spark, sf_dir), "s*l?").select("id", "name")


@query(f"""
WITH {_SQL_SYMBOLS}, x AS (SELECT id, name, CASE WHEN lower(name) = 'ring' THEN 1.0 WHEN starts_with(lower(name), 'ring') THEN 0.8 WHEN contains(lower(name), 'ring') THEN 0.6 END::DOUBLE AS score FROM s)
SELECT * FROM x WHERE score IS NOT NULL""")
def symbol_score(spark, sf_dir):
    return _symbols(spark, sf_dir).select("id", "name", index.substring_score(F.col("name"), "ring").alias("score")).where("score is not null")


@query(f"WITH {_SQL_SYMBOLS} SELECT id, name, type FROM s WHERE type = (SELECT min(type) FROM s) AND list_contains(modifiers, string_split((SELECT min(p_type) FROM part), ' ')[1])")
def structural_filter(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    least = _t(spark, sf_dir, "part").agg(F.min("p_type").alias("t")).select(F.split("t", " ").alias("t")).first()["t"]
    return index.structural(symbols, kind=least[0], modifier=least[0]).select("id", "name", "type")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def stale_entries(spark, sf_dir):
    return index.stale(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE l.quality END AS value FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def incremental_merge(spark, sf_dir):
    current = _t(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"))
    return index.merge(current, _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value")), key="doc_id")


@query("SELECT source, CAST(sum(len(source || '/' || doc_id) * 2 + 64 + 128 * len(string_split(text, chr(10)))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def index_size_estimate(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    bytes_ = index.size_estimate(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.size(F.split("text", "\n")), F.lit(0))
    return docs.groupBy("source").agg(F.sum(bytes_).alias("bytes"))


# --- graph

_HREF = r"""href="([^"]+)\""""


def _links(spark, sf_dir) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("href"))


def _edges(spark, sf_dir) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return items.where("dst is not null").distinct()


_SQL_EDGES = """e AS (SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
_SQL_LINKS = """k AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)"""


@query(f"WITH {_SQL_LINKS} SELECT page_id, href, count(*) AS n FROM k GROUP BY ALL")
def links_extract(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"""
WITH {_SQL_LINKS}, r AS (SELECT DISTINCT page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(href, '^[a-z]+://[^/]+', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS target FROM k)
SELECT r.page_id, r.target, count(p.page_id) AS found FROM r LEFT JOIN (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+', '') AS path FROM pages) p ON p.path = r.target GROUP BY ALL""")
def links_resolve(spark, sf_dir):
    host = "^[a-z]+://[^/]+"
    targets = _links(spark, sf_dir).select("page_id", s.normalize_path(F.concat(F.lit("/"), F.regexp_replace("href", host, ""))).alias("target")).distinct()
    known = _t(spark, sf_dir, "pages").select(F.regexp_replace("url", host, "").alias("target"), F.lit(1).alias("hit"))
    return targets.join(known, "target", "left").groupBy("page_id", "target").agg(F.count("hit").alias("found"))


@query(f"""
WITH {_SQL_EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node""")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"""
WITH {_SQL_EDGES}, d AS (SELECT p.p_partkey AS node, (SELECT count(*) FROM e WHERE e.dst = p.p_partkey) AS i, (SELECT count(*) FROM e WHERE e.src = p.p_partkey) AS o FROM part p)
SELECT count(*) AS files, CAST(sum(o) AS BIGINT) AS dependencies, floor(sum(o) / count(*) * 100 + 0.5) / 100.0::DOUBLE AS average, CAST(max(o) AS BIGINT) AS most, count(*) FILTER (i = 0 AND o = 0) AS orphans FROM d""")
def graph_stats(spark, sf_dir):
    return graph.stats(_edges(spark, sf_dir), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@query(f"WITH {_SQL_EDGES} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM e) AND p_partkey NOT IN (SELECT dst FROM e)")
def graph_orphans_isolated(spark, sf_dir):
    return graph.orphans(_edges(spark, sf_dir), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def graph_orphans_root(spark, sf_dir):
    edges = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return graph.orphans(edges, customers, "root").join(customers, "node", "left_semi")


@query(f"""
WITH RECURSIVE {_SQL_EDGES}, r(node) AS (SELECT dst FROM e WHERE src = (SELECT min(src) FROM e) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def graph_reach(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.reach(edges, edges.agg(F.min("src").alias("node"))).select("node")


@query(f"""
WITH {_SQL_EDGES}, t AS (SELECT min(src) AS o FROM e), a AS (SELECT DISTINCT e.src AS node FROM e, t WHERE e.dst = t.o AND e.src <> t.o),
b AS (SELECT node FROM a UNION SELECT e.src FROM e JOIN a ON e.dst = a.node), c AS (SELECT DISTINCT node FROM b, t WHERE node <> t.o)
SELECT t.o AS origin, (SELECT count(*) FROM a) AS direct, (SELECT count(*) FROM c) AS within_two FROM t""")
def graph_impact(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    back = graph.reach(edges, edges.agg(F.min("src").alias("node")), depth=2, backward=True).where("origin <> node")
    return back.groupBy("origin").agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count("*").alias("within_two"))


@query(f"""
WITH RECURSIVE {_SQL_EDGES}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT n.node, least(n.node, min(x.b)) AS component FROM n LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON r.a = q.b AND r.b = q.a) x ON x.a = n.node GROUP BY n.node""")
def graph_scc(spark, sf_dir):
    return graph.strong_components(_edges(spark, sf_dir))


@query(f"WITH {_SQL_EDGES} SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def graph_mutual(spark, sf_dir):
    return graph.mutual(_edges(spark, sf_dir))


def _places(spark, sf_dir) -> DataFrame:
    """Customers and suppliers depend on nations, those on regions."""
    customer, supplier, nation = (_t(spark, sf_dir, n) for n in ("customer", "supplier", "nation"))
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    return (
        customer.select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"))
        .unionByName(supplier.select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst")))
        .unionByName(nation.select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst")))
    )


_SQL_PLACES = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


@query(f"""
WITH RECURSIVE {_SQL_PLACES}, l(node, level) AS (
  SELECT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node
) SELECT node, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY node""")
def graph_topo_levels(spark, sf_dir):
    return graph.topological_levels(_places(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_SQL_PLACES}, u AS (SELECT src, dst FROM e WHERE src LIKE 'n%' UNION SELECT dst, src FROM e WHERE src LIKE 'n%'), r(a, b) AS (SELECT src, src FROM u UNION SELECT r.a, u.dst FROM r JOIN u ON u.src = r.b),
c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a) SELECT * FROM c""")
def graph_components(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    edges = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return graph.components(edges)


@query(f"""
WITH RECURSIVE {_SQL_PLACES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), m(node, component) AS (SELECT DISTINCT src, src FROM u UNION SELECT u.dst, m.component FROM m JOIN u ON u.src = m.node WHERE m.component LIKE 'c%')
SELECT node, min(component) AS component FROM m GROUP BY node""")
def graph_components_places(spark, sf_dir):
    """All places; nations and regions are hot nodes."""
    return graph.components(_places(spark, sf_dir))


@query()
def graph_components_edges(spark, sf_dir):
    """All pairs of consecutive parts, with long paths."""
    return graph.components(_edges(spark, sf_dir))


@query()
def cycles_severity(spark, sf_dir):
    found = graph.cycles(_edges(spark, sf_dir))
    return found.select("component", "length", F.array_join("cycle", ">").alias("cycle"), "severity", "fix")


# --- metrics

_FILES = lambda spark, sf_dir: _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
_OPS, _ONE = metrics.MULTI_OPERATORS.replace("'", "''"), metrics.SINGLE_OPERATORS.replace("'", "''")
_NUM = metrics.OPERANDS.replace("'", "''")
_SQL_HALSTEAD = rf"""c AS (SELECT doc_id, text,
  len(list_distinct(regexp_extract_all(text, '{_OPS}'))) + len(list_distinct(regexp_extract_all(text, '{_ONE}'))) AS h1, len(list_distinct(regexp_extract_all(text, '{_NUM}'))) AS h2,
  len(regexp_extract_all(text, '{_OPS}')) + len(regexp_extract_all(text, '{_ONE}')) AS t1, len(regexp_extract_all(text, '{_NUM}')) AS t2 FROM documents),
h AS (SELECT *, (t1 + t2) * log2(greatest(1, h1 + h2)::DOUBLE) AS v, h1 / 2.0::DOUBLE * (t2 / greatest(1, h2)) AS d FROM c)"""
_R2 = "floor(({}) * 100 + 0.5) / 100.0::DOUBLE"


@query(f"WITH {_SQL_HALSTEAD} SELECT doc_id, CAST(h1 AS BIGINT) AS h1, CAST(h2 AS BIGINT) AS h2, CAST(t1 AS BIGINT) AS t1, CAST(t2 AS BIGINT) AS t2, floor(v + 0.5) AS volume FROM h")
def halstead(spark, sf_dir):
    h = metrics.halstead(_FILES(spark, sf_dir))
    return h.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("h1", "h2", "t1", "t2")], s.round_half_up((F.col("t1") + F.col("t2")) * F.log2(F.greatest(F.lit(1), F.col("h1") + F.col("h2")).cast("double"))).alias("volume"))


_LOC = "len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))"


@query(rf"""
WITH {_SQL_HALSTEAD}, m AS (SELECT doc_id, greatest(0.0, 171 - 5.2 * ln(greatest(1.0, floor(v + 0.5))) - 0.23 * (1 + len(regexp_extract_all(text, '&&|\|\|'))) - 16.2 * ln(greatest(1.0, {_LOC}::DOUBLE)))::DOUBLE AS mi FROM h)
SELECT doc_id, floor(mi * 10 + 0.5)::BIGINT AS tenths, CASE WHEN mi >= 85 THEN 'A' WHEN mi >= 70 THEN 'B' WHEN mi >= 50 THEN 'C' WHEN mi >= 25 THEN 'D' ELSE 'F' END AS grade FROM m""")
def maintainability(spark, sf_dir):
    h = metrics.halstead(_FILES(spark, sf_dir)).withColumn("v", s.round_half_up((F.col("t1") + F.col("t2")) * F.log2(F.greatest(F.lit(1), F.col("h1") + F.col("h2")).cast("double"))).cast("double"))
    mi = metrics.maintainability_index(F.col("v"), 1 + F.regexp_count("content", F.lit(r"&&|\|\|")), metrics.lines_of_code(F.col("content")))
    return h.withColumn("mi", mi).select("doc_id", F.floor(F.col("mi") * 10 + 0.5).alias("tenths"), metrics.grade(F.col("mi")).alias("grade"))


@query(rf"""
SELECT doc_id, CAST({_LOC} AS INTEGER) AS loc, CAST(1 + len(regexp_extract_all(text, '\b(?:if|for|while|case|catch)\b')) + len(regexp_extract_all(text, '\belse\s+if\b'))
  + len(regexp_extract_all(text, '&&|\|\|')) + len(regexp_extract_all(text, '\?[^.?:\n]*:')) AS INTEGER) AS cyclomatic FROM documents""")
def code_metrics(spark, sf_dir):
    return metrics.code_metrics(_t(spark, sf_dir, "documents"), "text").select("doc_id", F.col("loc").cast("int").alias("loc"), F.col("cyclomatic").cast("int").alias("cyclomatic"))


@query(rf"""
WITH {_SQL_LINES} SELECT doc_id, line, value FROM (SELECT doc_id, line, unnest(regexp_extract_all(text, '\b[0-9]{{2,}}\b')) AS value FROM lines)""")
def smell_magic_number(spark, sf_dir):
    return metrics.magic_numbers(_lines(spark, sf_dir), "doc_id").select("doc_id", "line", "value")


@query(rf"""
WITH {_SQL_LINES} SELECT doc_id, line, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT doc_id, line, len(regexp_extract_all(text, '&&|\|\|')) AS n FROM lines) WHERE n >= 3""")
def smell_conditional(spark, sf_dir):
    return metrics.complex_conditions(_lines(spark, sf_dir), "doc_id").select("doc_id", "line", "severity")


@query(f"""
WITH {_SQL_LINES}, x AS (SELECT doc_id, line, trim(text, ' ') AS t, lead(trim(text, ' '), 1) OVER w AS a, lead(trim(text, ' '), 2) OVER w AS b FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line FROM x WHERE t = a AND t = b AND len(t) > 10""")
def smell_repeat3(spark, sf_dir):
    return metrics.repeated_lines(_lines(spark, sf_dir), "doc_id").select("doc_id", "line")


@query(rf"""
SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '\b(?:if|else|for|while|guard|switch|case)\b')) + len(regexp_extract_all(text, '&&|\|\||\?')) AS INTEGER) AS cyclomatic,
  CAST(floor((1 + len(regexp_extract_all(text, '\b(?:if|else|for|while|guard|switch|case)\b')) + len(regexp_extract_all(text, '&&|\|\||\?'))) * 1.2::DOUBLE) AS BIGINT) AS cognitive FROM documents""")
def cyclomatic_words(spark, sf_dir):
    c = metrics.cyclomatic_words(F.col("text")).cast("int")
    return _t(spark, sf_dir, "documents").select("doc_id", c.alias("cyclomatic"), metrics.cognitive_from(c).alias("cognitive"))


@query(r"""
WITH l AS (SELECT page_id, CAST(i AS INTEGER) AS line, p[i] AS text FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, string_split(html, '>') AS p FROM pages))),
d AS (SELECT page_id, line, coalesce(sum(len(regexp_extract_all(text, '<[a-z]')) - len(regexp_extract_all(text, '</'))) OVER (PARTITION BY page_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM l)
SELECT page_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(sum(depth) AS BIGINT) AS total FROM d GROUP BY page_id""")
def nesting_depth(spark, sf_dir):
    tags = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", ">")).alias("at", "text")).select("page_id", (F.col("at") + 1).alias("line"), "text")
    deep = metrics.nesting(tags, "page_id", opens="<[a-z]", closes="</")
    return deep.groupBy("page_id").agg(F.max("depth").alias("deepest"), F.sum("depth").alias("total"))


@query(r"""
SELECT doc_id, floor((len(string_split(text, chr(10))) * 0.1::DOUBLE + len(regexp_extract_all(text, '\bfunction\b|=>')) * 2 + len(regexp_extract_all(text, '\b(?:if|switch|for|while)\b')) * 1.5::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS complexity
FROM documents""")
def workflow_complexity(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", metrics.workflow_complexity(F.col("text")).alias("complexity"))


# --- rules

_SECRET = tuple(r for r in rules.RULES if r.type == "hardcoded-secret")


@query(rf"""
WITH {_SQL_LINES} SELECT doc_id, line, 'hardcoded-secret' AS type, 'critical' AS severity FROM lines
WHERE regexp_matches(text, '(?i)(?:password|passwd|pwd|secret|api_?key|token)["'']?\s*[:=]\s*["''`][^"''`]{{3,}}["''`]') AND NOT regexp_matches(text, '(?i)process\.env|config|import|require')""")
def issues_secrets(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return rules.issues(docs, _SECRET, "text", ("doc_id",), any_language=True).select("doc_id", "line", "type", "severity")


_DOC_RULES = (
    *_SECRET,
    rules.Rule("license", "license-line", "low", r"(?i)licensed under|license, version", "license line"),
    rules.Rule("naming", "shouting", "low", r"[A-Z]{4,}!!", "shouting"),
    rules.Rule("security", "address", "high", r"[a-z]+\.[0-9]+@", "personal address"),
)
_SQL_RULES = rf"""i AS (
  SELECT doc_id, line, 'security' AS category, 'critical' AS severity FROM lines WHERE regexp_matches(text, '(?i)(?:password|passwd|pwd|secret|api_?key|token)["'']?\s*[:=]\s*["''`][^"''`]{{3,}}["''`]') AND NOT regexp_matches(text, '(?i)process\.env|config|import|require')
  UNION ALL SELECT doc_id, line, 'license', 'low' FROM lines WHERE regexp_matches(text, '(?i)licensed under|license, version')
  UNION ALL SELECT doc_id, line, 'naming', 'low' FROM lines WHERE regexp_matches(text, '[A-Z]{{4,}}!!')
  UNION ALL SELECT doc_id, line, 'security', 'high' FROM lines WHERE regexp_matches(text, '[a-z]+\.[0-9]+@'))"""


@query(f"WITH {_SQL_LINES}, {_SQL_RULES} SELECT category, severity, count(*) AS n FROM i GROUP BY ALL")
def issues_by_category(spark, sf_dir):
    found = rules.issues(_t(spark, sf_dir, "documents"), _DOC_RULES, "text", ("doc_id",), any_language=True)
    return rules.by_category(found).select("category", "severity", "n")


@query(f"""
WITH {_SQL_LINES}, {_SQL_RULES} SELECT CAST(greatest(0, 100 - 15 * count(*) FILTER (category = 'security' AND severity = 'critical') - 10 * count(*) FILTER (category = 'security' AND severity <> 'critical')) AS BIGINT) AS security,
  CAST(greatest(0, 100 - 3 * count(*) FILTER (category = 'naming')) AS BIGINT) AS naming FROM i""")
def quality_deductions(spark, sf_dir):
    found = rules.issues(_t(spark, sf_dir, "documents"), _DOC_RULES, "text", ("doc_id",), any_language=True)
    return rules.deductions(found).select("security", "naming")


@query(rf"""
WITH {_SQL_LINES}, p AS (SELECT DISTINCT doc_id, line, x.n AS pattern FROM lines, (VALUES ('license', '(?i)license'), ('address', '@[a-z0-9]+\.'), ('table', ' \| ')) x(n, r) WHERE regexp_matches(text, x.r))
SELECT pattern, count(*) AS n, CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS severity FROM p GROUP BY pattern""")
def patterns_grouped(spark, sf_dir):
    table = (("license", "(?i)license"), ("address", r"@[a-z0-9]+\."), ("table", r" \| "))
    found = rules.patterns(_t(spark, sf_dir, "documents"), "text", ("doc_id",), table)
    return rules.pattern_summary(found.where("pattern <> 'config-object'"))


@query(f"""
WITH {_SQL_LINES}, t AS (SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM lines)
SELECT name FROM t GROUP BY name HAVING count(*) = 1""")
def unused_tokens(spark, sf_dir):
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), 0)))
    return _lines(spark, sf_dir).select("doc_id", "line", words.alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")


# --- clones

@query("""
WITH g AS (SELECT md5(regexp_replace(text, '\\s+', '', 'g')) AS hash, doc_id FROM documents)
SELECT hash, count(*) AS members, min(doc_id) AS first FROM g GROUP BY hash HAVING count(*) > 1""".replace("\\\\", "\\"))
def clones_exact(spark, sf_dir):
    marked = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace("text", r"[ \t\n\r\f]+", "")).alias("hash"))
    return marked.groupBy("hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("first")).where("members > 1")


@query(r"""
WITH n AS (SELECT doc_id, md5(text) AS raw, md5(trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^a-z#]+', ' ', 'g'))) AS hash FROM documents),
f AS (SELECT hash, count(*) AS files, count(DISTINCT raw) AS variants, min(doc_id) AS first FROM n GROUP BY hash) SELECT * FROM f WHERE files >= 2 AND variants > 1""")
def clones_normalized(spark, sf_dir):
    shape = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "#"), "[^a-z#]+", " "))
    marked = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("raw"), F.md5(shape).alias("hash"))
    per = marked.groupBy("hash", "raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return per.groupBy("hash").agg(F.sum("n").alias("files"), F.count("*").alias("variants"), F.min("first").alias("first")).where("files >= 2 and variants > 1")


@query(r"""
WITH d AS (SELECT min(doc_id) AS id, lower(text) AS t FROM documents GROUP BY md5(text), lower(text)), u AS (SELECT min(doc_id) AS id, any_value(text) AS text FROM documents GROUP BY md5(text)),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[^\s]+')) AS t FROM u), n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM w a JOIN w b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT p.a, p.b, k / (x.n + y.n - k) AS jaccard FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE k / (x.n + y.n - k) >= 0.8""")
def clones_jaccard(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return clones.similar_pairs(clones.token_sets(docs, "text", "doc_id"), 0.8, rows=docs.count())


@query()
def clones_advanced(spark, sf_dir):
    return clones.approximate(_t(spark, sf_dir, "documents"), "text", "doc_id")


@query("""
WITH g AS (SELECT md5(text) AS hash, source, count(*) AS n FROM documents WHERE len(string_split(trim(text, ' '), chr(10))) >= 3 GROUP BY ALL)
SELECT hash, CAST(sum(n) AS BIGINT) AS members, count(*) AS files, CAST(sum(n) - 1 AS BIGINT) AS extra FROM g GROUP BY hash HAVING count(*) >= 2""")
def dup_cross_source(spark, sf_dir):
    frags = _t(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("text").alias("code"))
    return clones.duplicated_fragments(frags)


# --- score

def _measured_counts(spark, sf_dir) -> DataFrame:
    """The counts of the dimension from the table: names that one line alone has are dead, texts that others repeat duplicated."""
    docs = _t(spark, sf_dir, "documents")
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), 0)))
    names = _lines(spark, sf_dir).select(words.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    copies = clones.duplicated_fragments(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("code")))
    return (
        _score_counts(spark, sf_dir).drop("dead", "symbols", "duplicated")
        .crossJoin(names.agg(F.count_if(F.col("n") == 1).alias("dead"), F.count("*").alias("symbols")))
        .crossJoin(copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicated")))
    )


def _score_counts(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").agg(F.count_if(F.col("n_chars") > 5000).alias("large"), F.count("*").alias("files"), F.count_if(F.col("text").contains("!!")).alias("patterns")).withColumns(
        {"dead": F.lit(10), "symbols": F.lit(100), "duplicated": F.lit(73)}
    )


@query(rf"""
WITH c AS (SELECT count(*) FILTER (n_chars > 5000) AS large, count(*) AS files, count(*) FILTER (contains(text, '!!')) AS patterns FROM documents),
p AS (SELECT least(10 / 100, 1.0::DOUBLE) * 100 AS dead_code, least(large / files, 1.0::DOUBLE) * 100 AS large_files, least(73 / files, 1.0::DOUBLE) * 100 AS duplication, least(patterns / files, 1.0::DOUBLE) * 100 AS pattern FROM c)
SELECT *, floor((dead_code * 0.35::DOUBLE + large_files * 0.2::DOUBLE + duplication * 0.2::DOUBLE + pattern * 0.25::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM p""")
def score_dimensions(spark, sf_dir):
    return score.maintainability_dimension(_score_counts(spark, sf_dir))


_SQL_MEASURED = f"""{_SQL_LINES}, w AS (SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM lines), n AS (SELECT name, count(*) AS n FROM w GROUP BY name),
k AS (SELECT count(*) FILTER (n = 1) AS dead, count(*) AS symbols FROM n),
g AS (SELECT md5(trim(text, ' ')) AS hash, count(*) AS members, count(DISTINCT doc_id) AS files FROM documents WHERE len(string_split(trim(text, ' '), chr(10))) >= 3 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2),
y AS (SELECT coalesce(sum(members - 1), 0) AS duplicated FROM g), c AS (SELECT count(*) FILTER (n_chars > 5000) AS large, count(*) AS files, count(*) FILTER (contains(text, '!!')) AS patterns FROM documents),
p AS (SELECT least(dead / symbols, 1.0::DOUBLE) * 100 AS dead_code, least(large / files, 1.0::DOUBLE) * 100 AS large_files, least(duplicated / files, 1.0::DOUBLE) * 100 AS duplication, least(patterns / files, 1.0::DOUBLE) * 100 AS pattern FROM k, y, c)"""


@query(f"""
WITH {_SQL_MEASURED}
SELECT *, floor((dead_code * 0.35::DOUBLE + large_files * 0.2::DOUBLE + duplication * 0.2::DOUBLE + pattern * 0.25::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM p""")
def score_dimensions_measured(spark, sf_dir):
    """As score_dimensions, whose SQL has literals for three of the counts, with all counts taken from the table."""
    return score.maintainability_dimension(_measured_counts(spark, sf_dir))


@query("""
SELECT source, floor(avg(n_chars) / 50 * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS total,
  CASE WHEN floor(avg(n_chars) / 50 * 100 + 0.5::DOUBLE) / 100.0::DOUBLE >= 85 THEN 'F' WHEN floor(avg(n_chars) / 50 * 100 + 0.5::DOUBLE) / 100.0::DOUBLE >= 70 THEN 'D' WHEN floor(avg(n_chars) / 50 * 100 + 0.5::DOUBLE) / 100.0::DOUBLE >= 50 THEN 'C'
    WHEN floor(avg(n_chars) / 50 * 100 + 0.5::DOUBLE) / 100.0::DOUBLE >= 30 THEN 'B' ELSE 'A' END AS grade FROM documents GROUP BY source""")
def score_total_grade(spark, sf_dir):
    total = _t(spark, sf_dir, "documents").groupBy("source").agg(s.round2(F.avg("n_chars") / 50).alias("total"))
    return total.withColumn("grade", score.grade(F.col("total")))


@query(f"""
WITH {_SQL_MEASURED}, b AS (SELECT 'dead_code' AS breakdown, dead_code AS v, 30 AS t, 1 AS priority, 'remove code that nothing uses' AS advice FROM p UNION ALL SELECT 'large_files', large_files, 30, 2, 'split large files' FROM p
  UNION ALL SELECT 'duplication', duplication, 30, 1, 'extract what is duplicated' FROM p UNION ALL SELECT 'pattern', pattern, 20, 3, 'unify repeated patterns' FROM p)
SELECT breakdown, CAST(greatest(1, priority - CASE WHEN v > 50 THEN 1 ELSE 0 END) AS INTEGER) AS priority, CAST(floor(v * 0.3::DOUBLE * 0.3::DOUBLE + 0.5) AS INTEGER) AS impact, advice FROM b WHERE v > t""")
def recommendations(spark, sf_dir):
    row = score.maintainability_dimension(_measured_counts(spark, sf_dir))
    return score.recommendations(row.unpivot([], ["dead_code", "large_files", "duplication", "pattern"], "breakdown", "value"))


@query("""
SELECT doc_id, type, score FROM (SELECT doc_id, 'large' AS type, 70 AS score FROM documents WHERE n_chars > 20000 UNION ALL SELECT doc_id, 'license', 75 FROM documents WHERE contains(lower(text), 'license')) ORDER BY score DESC, type, doc_id LIMIT 20""")
def top_issues(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    large = docs.where("n_chars > 20000").select("doc_id", F.lit("large").alias("type"), F.lit(70).alias("score"))
    licensed = docs.where(F.lower("text").contains("license")).select("doc_id", F.lit("license").alias("type"), F.lit(75).alias("score"))
    return score.top_issues(large.unionByName(licensed), 20, "doc_id")


# --- snapshots

@query("SELECT source || '/' || lang || '/' || doc_id AS path, substr(sha256(text), 1, 16) AS hash, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM documents")
def snapshot_hashes(spark, sf_dir):
    return snapshot.file_hashes(documents_as_files(_t(spark, sf_dir, "documents")))


@query("SELECT sha256(string_agg(r_name || ':' || substr(sha256(r_name), 1, 16), '|' ORDER BY r_name)) AS project_hash FROM region")
def snapshot_project_hash(spark, sf_dir):
    regions = _t(spark, sf_dir, "region").select(F.col("r_name").alias("path"), snapshot.file_hash(F.col("r_name")).alias("hash"))
    return snapshot.flat_project_hash(regions)


@query()
def snapshot_project_hash_documents(spark, sf_dir):
    return snapshot.project_hash(snapshot.file_hashes(documents_as_files(_t(spark, sf_dir, "documents"))))


@query("SELECT source || '/' || lang AS dir, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY ALL")
def snapshot_structure(spark, sf_dir):
    return snapshot.structure(documents_as_files(_t(spark, sf_dir, "documents"))).select("dir", "files", "lines")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _t(spark, sf_dir, "documents")
    h = lambda c: snapshot.file_hash(c).alias("hash")
    lines = F.size(F.split("text", "\n")).alias("lines")
    old = docs.where("lang <> 'es'").select(F.col("doc_id").alias("path"), h(F.col("text")), lines)
    new = docs.where("lang <> 'de'").select(F.col("doc_id").alias("path"), h(F.regexp_replace("text", "license", "LICENSE")), lines)
    return old, new


_SQL_VERSIONS = """a AS (SELECT doc_id AS path, substr(sha256(text), 1, 16) AS hash FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id AS path, substr(sha256(replace(text, 'license', 'LICENSE')), 1, 16) AS hash FROM documents WHERE lang <> 'de')"""


@query(f"""
WITH {_SQL_VERSIONS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""")
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(*_versions(spark, sf_dir)).select("path", "change")


@query(f"WITH {_SQL_VERSIONS} SELECT path, hash FROM b")
def apply_changes(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return snapshot.apply_diff(old, new, snapshot.diff(old, new)).select("path", "hash")


@query(r"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?s)/\*.*?\*/', '', 'g'), '(^|[^:])//[^\n]*', '\1', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS compressed FROM pages""")
def compress_medium(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", snapshot.compress_medium(F.col("html")).alias("compressed"))


@query("SELECT lang, CAST(sum(ceil(len(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(snapshot.token_estimate(F.col("text"))).alias("tokens"))


# --- rewrites

@query(f"""
WITH {_SQL_LINES}, p AS (SELECT doc_id, line, string_split(regexp_replace(text, '\\bthe\\b', chr(1) || 'the', 'g'), chr(1)) AS p FROM lines WHERE contains(text, 'the'))
SELECT doc_id, line AS start_line, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + 1 AS INTEGER) AS start_col, 'the' AS old_text, 'der' AS new_text
FROM (SELECT *, unnest(range(1, len(p))) AS i FROM p)""")
def rename_edits(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return rewrite.rename_edits(files, "the", "der").select(F.col("path").alias("doc_id"), "start_line", "start_col", "old_text", "new_text")


@query(r"SELECT doc_id, md5(regexp_replace(text, '\bthe\b', 'der', 'g')) AS hash FROM documents")
def rename_apply(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return rewrite.rename(files, "the", "der").select("doc_id", F.md5("content").alias("hash"))


@query(r"SELECT doc_id::VARCHAR AS doc_id, md5(regexp_replace(text, '\bthe\b', 'der', 'g')) AS hash FROM documents")
def rename_by_edits(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return rewrite.apply_edits(files, rewrite.rename_edits(files, "the", "der")).select(F.col("path").alias("doc_id"), F.md5("content").alias("hash"))


@query("""
SELECT a.n_nationkey AS a, CASE WHEN a.n_regionkey = b.n_regionkey THEN './' || b.n_name ELSE '../r' || b.n_regionkey || '/' || b.n_name END AS specifier, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey""")
def move_specifiers(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("/src/r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", F.lit(".ts")).alias("path"))
    a, b = n.toDF("a", "pa"), n.toDF("b", "pb")
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", rewrite.import_path(F.col("pa"), F.col("pb")).alias("specifier"))


# --- streams

def _events(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_SQL_GAPS = """g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM events))"""


@query(f"""
WITH {_SQL_GAPS.format(gap="'1 hour'")} SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(min(ts)) AS started, max_by(event_type, (ts, event_type)) AS change FROM g GROUP BY user_id, k""")
def events_debounced(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_type").alias("change"))
    return changes.debounced(e, "1 hour").select("path", F.unix_micros("started").alias("started"), "change")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return changes.tumbling(_events(spark, sf_dir), "1 day", "event_type").select(F.unix_micros("started").alias("started"), "event_type", "n")


@query(f"WITH {_SQL_GAPS.format(gap=chr(39) + '30 minutes' + chr(39))} SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM g GROUP BY user_id, k")
def events_sessions(spark, sf_dir):
    return changes.sessions(_events(spark, sf_dir), "user_id").select("user_id", F.unix_micros("started").alias("started"), "n")


@query("SELECT event_type, count(*) AS n, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean, epoch_us(max(ts)) AS last_ts FROM events GROUP BY event_type")
def event_type_stats(spark, sf_dir):
    got = changes.type_stats(_events(spark, sf_dir), "event_type", "value")
    return got.select("event_type", "n", (F.floor(F.col("mean") * 1e6 + 0.5) / 1e6).alias("mean"), F.unix_micros("last_ts").alias("last_ts"))


@query("SELECT user_id, event_id, CAST(r AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def history_capped(spark, sf_dir):
    return changes.capped_history(_events(spark, sf_dir), "user_id", 10).select("user_id", "event_id", "recency")


@query("""
WITH t AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS at FROM events) SELECT user_id, event_id FROM events, t WHERE ts <= t.at QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def history_asof(spark, sf_dir):
    e = _events(spark, sf_dir)
    at = e.agg(F.timestamp_micros(F.expr("(unix_micros(min(ts)) + unix_micros(max(ts))) div 2")).alias("at")).first()["at"]
    return changes.as_of(e, "user_id", at).select("user_id", "event_id")


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type <> 'click') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM events GROUP BY user_id)
SELECT user_id, hits / (hits + misses) * 40 + greatest(0.0::DOUBLE, 30 - 30 * (hits * 1000 / 52428800.0::DOUBLE)) + greatest(0.0::DOUBLE, 20 - least(misses / 10, 20.0::DOUBLE)) + greatest(0.0::DOUBLE, 10 - 100 * (0 / (hits + misses))) AS health FROM c""")
def cache_health(spark, sf_dir):
    c = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") != "click").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return c.select("user_id", changes.cache_health(F.col("hits"), F.col("misses"), F.col("hits") * 1000, F.col("misses"), F.lit(0)).alias("health"))


# --- scalars

@query(f"""
WITH {_SQL_LINKS} SELECT DISTINCT page_id, '/' || array_to_string(list_filter(string_split('/x/./' || regexp_replace(href, '^[a-z]+://', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM k""")
def path_normalize(spark, sf_dir):
    href = F.regexp_replace("href", "^[a-z]+://", "")
    return _links(spark, sf_dir).select("page_id", s.normalize_path(F.concat(F.lit("/x/./"), href)).alias("path")).distinct()


@query("""
SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS snake, lower(replace(p_name, ' ', '-')) AS kebab, upper(p_name[1]) || substr(p_name, 2) AS capital FROM part""")
def case_convert(spark, sf_dir):
    n = F.col("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", s.snake_case(n).alias("snake"), s.kebab_case(n).alias("kebab"), s.capitalize(n).alias("capital"))


@query("SELECT c_custkey, CASE WHEN len(c_name) > 12 THEN substr(c_name, 1, 12) || '...' ELSE c_name END AS short, lpad(c_mktsegment, 14, '.-') AS padded FROM customer")
def pad_truncate(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", s.truncate(F.col("c_name"), 12).alias("short"), F.lpad("c_mktsegment", 14, ".-").alias("padded"))


@query("SELECT event_id, floor(value * 0.285::DOUBLE * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS rounded FROM events")
def round_half_up(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", s.round2(F.col("value") * F.lit(0.285)).alias("rounded"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import code_queries  # noqa: E402,F401  registers its queries
