"""Language packs: what a language's declarations and imports look like, and the symbols read by them.

A pack is a table of patterns, not a parser; comments and strings are blanked
first.  A real parser can be put in its place with `mapInPandas` and the same
schemas.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as s

_TS_MOD = r"(?:(?:export|default|declare|abstract|public|private|protected|static|readonly|async|override)\s+)*"
_SWIFT_MOD = r"(?:(?:public|private|fileprivate|internal|open|static|final|override|lazy|weak|mutating|class)\s+)*"


@dataclass(frozen=True)
class LanguagePack:
    """Extensions, declarations as (type, pattern with the name as last group) and import patterns as (kind, pattern)."""

    name: str
    version: str
    extensions: tuple[str, ...]
    languages: tuple[str, ...]
    declarations: tuple[tuple[str, str], ...]
    imports: tuple[tuple[str, str], ...]
    tests: str
    excludes: tuple[str, ...] = ("**/node_modules/**", "**/dist/**")
    modifiers: tuple[str, ...] = field(default=())


_TS_DECLARATIONS = (
    ("class", rf"^\s*({_TS_MOD})class\s+([A-Za-z_$][\w$]*)"),
    ("interface", rf"^\s*({_TS_MOD})interface\s+([A-Za-z_$][\w$]*)"),
    ("type", rf"^\s*({_TS_MOD})type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="),
    ("enum", rf"^\s*({_TS_MOD})(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("namespace", rf"^\s*({_TS_MOD})namespace\s+([A-Za-z_$][\w$.]*)"),
    ("module", rf"^\s*({_TS_MOD})module\s+['\"]?([\w$./-]+)"),
    ("function", rf"^\s*({_TS_MOD})function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("constant", rf"^\s*({_TS_MOD})const\s+([A-Za-z_$][\w$]*)(?!\s*enum)"),
    ("variable", rf"^\s*({_TS_MOD})(?:let|var)\s+([A-Za-z_$][\w$]*)"),
    ("function", rf"^\s+({_TS_MOD})(?!(?:if|for|while|switch|catch|return|function|constructor)\b)([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::[^={{]+)?\{{\s*$"),
    ("property", rf"^\s+({_TS_MOD})([A-Za-z_$][\w$]*)[?!]?\s*:\s*[^=,(]+(?:=.*)?;\s*$"),
)
_SWIFT_DECLARATIONS = (
    ("class", rf"^\s*({_SWIFT_MOD})class\s+([A-Za-z_]\w*)\b(?!\s+(?:func|var|let))"),
    ("struct", rf"^\s*({_SWIFT_MOD})struct\s+([A-Za-z_]\w*)"),
    ("protocol", rf"^\s*({_SWIFT_MOD})protocol\s+([A-Za-z_]\w*)"),
    ("enum", rf"^\s*({_SWIFT_MOD})enum\s+([A-Za-z_]\w*)"),
    ("module", rf"^\s*({_SWIFT_MOD})extension\s+([A-Za-z_][\w.]*)"),
    ("type", rf"^\s*({_SWIFT_MOD})typealias\s+([A-Za-z_]\w*)"),
    ("function", rf"^\s*(?:@\w+\s+)*({_SWIFT_MOD})func\s+([A-Za-z_]\w*)"),
    ("constant", rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*({_SWIFT_MOD})let\s+([A-Za-z_]\w*)"),
    ("variable", rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*({_SWIFT_MOD})var\s+([A-Za-z_]\w*)"),
)
_JS_IMPORTS = (
    ("import", r"""\bimport\s+(?:type\s+)?(?:[\w$*{}\s,]+?\s+from\s+)?['"]([^'"]+)['"]"""),
    ("export", r"""\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]"""),
    ("require", r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("dynamic_import", r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
)
PACKS = (
    LanguagePack(
        "typescript", "1.0.0", (".ts", ".tsx"), ("typescript",), _TS_DECLARATIONS, (*_JS_IMPORTS, ("include", r"""///\s*<reference\s+(?:path|types)=['"]([^'"]+)['"]""")),
        r"(?:\.(?:test|spec)\.[jt]sx?$)|(?:^|/)__tests__/",
    ),
    LanguagePack("javascript", "1.0.0", (".js", ".jsx", ".mjs", ".cjs"), ("javascript",), _TS_DECLARATIONS, _JS_IMPORTS, r"(?:\.(?:test|spec)\.[jt]sx?$)|(?:^|/)__tests__/"),
    LanguagePack("swift", "1.0.0", (".swift",), ("swift",), _SWIFT_DECLARATIONS, (("import", r"^\s*(?:@testable\s+)?import\s+(?:class\s+|struct\s+|func\s+)?(\w+)"),), r"(?:Tests?\.swift$)|(?:^|/)Tests/"),
)
# Swift protocols that are never superclasses.
SWIFT_PROTOCOLS = (
    "ObservableObject", "Identifiable", "Codable", "Equatable", "Hashable", "Comparable", "CustomStringConvertible", "Decodable", "Encodable", "Error", "CaseIterable",
)


# Kinds of declarations that count as abstract.
ABSTRACT = ("class", "interface", "type", "enum", "function", "module", "namespace")


def is_abstract_declaration(kind: Column) -> Column:
    return kind.isin(*ABSTRACT)


# Parts of specifiers of development tools.
DEVELOPMENT = ("@types/", "jest", "vitest", "eslint", "prettier", "webpack", "rollup", "vite", "typescript")


def dependency_category(specifier: Column, type_only: Column) -> Column:
    """type for imports of types alone, dev for development tools, runtime for others."""
    tool = F.lit(False)
    for name in DEVELOPMENT:
        tool |= specifier.contains(name)
    return F.when(F.coalesce(type_only, F.lit(False)), "type").when(tool, "dev").otherwise("runtime")


def clean_specifier(specifier: Column) -> Column:
    """Without a query and fragment, with forward slashes."""
    return F.translate(F.regexp_replace(specifier, r"[?#].*$", ""), "\\", "/")


def packs_table(spark: SparkSession, packs: tuple[LanguagePack, ...] = PACKS) -> DataFrame:
    return spark.createDataFrame(
        [(p.name, p.version, list(p.extensions), list(p.languages), i) for i, p in enumerate(packs)],
        "name string, version string, extensions array<string>, languages array<string>, priority int",
    )


def is_test_file(path: Column, packs: tuple[LanguagePack, ...] = PACKS) -> Column:
    return path.rlike("|".join(dict.fromkeys(f"(?:{p.tests})" for p in packs)))


def blank_comments(text: Column) -> Column:
    """The text without comments; block comments leave their line breaks, so line numbers stay."""
    blocks = F.regexp_replace(text, r"(?<![:'\"\w])//(?!/\s*<reference)[^\n]*", "")
    # a block comment becomes as many line breaks as it has
    parts = F.split(blocks, r"/\*")
    return F.array_join(
        F.concat(
            F.slice(parts, 1, 1),
            F.transform(
                F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
                lambda p: F.when(
                    p.contains("*/"), F.concat(F.regexp_replace(F.regexp_extract(p, r"(?s)^(.*?)\*/", 1), r"[^\n]", ""), F.regexp_replace(p, r"(?s)^.*?\*/", ""))
                ).otherwise(F.regexp_replace(p, r"[^\n]", "")),
            ),
        ),
        "",
    )


def symbols(files: DataFrame, packs: tuple[LanguagePack, ...] = PACKS) -> DataFrame:
    """SYMBOLS of FILES by line patterns; scope is the enclosing declaration by brace depth.

    One row for each declaration; the first pattern of a pack that fits a line wins.
    """
    lines = files.select(
        "path", "language", F.posexplode(F.split(blank_comments(F.col("content")), "\n")).alias("at", "text")
    )
    found = F.lit(None).cast("struct<type:string,modifiers:string,name:string>")
    for pack in packs:
        own = F.lit(None).cast("struct<type:string,modifiers:string,name:string>")
        for kind, pattern in reversed(pack.declarations):
            own = F.when(
                F.col("text").rlike(pattern),
                F.struct(F.lit(kind).alias("type"), F.regexp_extract("text", pattern, 1).alias("modifiers"), F.regexp_extract("text", pattern, 2).alias("name")),
            ).otherwise(own)
        found = F.when(F.col("language").isin(*pack.languages), own).otherwise(found)
    code = F.regexp_replace("text", r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`""", "")
    opens, closes = F.regexp_count(code, F.lit(r"\{")), F.regexp_count(code, F.lit(r"\}"))
    upto = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("d", found).withColumn("depth", F.coalesce(F.sum(opens - closes).over(upto), F.lit(0))).withColumn("opens", opens)
    # the last declaration at each depth above
    whole = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    scopes = [
        F.last(F.when((F.col("depth") == k) & F.col("d").isNotNull(), F.struct(F.col("d.type").alias("type"), F.col("d.name").alias("name"))), ignorenulls=True).over(whole)
        for k in range(3)
    ]
    scope = F.filter(F.array(*[F.when(F.col("depth") > k, sc) for k, sc in enumerate(scopes)]), lambda x: x.isNotNull())
    heritage = F.when(F.col("language") == "swift", F.regexp_extract("text", r":\s*([\w\s,.<>]+?)\s*\{", 1)).otherwise("")
    parents = F.filter(F.transform(F.split(heritage, ","), lambda x: F.trim(x)), lambda x: x != "")
    is_protocol = lambda x: x.isin(*SWIFT_PROTOCOLS) | x.endswith("Protocol")
    extends = F.nullif(F.regexp_extract("text", r"\bextends\s+([\w$.]+)", 1), F.lit(""))
    implements = F.filter(F.transform(F.split(F.regexp_extract("text", r"\bimplements\s+([\w$.,\s<>]+?)\s*\{", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    swift = F.col("language") == "swift"
    # only the first parent of a class can be its superclass
    above = swift & (F.col("d.type") == "class") & (F.size(parents) > 0) & ~F.coalesce(is_protocol(F.get(parents, 0)), F.lit(True))
    return (
        lines.withColumn("scope", scope).where("d is not null and d.name <> ''")
        .select(
            "path", F.col("d.name").alias("name"), F.col("d.type").alias("type"), (F.col("at") + 1).alias("start_line"),
            F.expr("cast(position(d.name, text) as int)").alias("start_col"), (F.col("at") + 1).alias("end_line"),
            F.expr("cast(position(d.name, text) + length(d.name) as int)").alias("end_col"), "scope",
            F.filter(F.split("d.modifiers", r"\s+"), lambda x: x != "").alias("modifiers"),
            F.transform(F.regexp_extract_all("text", F.lit(r"@(\w+)"), 1), lambda x: F.concat(F.lit("@"), x)).alias("attributes"),
            F.when(above, F.get(parents, 0)).when(~swift, extends).alias("superclass"),
            F.when(above, F.slice(parents, F.lit(2), F.greatest(F.size(parents) - 1, F.lit(0)))).when(swift, parents).otherwise(implements).alias("implements"),
        )
        .dropDuplicates(["path", "name", "type", "start_line"])
    )


def imports(files: DataFrame, packs: tuple[LanguagePack, ...] = PACKS, text: str = "content") -> DataFrame:
    """IMPORTS of FILES: every import, re-export, require, dynamic import and reference, by line."""
    lines = files.select("path", "language", F.posexplode(F.split(blank_comments(F.col(text)), "\n")).alias("at", "text"))
    found = None
    for pack in packs:
        for kind, pattern in pack.imports:
            got = lines.where(F.col("language").isin(*pack.languages)).where(F.col("text").rlike(pattern)).select(
                "path", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("specifier"), F.lit(kind).alias("kind"), "text"
            )
            found = got if found is None else found.unionByName(got)
    names = F.filter(
        F.transform(F.split(F.regexp_extract("text", r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_extract(F.trim(x), r"^(?:type\s+)?([\w$]+)", 1)), lambda x: x != ""
    )
    return found.select("path", "line", "specifier", "kind", F.col("specifier").startswith(".").alias("is_relative"), names.alias("imported"))


def references(files: DataFrame, name: str, content: str = "content") -> DataFrame:
    """REFS of one name: whole-word hits; those after // or in an open /* on the line are comments."""
    from .lines import to_lines
    from .textsearch import Query, matches

    hits = matches(to_lines(files, content), Query(name, case_sensitive=True, whole_word=True))
    before = F.expr("substring(text, 1, column - 1)")
    opened = F.length(before) - F.length(F.replace(before, F.lit("/*"), F.lit(""))) > F.length(before) - F.length(F.replace(before, F.lit("*/"), F.lit("")))
    declared = before.rlike(r"\b(?:class|interface|type|enum|function|func|const|let|var|struct|protocol)\s+$")
    kind = F.when(before.contains("//") | opened, "comment").when(declared, "definition").otherwise("usage")
    return hits.select("path", F.lit(name).alias("name"), "line", F.col("column").alias("col"), kind.alias("kind"))


def identifiers(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line, name): distinct words of every line, an inverted index of identifiers."""
    from .lines import to_lines

    return to_lines(files, content).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][\w$]*"), 0))).alias("name"))


def marked_unused(declared: DataFrame, words: DataFrame) -> DataFrame:
    """SYMBOLS with `unused`: whether they appear on no other line than their own and are not exported, public or protected.

    Lines of a name are counted, up to those of one more than is declared, so a
    very common name is a number like others and joins no rows with rows.
    """
    open_ = F.exists("modifiers", lambda m: m.isin("export", "public", "protected", "open"))
    lines = words.select(F.col("name").alias("n"), F.col("path").alias("p"), F.col("line").alias("l")).distinct()
    seen = lines.groupBy("n").agg(F.count("*").alias("_lines"))
    here = lines.withColumnsRenamed({"n": "name", "p": "path", "l": "start_line"}).withColumn("_here", F.lit(1))
    joined = declared.join(seen, declared.name == seen.n, "left").join(here, ["name", "path", "start_line"], "left")
    alone = F.coalesce("_lines", F.lit(0)) == F.coalesce("_here", F.lit(0))
    own = [declared[c] if c not in ("name", "path", "start_line") else F.col(c) for c in declared.columns]
    return joined.select(*own, (alone & ~F.coalesce(open_, F.lit(False))).alias("unused"))


def unused(declared: DataFrame, words: DataFrame) -> DataFrame:
    """SYMBOLS that appear on no other line than their own; exported, public and protected ones are left out."""
    return marked_unused(declared, words).where("unused").drop("unused").withColumn("confidence", F.when(F.array_contains("modifiers", "private"), 1.0).otherwise(0.95))


def innermost(ranges: DataFrame, line: int, column: int) -> DataFrame:
    """The smallest of `ranges` (path, start_line, start_col, end_line, end_col) of each path that holds a position."""
    at = F.struct(F.lit(line).alias("a"), F.lit(column).alias("b"))
    point = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    inside = ranges.where((point("start_line", "start_col") <= at) & (at <= point("end_line", "end_col")))
    order = W.partitionBy("path").orderBy(F.desc("start_line"), F.desc("start_col"), "end_line", "end_col")
    return inside.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def shadowed(declared: DataFrame) -> DataFrame:
    """Pairs (name, path, outer_line, inner_line) where a name is declared again in a scope below."""
    a = declared.select("path", "name", F.col("scope").alias("outer"), F.col("start_line").alias("outer_line"))
    b = declared.select("path", "name", F.col("scope").alias("inner"), F.col("start_line").alias("inner_line"))
    return a.join(b, ["path", "name"]).where((F.size("inner") > F.size("outer")) & s.within_scope(F.col("inner"), F.col("outer"))).select(
        "name", "path", "outer_line", "inner_line"
    )
