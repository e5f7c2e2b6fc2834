"""Rule tables and the issues they find.

Rules are data: a pattern, what it means and how bad it is.  All rules of a
table are applied to a line in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from .lines import to_lines


@dataclass(frozen=True)
class Rule:
    """`unless` is a pattern that clears the line; `languages` () means all."""

    category: str
    type: str
    severity: str
    pattern: str
    message: str
    unless: str = ""
    languages: tuple[str, ...] = ()
    weight: float = 1.0


_TS = ("typescript",)
_JS = ("typescript", "javascript")
_SWIFT = ("swift",)
RULES = (
    Rule("type-safety", "any-type", "warning", r":\s*any(?![A-Za-z0-9_])", "declared as any", languages=_TS),
    Rule("type-safety", "ts-ignore", "warning", r"@ts-ignore", "type check switched off", languages=_TS),
    Rule("type-safety", "as-any", "error", r"(?<![A-Za-z0-9_])as\s+any(?![A-Za-z0-9_])|<any>", "cast to any", languages=_TS),
    Rule("error-handling", "empty-catch", "high", r"catch\s*(?:\([^)]*\))?\s*\{\s*\}", "error swallowed", languages=_JS, weight=3),
    Rule("error-handling", "silent-catch", "medium", r"(?i)catch\s*(?:\([^)]*\))?\s*\{\s*//.*(?:ignore|skip|todo)", "error ignored", languages=_JS, weight=2),
    Rule("security", "hardcoded-secret", "critical", r"""(?i)(?:password|passwd|pwd|secret|api_?key|token)["']?\s*[:=]\s*["'`][^"'`]{3,}["'`]""", "secret in the source", unless=r"(?i)process\.env|config|import|require", weight=5),
    Rule("security", "eval", "high", r"(?<![A-Za-z0-9_.])eval\s*\(", "evaluates text as code", languages=_JS, weight=5),
    Rule("security", "inner-html", "medium", r"\.innerHTML\s*=", "writes markup", unless=r"(?i)sanitiz", languages=_JS, weight=3),
    Rule("naming", "underscore", "low", r"(?:\b(?:let|var|private|public|protected)\s+_\w+|^\s*_\w+\s*[:=])", "name begins with an underscore", languages=_JS),
    Rule("type-safety", "force-cast", "error", r"(?<![A-Za-z0-9_])as!", "forced cast", languages=_SWIFT, weight=3),
    Rule("type-safety", "force-unwrap", "warning", r"(?<=[A-Za-z0-9_)\]])(?<!\btry)(?<!\bas)!(?!=)", "forced unwrap", unless=r"@IBOutlet", languages=_SWIFT, weight=2),
    Rule("type-safety", "any-type", "warning", r":\s*Any(?:Object)?(?![A-Za-z0-9_])", "declared as Any", languages=_SWIFT),
    Rule("error-handling", "force-try", "high", r"(?<![A-Za-z0-9_])try!", "errors crash", languages=_SWIFT, weight=3),
    Rule("error-handling", "empty-catch", "high", r"catch\s*\{\s*\}", "error swallowed", languages=_SWIFT, weight=3),
    Rule("security", "user-defaults", "medium", r"(?i)UserDefaults.*(?:password|token|secret)", "secret in plain storage", languages=_SWIFT, weight=4),
    Rule("security", "insecure-url", "medium", r"http://(?!localhost|127\.0\.0\.1)", "unencrypted address", languages=_SWIFT, weight=1),
    Rule("naming", "underscore", "low", r"\b(?:let|var)\s+_\w+", "name begins with an underscore", languages=_SWIFT),
)


def issues(files: DataFrame, rules: tuple[Rule, ...] = RULES, content: str = "content", keep: tuple[str, ...] = ("path",), any_language: bool = False) -> DataFrame:
    """ISSUES of FILES: one row for each rule and line that it fits, at its first column."""
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules if "(?i)" not in r.pattern)
    folded = "|".join(f"(?:{r.pattern})" for r in rules if "(?i)" in r.pattern).replace("(?i)", "")
    columns = keep if any_language else (*keep, "language")
    # files that no rule can fit are left before they become lines
    likely = F.lit(False)
    if any_rule:
        likely |= F.col(content).rlike(f"(?m){any_rule}")
    if folded:
        likely |= F.col(content).rlike(f"(?mi){folded}")
    lines = to_lines(files.where(likely), content, columns)
    t = F.col("text")
    found = []
    for r in rules:
        fits = t.rlike(r.pattern)
        if r.unless:
            fits &= ~t.rlike(r.unless)
        if r.languages and not any_language:
            fits &= F.col("language").isin(*r.languages)
        found.append(
            F.when(
                fits,
                F.struct(
                    F.regexp_instr(t, F.lit(r.pattern)).alias("column"), F.lit(r.category).alias("category"), F.lit(r.type).alias("type"),
                    F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(float(r.weight)).alias("weight"),
                ),
            )
        )
    return lines.select(*keep, "line", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("category", "severity").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def deductions(found: DataFrame, test_ratio: Column | None = None) -> DataFrame:
    """One row of scores from 100 down, by category, and their weighted sum."""
    n = lambda cond: F.count_if(cond)
    c, sev = F.col("category"), F.col("severity")
    floor0 = lambda x: F.greatest(F.lit(0), x)
    scores = found.agg(
        floor0(100 - 10 * n((c == "type-safety") & (sev == "error")) - 5 * n((c == "type-safety") & (sev != "error"))).alias("type_safety"),
        floor0(100 - 10 * n((c == "error-handling") & (sev == "high")) - 5 * n((c == "error-handling") & (sev != "high"))).alias("error_handling"),
        floor0(100 - 15 * n((c == "security") & (sev == "critical")) - 10 * n((c == "security") & (sev != "critical"))).alias("security"),
        floor0(100 - 3 * n(c == "naming")).alias("naming"),
    )
    tests = F.least(F.lit(100.0), (test_ratio if test_ratio is not None else F.lit(0.0)) * 200)
    return scores.withColumn("tests", tests).withColumn(
        "overall",
        s.round_half_up(F.col("type_safety") * 0.30 + F.col("error_handling") * 0.25 + F.col("security") * 0.20 + F.col("naming") * 0.15 + F.col("tests") * 0.10),
    )


# Code patterns by name, and the keywords that configuration objects hold.
PATTERNS = (
    ("try-catch", r"\btry\s*\{"),
    ("logger-init", r"(?i)(?:logger|log)\s*=\s*(?:new\s+\w*logger|\w*logger\w*\.\w+)\s*\("),
    ("constructor-injection", r"constructor\s*\([^)]*(?:private|public|protected|readonly)\s"),
    ("env-var", r"process\.env\.\w+"),
    ("singleton", r"static\s+(?:let|var|readonly)\s+(?:shared|instance)\b"),
    ("factory", r"\b(?:make|create)[A-Z]\w*\s*\("),
    ("state-wrapper", r"@(?:State|Binding|ObservedObject|StateObject|EnvironmentObject|Published)\b"),
    ("view-builder", r"@ViewBuilder\b"),
    ("async", r"\basync\b"),
)
# Words of which two and an opening brace make a configuration object.
CONFIG_WORDS = ("host", "port", "database", "uri", "url", "connection")


def patterns(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",), table: tuple[tuple[str, str], ...] = PATTERNS) -> DataFrame:
    """(path, line, pattern): one row for each pattern and line."""
    lines = to_lines(files, content, keep)
    t = F.col("text")
    words = F.aggregate(F.array(*[t.rlike(s.whole_word(w)).cast("int") for w in CONFIG_WORDS]), F.lit(0), lambda a, x: a + x)
    found = [F.when(t.rlike(p), n) for n, p in table] + [F.when(t.contains("{") & (words >= 2), "config-object")]
    return lines.select(*keep, "line", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("pattern")).distinct()


def pattern_summary(found: DataFrame) -> DataFrame:
    n = F.count("*")
    return found.groupBy("pattern").agg(n.alias("n"), F.when(n > 10, "high").when(n > 5, "medium").otherwise("low").alias("severity"))


def suggestions(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, suggestion, confidence) of design patterns, the most confident first within a file."""
    t = F.col(content)
    count = lambda p: F.regexp_count(t, F.lit(p))
    single = F.when(t.rlike(r"static\s+\w*instance"), 0.4).otherwise(0.0) + F.when(t.rlike(r"private\s+constructor"), 0.3).otherwise(0.0) + F.when(t.rlike(r"getInstance\s*\("), 0.3).otherwise(0.0)
    options = [
        ("singleton", single, single >= 0.5),
        ("factory", F.lit(0.7), count(r"new\s+[A-Z]\w*\s*\(") >= 3),
        ("observer", F.least(F.lit(0.8), count(r"\.(?:on|emit|addEventListener|subscribe)\s*\(") / 10), count(r"\.(?:on|emit|addEventListener|subscribe)\s*\(") >= 5),
        ("strategy", F.lit(0.6), (count(r"\bcase\b") >= 3) | (count(r"\belse\s+if\b") >= 3)),
        ("decorator", F.lit(0.5), count(r"\bextends\b") >= 2),
    ]
    found = F.array(*[F.when(ok, F.struct(F.lit(n).alias("suggestion"), c.cast("double").alias("confidence"))) for n, c, ok in options])
    return files.select("path", F.inline(F.filter(found, lambda x: x.isNotNull())))


def presence(files: DataFrame, content: str = "content") -> DataFrame:
    """One row: number of files with async code, and whether promises, interfaces, generics and enums occur at all."""
    t = F.col(content)
    return files.agg(
        F.count_if(t.rlike(r"\basync\b")).alias("async_files"), F.bool_or(t.contains("Promise")).alias("promises"), F.bool_or(t.rlike(r"\binterface\b")).alias("interfaces"),
        F.bool_or(t.rlike(r"<[A-Z]\w*>")).alias("generics"), F.bool_or(t.rlike(r"\benum\b")).alias("enums"),
    )


def file_name_style(path: Column) -> Column:
    """Whether a file's name is neither kebab-case, camelCase nor PascalCase."""
    return ~s.stem(path).rlike(r"^(?:[a-z0-9]+(?:[-.][a-z0-9]+)*|[a-zA-Z][a-zA-Z0-9]*)$")
