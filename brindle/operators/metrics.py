"""Complexity, Halstead and maintainability metrics, and smells, as expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as s

# Patterns of operators and operands.
MULTI_OPERATORS = r"===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|=>|\+=|-=|\*=|/="
SINGLE_OPERATORS = r"[+\-*/%=<>!&|^~?:]"
OPERANDS = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`"
BRANCH_WORDS = ("if", "else", "for", "while", "guard", "switch", "case")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def halstead(df: DataFrame, text: str = "content") -> DataFrame:
    """`df` with n1, n2 (distinct operators, operands), N1, N2 (all), volume, difficulty, effort, hours and bugs."""
    t = F.col(text)
    found = df.select("*", *[F.regexp_extract_all(t, F.lit(p), 0).alias(f"_{k}") for k, p in enumerate((MULTI_OPERATORS, SINGLE_OPERATORS, OPERANDS))])
    distinct = lambda c: F.size(F.array_distinct(c))
    # each list is made once and both counted and made distinct
    counts = found.select(
        *df.columns, (distinct("_0") + distinct("_1")).alias("h1"), distinct("_2").alias("h2"), (F.size("_0") + F.size("_1")).alias("t1"), F.size("_2").alias("t2")
    )
    volume = (F.col("t1") + F.col("t2")) * F.log2(F.greatest(F.lit(1), F.col("h1") + F.col("h2")).cast("double"))
    difficulty = (F.col("h1") / 2.0) * (F.col("t2") / F.greatest(F.lit(1), F.col("h2")))
    return (
        counts.withColumn("_v", volume).withColumn("_d", difficulty)
        .withColumn("volume", s.round2(F.col("_v"))).withColumn("difficulty", s.round2(F.col("_d")))
        .withColumn("effort", s.round2(F.col("_v") * F.col("_d"))).withColumn("seconds", s.round2(F.col("_v") * F.col("_d") / 18)).withColumn("bugs", s.round2(F.col("_v") / 3000))
        .drop("_v", "_d")
    )


def lines_of_code(text: Column) -> Column:
    """Non-blank lines."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))


def maintainability_index(volume: Column, complexity: Column, loc: Column) -> Column:
    """171 less what volume, complexity and length take, 0 at least; not rounded."""
    one = F.lit(1.0)
    return F.greatest(F.lit(0.0), 171 - 5.2 * F.log(F.greatest(one, volume)) - 0.23 * complexity - 16.2 * F.log(F.greatest(one, loc.cast("double"))))


def maintainability(volume: Column, complexity: Column, loc: Column) -> Column:
    return s.round2(maintainability_index(volume, complexity, loc))


def grade(index: Column) -> Column:
    return F.when(index >= 85, "A").when(index >= 70, "B").when(index >= 50, "C").when(index >= 25, "D").otherwise("F")


def code_metrics(df: DataFrame, text: str = "content") -> DataFrame:
    """`df` with methods, fields, params, cyclomatic and loc, counted by patterns."""
    t = F.col(text)
    lists = F.regexp_extract_all(t, F.lit(r"\(([^)\n]*)\)"), 1)
    sizes = F.transform(lists, lambda x: F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(x, ","))))
    mean = s.ratio(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), F.size(sizes))
    branches = _count(t, s.whole_word("if|for|while|case|catch")) + _count(t, s.whole_word(r"else\s+if")) + _count(t, r"&&|\|\|") + _count(t, r"\?[^.?:\n]*:")
    return df.select(
        "*", (_count(t, s.whole_word("function")) + _count(t, r"=>")).alias("methods"), _count(t, r"(?m)^\s*(?:public|private|protected|readonly|static|let|const|var)\s+\w+\s*[:=;]").alias("fields"),
        s.round_half_up(mean).cast("int").alias("params"), (branches + 1).alias("cyclomatic"), lines_of_code(t).alias("loc"),
    )


def cyclomatic_words(text: Column) -> Column:
    """1, and one for every branching word and operator."""
    return _count(text, s.whole_word("|".join(BRANCH_WORDS))) + _count(text, r"&&|\|\||\?") + 1


def cognitive_from(cyclomatic: Column) -> Column:
    return F.floor(cyclomatic * F.lit(1.2)).cast("long")


def evaluation(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 5, "simple").when(cyclomatic <= 10, "moderate").when(cyclomatic <= 20, "complex").otherwise("very-complex")


def nesting(lines: DataFrame, key: str = "path", text: str = "text", opens: str = r"\{", closes: str = r"\}") -> DataFrame:
    """`lines` with depth: openings less closings of all lines before."""
    order = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("depth", F.coalesce(F.sum(_count(F.col(text), opens) - _count(F.col(text), closes)).over(order), F.lit(0)))


def cognitive(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, cognitive): every branching line counts 1 and its depth, logical operators and ternaries 1."""
    deep = nesting(lines, key)
    branch = F.col("text").rlike(s.whole_word("if|for|while|switch|catch"))
    flat = _count(F.col("text"), r"&&|\|\|") + _count(F.col("text"), r"\?[^.?:\n]*:")
    return deep.groupBy(key).agg(F.sum(F.when(branch, 1 + F.greatest(F.col("depth"), F.lit(0))).otherwise(0) + flat).alias("cognitive"))


def roll_up(functions: DataFrame, key: str = "path", name: str = "name") -> DataFrame:
    """Per file: sums, mean, maximum and the name of the most complex function, with its evaluation."""
    return functions.groupBy(key).agg(
        F.sum("cyclomatic").alias("cyclomatic"), F.sum("cognitive").alias("cognitive"), F.count("*").alias("functions"),
        F.avg("cyclomatic").alias("average"), F.max("cyclomatic").alias("most"), F.max_by(name, F.struct("cyclomatic", name)).alias("most_complex"),
    ).withColumn("evaluation", evaluation(F.col("most")))


def workflow_complexity(text: Column) -> Column:
    """0.1 a line, 2 a function and 1.5 a condition, to two decimals."""
    size = F.size(F.split(text, "\n"))
    functions = _count(text, s.whole_word("function") + "|=>")
    conditions = _count(text, s.whole_word("if|switch|for|while"))
    return s.round2(size * F.lit(0.1) + functions * 2 + conditions * F.lit(1.5))


# --- smells: (path, line, smell, severity)

def magic_numbers(lines: DataFrame, key: str = "path") -> DataFrame:
    """Numbers of two digits and more, one row each."""
    n = F.regexp_extract_all("text", F.lit(s.whole_word("[0-9]{2,}")), 0)
    return lines.select(key, "line", F.explode(n).alias("value")).select(key, "line", F.lit("magic-number").alias("smell"), F.lit("low").alias("severity"), "value")


def complex_conditions(lines: DataFrame, key: str = "path") -> DataFrame:
    n = _count(F.col("text"), r"&&|\|\|")
    return lines.withColumn("value", n).where("value >= 3").select(
        key, "line", F.lit("complex-condition").alias("smell"), F.when(F.col("value") >= 5, "high").otherwise("medium").alias("severity"), "value"
    )


def repeated_lines(lines: DataFrame, key: str = "path") -> DataFrame:
    """Lines that equal the two after them, of more than ten characters when trimmed."""
    order = W.partitionBy(key).orderBy("line")
    t = F.trim("text")
    marked = lines.select(key, "line", t.alias("t"), F.lead(t, 1).over(order).alias("a"), F.lead(t, 2).over(order).alias("b"))
    return marked.where("t = a and t = b and length(t) > 10").select(key, "line", F.lit("duplicate-code").alias("smell"), F.lit("medium").alias("severity"))


def size_smells(metrics: DataFrame, key: str = "path") -> DataFrame:
    """Long methods, large classes and long parameter lists from `code_metrics`, one row each."""
    level = lambda c, high: F.when(c > high, "high").otherwise("medium")
    found = F.filter(
        F.array(
            F.when(F.col("loc") > 50, F.struct(F.lit("long-method").alias("smell"), level(F.col("loc"), 100).alias("severity"))),
            F.when((F.col("methods") > 20) | (F.col("fields") > 15), F.struct(F.lit("large-class").alias("smell"), F.lit("high").alias("severity"))),
            F.when(F.col("params") > 5, F.struct(F.lit("long-parameter-list").alias("smell"), level(F.col("params"), 8).alias("severity"))),
        ),
        lambda x: x.isNotNull(),
    )
    return metrics.select(key, F.inline(found))


def penalty(severity: Column) -> Column:
    return F.when(severity == "high", 10).when(severity == "medium", 5).otherwise(2)


def overall(index: DataFrame, smells: DataFrame, key: str = "path") -> DataFrame:
    """`index` (key, maintainability) with its penalties taken off, 0 at least."""
    off = smells.groupBy(key).agg(F.sum(penalty(F.col("severity"))).alias("penalties"))
    return index.join(off, key, "left").withColumn("penalties", F.coalesce("penalties", F.lit(0))).withColumn(
        "overall", s.round2(F.greatest(F.lit(0.0), F.col("maintainability") - F.col("penalties")))
    )
