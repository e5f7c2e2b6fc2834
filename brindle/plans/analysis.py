"""Analyses of a whole tree: the tables that the score and reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..lineage import cut
from ..operators import clones, graph, metrics, parse, rules, score, symbols


class Project:
    """Lazy tables over FILES; each is computed once a property is used in an action, and `cache` keeps those that several share."""

    def __init__(self, files: DataFrame):
        self.files = files

    def symbols(self) -> DataFrame:
        return parse.symbols(self.files)

    def imports(self) -> DataFrame:
        return parse.imports(self.files)

    def functions(self) -> DataFrame:
        return parse.functions(self.files)

    def complexity(self) -> DataFrame:
        """Per file: sums, mean, maximum and the most complex function."""
        return metrics.roll_up(self.functions())

    def edges(self) -> DataFrame:
        return graph.edges_of(graph.resolve(self.imports(), self.files))

    def issues(self) -> DataFrame:
        return rules.issues(self.files)

    def metrics(self) -> DataFrame:
        t = F.col("content")
        counted = metrics.code_metrics(metrics.halstead(self.files))
        return counted.select(
            "path", "methods", "fields", "params", "cyclomatic", "loc", "volume",
            metrics.maintainability(F.col("volume"), F.col("cyclomatic"), F.col("loc")).alias("maintainability"), metrics.cyclomatic_words(t).alias("words_cyclomatic"),
        )

    def score(self) -> DataFrame:
        """(dimension, score, weight, weighted) in four rows."""
        files, imports_ = self.files, self.imports()
        n = files.count()
        m = self.functions().groupBy("path").agg(
            F.count("*").alias("functions"), F.max("cyclomatic").alias("most"), F.avg("cyclomatic").alias("average"), F.sum("cognitive").alias("cognitive"), F.max("params").alias("params")
        )
        declared = self.symbols()
        dead = symbols.unused(declared, symbols.identifiers(files))
        frags = clones.fragments(files)
        one = lambda df, name: df.agg(F.count("*").alias(name))
        upkeep = (
            one(dead, "dead").crossJoin(one(declared, "symbols")).crossJoin(files.agg(F.count_if(F.size(F.split("content", "\n")) > 500).alias("large"), F.count("*").alias("files")))
            .crossJoin(clones.duplicated_fragments(frags).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicated")))
            .crossJoin(one(rules.pattern_summary(rules.patterns(files)).where("severity = 'high'"), "patterns"))
        )
        edges = self.edges()
        nodes = files.select(F.col("path").alias("node"))
        built = (
            one(graph.strong_components(edges).groupBy("component").count().where("count > 1"), "cycles")
            .crossJoin(one(graph.orphans(edges, nodes), "orphans")).crossJoin(one(graph.high_coupling(imports_), "coupled")).withColumn("files", F.lit(n))
        )
        c = F.col("category")
        checked = self.issues().agg(
            F.count_if(c == "type-safety").alias("type_issues"), F.count_if(c == "error-handling").alias("error_issues"), F.count_if(c == "naming").alias("naming_issues"),
            F.count_if(c == "security").alias("security_issues"),
        ).crossJoin(files.agg(F.count_if(symbols.is_test_file(F.col("path"))).alias("tests"))).withColumn("files", F.lit(n))
        return score.combine(score.complexity_dimension(m), score.maintainability_dimension(upkeep), score.architecture_dimension(built), score.qa_dimension(checked))

    def dead_by_type(self) -> DataFrame:
        """(type, n, share) of declarations that nothing uses, and (total, ...) of all of them."""
        marked = symbols.marked_unused(self.symbols(), symbols.identifiers(parse.spread(self.files)))
        every = cut(marked.groupBy("type").agg(F.count("*").alias("n"), F.count_if("unused").alias("dead")))
        both = every.unionByName(every.agg(F.lit("total").alias("type"), F.sum("n").alias("n"), F.sum("dead").alias("dead")))
        return both.select("type", "n", "dead", s.round2(s.ratio(F.col("dead"), F.col("n")) * 100).alias("percent"))

    def quality_report(self) -> DataFrame:
        """One row: scores by category from 100 down, their weighted sum with the share of tests, and the files looked at."""
        n = self.files.agg(F.count("*").alias("files"), F.count_if(symbols.is_test_file(F.col("path"))).alias("tests")).first()
        share = F.lit(n["tests"] / n["files"] if n["files"] else 0.0)
        return rules.deductions(self.issues(), share).withColumn("files", F.lit(n["files"])).withColumn("test_files", F.lit(n["tests"]))
