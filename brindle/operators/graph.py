"""Dependency graphs as edge tables (src, dst).

Loops run over DataFrames and cut their lineage with checkpoints; a round costs
a fixed number of shuffles over the frontier or the edges.  Nothing but counts
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..lineage import cut
from .components import connected

# Names of system frameworks, which count as external.
SYSTEM_FRAMEWORKS = (
    "Foundation", "UIKit", "SwiftUI", "Combine", "CoreData", "CoreGraphics", "CoreLocation", "AVFoundation", "MapKit", "WebKit", "Security", "PackageDescription",
)


def resolve(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx", ".swift")) -> DataFrame:
    """(src, specifier, dst, found): relative specifiers resolved against the importing file's folder.

    The path as written is tried first, then with each extension, then as a
    folder's index; what is not found keeps its normalized path.
    """
    base = imports.where("is_relative").select(
        F.col("path").alias("src"), "specifier", s.join_path(s.dirname(F.col("path")), F.col("specifier")).alias("target")
    )
    tries = ["", *extensions, *[f"/index{e}" for e in extensions]]
    candidates = base.select("*", F.posexplode(F.array(*[F.concat("target", F.lit(t)) for t in tries])).alias("_order", "path"))
    hit = candidates.join(files.select("path").distinct(), "path").groupBy("src", "specifier").agg(F.min_by("path", "_order").alias("hit"))
    return base.join(hit, ["src", "specifier"], "left").select(
        "src", "specifier", F.coalesce("hit", "target").alias("dst"), F.col("hit").isNotNull().alias("found")
    ).distinct()


def edges_of(resolved: DataFrame) -> DataFrame:
    return resolved.select("src", "dst").distinct()


def nodes(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    out = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    if files is not None:
        out = out.unionByName(files.select(F.col("path").alias("node")))
    return out.distinct()


def degrees(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, in_degree, out_degree) in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    if all_nodes is not None:
        ends = ends.unionByName(all_nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def orphans(edges: DataFrame, all_nodes: DataFrame, kind: str = "isolated") -> DataFrame:
    """Nodes without edges (isolated), or without incoming ones (root)."""
    d = degrees(edges, all_nodes)
    return d.where("in_degree = 0 and out_degree = 0" if kind == "isolated" else "in_degree = 0").select("node")


def without_relative_import(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files none of whose specifiers is relative."""
    return files.select("path").join(imports.where("is_relative").select("path"), "path", "left_anti")


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that depend on each other, the smaller first."""
    a, b = edges.alias("a"), edges.alias("b")
    return a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).where("a.src < a.dst").select(
        F.col("a.src").alias("src"), F.col("a.dst").alias("dst")
    ).distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, backward: bool = False) -> DataFrame:
    """(origin, node, distance): all that each `start` node reaches; itself only if it is on a cycle."""
    e = edges.select(F.col("dst").alias("_a"), F.col("src").alias("_b")) if backward else edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    e = cut(e.distinct())
    frontier = start.select(F.col("node").alias("origin"), "node").distinct()
    seen, level = None, 0
    while depth is None or level < depth:
        level += 1
        new = frontier.join(e, frontier.node == e["_a"]).select("origin", F.col("_b").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen, ["origin", "node"], "left_anti")
        new = cut(new.withColumn("distance", F.lit(level)))
        if new.isEmpty():
            break
        seen = new if seen is None else cut(seen.unionByName(new))
        frontier = new.select("origin", "node")
    return seen if seen is not None else start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("distance")).limit(0)


def components(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): smallest node connected with each, edges taken both ways."""
    every = nodes(edges) if all_nodes is None else nodes(edges).unionByName(all_nodes.select("node")).distinct()
    return every.join(connected(edges, "src", "dst"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def is_connected(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    return components(edges, all_nodes).agg((F.count_distinct("component") <= 1).alias("connected"))


def topological_levels(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): nodes without incoming edges are 0, then layer by layer; null on cycles and behind them."""
    e = cut(edges.where("src <> dst").distinct())
    left = cut(nodes(edges) if all_nodes is None else all_nodes.select("node").unionByName(nodes(edges)).distinct())
    selfish = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    done, level = None, 0
    while True:
        free = left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").join(selfish, "node", "left_anti")
        free = cut(free.withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(free, "node", "left_anti"))
        e = cut(e.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components named by their smallest node.

    Colouring: every node takes the smallest colour that reaches it; what a
    colour's own node is reached by, within the colour, is its component and
    leaves the graph.  First, nodes without an incoming or outgoing edge are
    peeled off, for each is a component of its own.
    """
    every = nodes(edges)
    e = cut(edges.where("src <> dst").distinct())
    found = None
    left = cut(every)
    while not left.isEmpty():
        # trim
        while True:
            core = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            core = cut(left.join(core, "node", "left_semi"))
            kept = e.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
            kept = cut(kept)
            alone = left.join(core, "node", "left_anti")
            lone = cut(alone.select("node", F.col("node").alias("component")))
            none = lone.isEmpty()
            if not none:
                found = lone if found is None else found.unionByName(lone)
            left, e = core, kept
            if none:
                break
        if left.isEmpty():
            break
        colours = left.select("node", F.col("node").alias("colour"))
        while True:
            near = e.join(colours, e.src == colours.node).groupBy("dst").agg(F.min("colour").alias("m"))
            step = cut(colours.join(near, colours.node == near.dst, "left").select("node", F.least("colour", "m").alias("colour"), F.col("colour").alias("old")))
            colours = step.select("node", "colour")
            if step.where("colour <> old").isEmpty():
                break
        c1, c2 = colours.toDF("src", "c1"), colours.toDF("dst", "c2")
        inside = cut(e.join(c1, "src").join(c2, "dst").where("c1 = c2").select("src", "dst"))
        members = cut(colours.where("node = colour"))
        frontier = members
        while True:
            back = inside.join(frontier.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut(back.join(members, ["node", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            members = cut(members.unionByName(frontier))
        got = members.select("node", F.col("colour").alias("component"))
        found = got if found is None else found.unionByName(got)
        left = cut(left.join(members.select("node"), "node", "left_anti"))
        e = cut(
            e.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        )
    return found if found is not None else every.select("node", F.col("node").alias("component"))


def cycles(edges: DataFrame, scc: DataFrame | None = None, most_length: int | None = None, self_loops: bool = False) -> DataFrame:
    """(component, length, cycle, severity, fix): a shortest cycle through the smallest node of each component of several nodes.

    All components are searched at once, level by level, and paths are read
    back over the parents kept; no group is ever collected.  Components of more
    than `most_length` nodes are reported with their size and without a path.
    """
    scc = strong_components(edges) if scc is None else scc
    kind = dict(scc.dtypes)["node"]
    sizes = scc.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    small = sizes if most_length is None else sizes.where(F.col("members") <= most_length)
    a, b = scc.toDF("src", "component"), scc.toDF("dst", "c2")
    inner = cut(
        edges.distinct().join(a, "src").join(b, "dst").where("component = c2 and src <> dst").join(small.select("component"), "component").select("component", "src", "dst")
    )
    frontier = small.select("component", F.col("component").alias("node"))
    seen = cut(frontier.withColumn("parent", F.lit(None).cast(kind)))
    frontier, closed = seen.select("component", "node"), None
    while not frontier.isEmpty():
        out = frontier.withColumnRenamed("node", "src").join(inner, ["component", "src"])
        done = cut(out.where("dst = component").groupBy("component").agg(F.min("src").alias("last")))
        closed = done if closed is None else closed.unionByName(done)
        new = out.join(done, "component", "left_anti").groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = cut(new.join(seen, ["component", "node"], "left_anti"))
        seen = cut(seen.unionByName(new))
        frontier = new.select("component", "node")
    if closed is None:
        paths = small.select("component", F.lit(0).alias("length"), F.array("component").alias("cycle")).limit(0)
    else:
        paths = closed.select("component", F.col("last").alias("at"), F.array("last").alias("cycle"))
        while True:
            paths = cut(paths)
            if paths.where("at <> component").isEmpty():
                break
            step = paths.join(seen.select("component", F.col("node").alias("at"), "parent"), ["component", "at"], "left")
            paths = step.select(
                "component", F.coalesce("parent", "at").alias("at"),
                F.when(F.col("parent").isNull(), F.col("cycle")).otherwise(F.concat(F.array("parent"), F.col("cycle"))).alias("cycle"),
            )
        paths = paths.select("component", F.size("cycle").alias("length"), "cycle")
    if most_length is not None:
        paths = paths.unionByName(sizes.where(F.col("members") > most_length).select("component", F.col("members").cast("int").alias("length"), F.lit(None).cast(f"array<{kind}>").alias("cycle")))
    if self_loops:
        paths = paths.unionByName(edges.where("src = dst").select(F.col("src").alias("component"), F.lit(1).alias("length"), F.array("src").alias("cycle")).distinct())
    return paths.withColumn("severity", cycle_severity(F.col("length"))).withColumn("fix", cycle_fix(F.col("length")))


def cycle_severity(length: Column) -> Column:
    return F.when(length <= 3, "low").when(length <= 6, "medium").otherwise("high")


def cycle_fix(length: Column) -> Column:
    return (
        F.when(length == 1, "remove the self reference").when(length == 2, "extract what both share").when(length <= 5, "invert a dependency").otherwise("split the modules")
    )


def component_complexity(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(component, complexity): inner edges and half of the edges from outside, rounded."""
    a, b = scc.toDF("src", "c1"), scc.toDF("dst", "c2")
    big = scc.groupBy("component").count().where("count > 1").select("component")
    return (
        edges.distinct().join(a, "src").join(b, "dst").join(big, F.col("c2") == F.col("component"))
        .groupBy("component").agg(s.round_half_up(F.count_if(F.col("c1") == F.col("c2")) + 0.5 * F.count_distinct(F.when(F.col("c1") != F.col("c2"), F.col("src")))).alias("complexity"))
    )


def impact(edges: DataFrame, targets: DataFrame, is_test) -> DataFrame:
    """(origin, direct, transitive, tests, impact_score) of changes to `targets` (node): who depends on them."""
    back = reach(edges, targets, backward=True).where("origin <> node")
    got = back.groupBy("origin").agg(
        F.count_if(F.col("distance") == 1).alias("direct"), F.count("*").alias("transitive"), F.count_if(is_test(F.col("node"))).alias("tests")
    )
    out = targets.select(F.col("node").alias("origin")).distinct().join(got, "origin", "left").fillna(0, ["direct", "transitive", "tests"])
    return out.withColumn("impact_score", F.col("direct") * 3 + F.col("transitive") + F.col("tests") * 0.5)


def impact_level(affected: Column, total: Column) -> tuple[Column, Column]:
    """Level by the number of affected files, and a score of at most 100 by their share."""
    level = F.when(affected > 10, "high").when(affected > 3, "medium").otherwise("low")
    return level, F.least(F.lit(100.0), s.round_half_up(s.ratio(affected, total) * 200))


def stats(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(files, dependencies, average, most, orphans) in one row."""
    d = degrees(edges, all_nodes)
    return d.agg(
        F.count("*").alias("files"), F.sum("out_degree").alias("dependencies"), s.round2(s.ratio(F.sum("out_degree"), F.count("*"))).alias("average"),
        F.max("out_degree").alias("most"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("orphans"),
    )


def export(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, kind): internal if it is one of `files` and no system framework."""
    d = degrees(edges, files.select(F.col("path").alias("node")))
    known = files.select(F.col("path").alias("node"), F.lit(True).alias("_own")).distinct()
    return d.join(known, "node", "left").select(
        "node", "in_degree", "out_degree",
        F.when(F.col("_own") & ~F.col("node").cast("string").isin(*SYSTEM_FRAMEWORKS), "internal").otherwise("external").alias("kind"),
    )


def remove_node(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("src") != F.lit(node)) & (F.col("dst") != F.lit(node)))


def replace_out_edges(edges: DataFrame, changed: DataFrame, sources: DataFrame) -> DataFrame:
    """After files are analysed again: their edges are those of `changed`."""
    return edges.join(sources.select(F.col("path").alias("src")).distinct(), "src", "left_anti").select("src", "dst").unionByName(changed.select("src", "dst"))


def high_coupling(imports: DataFrame, most: int = 10) -> DataFrame:
    """Files with more than `most` distinct relative specifiers."""
    return imports.where("is_relative").groupBy("path").agg(F.count_distinct("specifier").alias("specifiers")).where(F.col("specifiers") > most)


