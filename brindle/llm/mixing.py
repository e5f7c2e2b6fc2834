"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and `most` copies.  Among all rates whose
words meet the target of each source, the ones nearest to one copy each, in
bounded relative entropy, are wanted; by duality they are an exponential tilt
of document size, rate = most / (1 + (most - 1) * exp(-lambda * size / mean)),
with one multiplier lambda a source.  The convex dual is solved by safeguarded
Newton steps, each one aggregation over (source, size) cells.

Rates become whole copies by systematic rounding over cells in order of size;
what is then missing or over is made good with a bounded pool of documents of
all magnitudes.  Everything is DataFrame code, and no window or group holds
more than a bounded number of a source's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut
from .prefix import running

WORD = r"[^\x20\x09-\x0D]+"
#: Documents ranked together; larger cells are salted.
CELL_DOCS = 1_000
#: Rows up to which a table of sources, of crowded cells or ids is broadcast.
BROADCAST_ROWS = 100_000
NEWTON_STEPS = 60
#: Documents of each power of two of sizes with which a source is brought nearer its target.
POOL = 8


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """`sizes` (key, source, source_size) with `target`.

    Sources in order of code points, null last, weigh `weights`, repeated; they
    share all words by weight, but none gets more than `most` times its own, and
    what is above is shared anew.  That is the level at which the capped shares
    add up to all words; it is found in order of each source's own level.
    """
    ranked = running(sizes, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("double")
    weighed = ranked.withColumn("weight", weight).withColumn("level", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    shared = cut(running(weighed, [F.col("level"), F.col("key")], {"capped": most * F.col("source_size"), "below": F.col("weight")}))
    # one row each
    words, weights_ = shared.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    offered = shared.withColumn("offer", (F.lit(words) - F.col("capped")) / (F.lit(weights_) - F.col("below")))
    at = offered.where("offer <= level").agg(F.min(F.struct("level", "key", "offer"))["offer"]).first()[0]
    return shared.select(
        "key", "source", "source_size",
        F.least(F.lit(float(most)) * F.col("source_size"), F.lit(float("inf") if at is None else at) * F.col("weight")).alias("target"),
    )


def _rate(tilt: Column, most: int) -> Column:
    # exp of a bounded argument: beyond it the rate is 0 or `most` to double precision
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-F.greatest(F.lit(-300.0), F.least(F.lit(300.0), tilt))))


def _solve(cells: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(key, tilt, free): the multiplier of each source, free where it is below its cap."""
    state = cut(
        targets.join(cells.groupBy("key").agg(F.sum(F.col("docs") * F.col("size")).alias("words"), F.sum("docs").alias("all_docs")), "key").select(
            "key", "target", (F.col("words") / F.col("all_docs")).alias("mean"),
            F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            (F.col("target") < most * F.col("words") * (1 - 1e-12)).alias("free"), F.lit(1.0).alias("off"),
        )
    )
    small = F.broadcast if state.count() <= BROADCAST_ROWS else lambda df: df
    for _ in range(NEWTON_STEPS):
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt") * z, most)
        words = F.col("docs") * F.col("size")
        seen = cells.join(small(state.where("free").select("key", "tilt", "mean")), "key").groupBy("key").agg(
            F.sum(words * rate).alias("got"), F.sum(words * z * rate * (1 - rate / most)).alias("slope")
        )
        over = F.col("got") - F.col("target")
        step = state.join(small(seen), "key", "left").select(
            "key", "target", "mean", "tilt", "free", "got", "slope",
            F.when(over < 0, F.col("tilt")).otherwise(F.col("low")).alias("low"),
            F.when(over > 0, F.col("tilt")).otherwise(F.col("high")).alias("high"),
            F.coalesce(F.abs(over) / F.col("target"), F.lit(0.0)).alias("off"),
        )
        newton = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.coalesce(newton > F.col("low"), F.lit(True))) & (F.coalesce(newton < F.col("high"), F.lit(True))) & (F.col("slope") > 0)
        fallback = F.when(
            F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2
        ).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise(F.col("high") * 2 - 1)
        state = cut(
            step.select(
                "key", "target", "mean", "low", "high", "free", "off",
                F.when(~F.col("free") | (F.col("off") < 1e-9), F.col("tilt"))
                .when(inside & (F.abs(newton - F.col("tilt")) < 4), newton)
                .otherwise(F.coalesce(fallback, F.col("tilt")))
                .alias("tilt"),
            )
        )
        if (state.agg(F.max("off")).first()[0] or 0) < 1e-9:
            break
    return state.select("key", "tilt", "mean", "free")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row of `docs`, and its columns `keep`.

    size counts words (null: 0); taken = copies * size, with 0 <= copies <=
    `most`.  Null is a source of its own.  Documents without words, null and
    empty texts among them, are copied once and take nothing; a source without
    words has target 0.  Repeated rows are rounded one by one.  No rows give
    none.  The result depends on the rows only, but where one id has more than
    `CELL_DOCS` rows of one size and source it depends on how the table is cut
    into partitions, too.  Columns of other names are ignored, those of `keep`
    must not be called like one of the result.
    """
    given = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            words_in(F.col(text_col).cast("string")).alias("size"), *keep,
        ).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    )
    cells = cut(given.groupBy("key", "source", "size").agg(F.count("*").alias("docs")))
    sizes = cells.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    targets = cut(source_targets(sizes, weights, most))
    filled = cells.where("size > 0")
    tilts = _solve(filled, targets.where("source_size > 0"), most)
    rated = cut(
        cells.join(tilts, "key", "left").select(
            "key", "size",
            F.when(F.col("size") == 0, 1.0)
            .when(F.col("free"), _rate(F.col("tilt") * F.col("size") / F.col("mean"), most))
            .otherwise(float(most)).alias("rate"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("docs") / CELL_DOCS) - 1)).alias("salt"),
        )
    )
    # crowded cells are salted by their documents' ids, ids that crowd a cell themselves by their rows
    hot = cut(cells.where(F.col("docs") > CELL_DOCS).select("key", "size", F.ceil(F.col("docs") / CELL_DOCS).alias("salts")))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    placed = given.select("*", F.xxhash64("doc_id", F.lit(3)).alias("by_id"), F.monotonically_increasing_id().alias("nth")).join(small(hot), ["key", "size"], "left")
    crowds = cut(
        placed.where("salts is not null").groupBy("key", "size", "by_id").agg(F.count("*").alias("n")).where(F.col("n") > CELL_DOCS)
        .select("key", "size", "by_id", F.lit(True).alias("crowd"))
    )
    placed = placed.join(small(crowds), ["key", "size", "by_id"], "left")
    salt = F.pmod(F.when(F.col("crowd"), F.xxhash64("nth")).otherwise(F.col("by_id")), F.coalesce("salts", F.lit(1).cast("long")))
    salted = placed.withColumn("salt", salt).drop("salts", "crowd", "by_id", "nth").join(rated, ["key", "size", "salt"])
    cell = ["key", "size", "salt"]
    by_size = W.partitionBy("key").orderBy(F.desc("size"), "salt")
    quota = (
        salted.groupBy(*cell).agg(F.count("*").alias("docs"), F.any_value("rate").alias("rate"))
        .withColumn("upto", F.floor(F.sum(F.col("docs") * F.col("rate")).over(by_size.rowsBetween(W.unboundedPreceding, 0)) + 0.5))
        .withColumn("quota", F.least(F.col("upto") - F.coalesce(F.lag("upto").over(by_size), F.lit(0)), F.col("docs") * most))
        .select(*cell, F.expr("quota div docs").alias("each"), F.expr("quota % docs").alias("extra"))
    )
    rank = F.row_number().over(W.partitionBy(*cell).orderBy(F.xxhash64("doc_id"), "doc_id"))
    rounded = cut(
        salted.withColumn("rank", rank).join(quota, cell)
        .withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("each") + (F.col("rank") <= F.col("extra")).cast("int")).cast("int"))
        .drop("each", "extra")
    )
    moved = _make_good(rounded, targets, most)
    done = rounded.join(moved, [*cell, "rank"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return done.join(targets.select("key", "source_size", "target"), "key").select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep
    )


def _make_good(rounded: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(key, size, salt, rank, change): documents whose copies change by one so that sources come nearer their targets.

    The pool has up to `POOL` documents of each power of two of sizes.  From the
    largest on, each is copied once more or less if the source comes nearer its
    target by it; last, the best exchange of two that have not changed is made.
    """
    doc = F.struct("size", "salt", "rank", (F.col("copies") < most).alias("more"), (F.col("copies") > 0).alias("less"))
    by_hash = F.xxhash64("doc_id", F.lit(9))
    pool = (
        rounded.where("size > 0")
        .groupBy("key", F.floor(F.log2("size")).alias("magnitude"), F.pmod(by_hash, F.lit(POOL)).alias("part"))
        .agg(F.min(F.struct(by_hash.alias("order"), doc.alias("doc"))).alias("d"), F.sum(F.col("copies") * F.col("size")).alias("taken"))
        .groupBy("key")
        .agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list("d.doc"), asc=False).alias("pool"))
        .join(targets.select("key", "target"), "key")
    )
    kind = "struct<size:bigint,salt:bigint,rank:int,change:int>"
    one = lambda x, change: F.struct(x["size"].cast("bigint").alias("size"), x["salt"].cast("bigint").alias("salt"), x["rank"].alias("rank"), F.lit(change).alias("change"))
    start = F.struct((F.col("target") - F.col("taken")).alias("rest"), F.expr(f"cast(array() as array<{kind}>)").alias("picked"))

    def step(acc, x):
        take = lambda change: F.struct((acc["rest"] - change * x["size"]).alias("rest"), F.concat(acc["picked"], F.array(one(x, change))).alias("picked"))
        return F.when(x["more"] & (2 * acc["rest"] > x["size"]), take(1)).when(x["less"] & (-2 * acc["rest"] > x["size"]), take(-1)).otherwise(acc)

    changed = pool.select("key", "pool", F.aggregate("pool", start, step).alias("acc")).select("key", "pool", "acc.rest", "acc.picked")
    changed = cut(changed)
    same = lambda x: F.exists("picked", lambda y: (y["size"] == x["size"]) & (y["salt"] == x["salt"]) & (y["rank"] == x["rank"]))
    left = changed.select("key", "rest", "picked", F.filter("pool", lambda x: ~same(x)).alias("left"))
    # of all (one more, one less): the exchange that leaves the least
    best = F.aggregate(
        "left",
        F.struct(F.abs("rest").alias("off"), F.expr(f"cast(array() as array<{kind}>)").alias("swap")),
        lambda acc, x: F.when(
            ~x["more"], acc
        ).otherwise(
            F.aggregate(
                "left", acc,
                lambda b, y: F.when(
                    y["less"] & (F.abs(F.col("rest") - x["size"] + y["size"]) < b["off"]),
                    F.struct(F.abs(F.col("rest") - x["size"] + y["size"]).alias("off"), F.array(one(x, 1), one(y, -1)).alias("swap")),
                ).otherwise(b),
            )
        ),
        lambda acc: acc["swap"],
    )
    return left.select("key", F.explode(F.concat("picked", best)).alias("d")).select("key", "d.size", "d.salt", "d.rank", "d.change")
