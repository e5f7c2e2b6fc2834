"""K-d tree sharding: shards of near equal bytes that are compact in metadata.

Equal texts form a group and stay in one shard.  Groups of more than a certain
share of a shard's target are few by arithmetic (33 a shard at most); they are
placed first, the largest to the emptiest shard, and one that
no shard has room for is dealt in pieces, for otherwise the law could not hold.  All
other groups go down the tree: each node is cut along its widest dimension at
the weighted quantile that leaves both sides the bytes their shards still want,
which is the median where nothing was placed before.  Quantiles are found by
counting bytes in bins and looking into one bin again, so the driver sees a
bounded number of bins and never a document.  Strings are dimensions by their
rank, weighted by bytes, so that values which share a long prefix are as far
apart as what lies between them.  DataFrame code only.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..lineage import cut
from .prefix import running

#: Share of a shard's target from which a group is placed by itself, and from which its pieces are counted.
HEAVY, OVERSIZE = 0.03, 0.25
#: Bins of all nodes that the driver sees at once.
MOST_BINS = 1 << 16
#: Rows whose slots are numbered together, and equal rows that are dealt together.
SLOT_DOCS = 20_000
_DIM_BITS, _TIE_BITS = 20, 31


def _number(docs: DataFrame, name: str) -> Column | None:
    """A dimension as a double, null where it is no number; None for one that has to be ranked."""
    kind, value = docs.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        value = value.cast("double")
        return F.when(F.isnan(value), None).otherwise(value)
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return value.cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    return None


def _ranked(units: DataFrame, name: str) -> DataFrame:
    """`units` (.., rows, size) with the string column `name` as the bytes of all smaller values.

    All values are placed among one another, however long prefixes they share.
    """
    values = units.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.sum(F.col("rows") * F.col("size")).alias("bytes"))
    ranks = cut(running(values, [F.col("value")], {"rank": F.col("bytes")}).select("value", F.col("rank").cast("double").alias("rank")))
    return units.join(ranks, F.col(name) == F.col("value"), "left").drop(name, "value").withColumnRenamed("rank", name)


def kd_shards(
    docs: DataFrame, target_bytes: int | None = None, shards: int | None = None,
    dimensions: tuple[str, ...] = ("doc_id", "n_chars", "lang", "source"), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`.

    size is the text's UTF-8 bytes (null: none) plus one.  There are `shards`
    shards, or as many as leaves of `target_bytes` are needed.  slot numbers a
    shard's rows from 0 without gaps.  Dimensions that `docs` lacks are left
    out; with none left, or all points equal, a hash of the text decides.  Null
    and empty texts are equal texts; null is the least value of a dimension.
    Repeated rows are rows like others, and are counted before they are dealt.
    No rows give no rows, and other columns are ignored.
    """
    spark = docs.sparkSession
    given_text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [d for d in dimensions if d in docs.columns]
    dims = [f"d{i}" for i in range(len(names))]
    numbers = [_number(docs, d) for d in names]
    values = [F.col(f"`{d}`").cast("string") if x is None else x for d, x in zip(names, numbers)]
    group = ["text_hash", "text_crc32", "size"]
    # rows that agree in id and text are one unit with a count
    units = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(given_text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(given_text, "UTF-8")).cast("long").alias("text_crc32"), F.xxhash64(given_text).alias("text_hash"),
            *[x.alias(d) for d, x in zip(dims, values)],
        )
        .groupBy("doc_id", *group).agg(F.count("*").alias("rows"), *[F.min(d).alias(d) for d in dims])
    )
    for d, x in zip(dims, numbers):
        if x is None:
            units = _ranked(units, d)
    if any(x is None for x in numbers):
        units = cut(units)
    groups = cut(units.groupBy(group).agg(F.sum(F.col("rows") * F.col("size")).alias("bytes"), *[F.min(d).alias(d) for d in dims]))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    n = shards or max(1, math.ceil(total / target_bytes))
    target = total / n
    most = max(1.0, HEAVY * target)
    # a unit of very many rows is dealt in shares
    shares = F.least("rows", F.greatest(F.ceil(F.col("rows") * F.col("size") / most), F.ceil(F.col("rows") / SLOT_DOCS))).cast("int")
    units = units.select("doc_id", *group, "rows", shares.alias("shares")).select(
        "doc_id", *group, "rows", "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    ).select("doc_id", *group, "share", (F.expr("rows div shares") + (F.col("share") < F.expr("rows % shares")).cast("long")).alias("rows"))

    # the large groups, 1 / HEAVY a shard at most, and their pieces
    heavy = groups.where(F.col("bytes") >= most).withColumn(
        "pieces", F.when(F.col("bytes") > OVERSIZE * target, F.ceil(F.col("bytes") / most)).otherwise(1).cast("int")
    ).select(*group, "pieces")
    heavy = F.broadcast(heavy)
    marked = units.join(heavy, group, "left").withColumn(
        "piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", "share", F.lit(5)), "pieces").cast("int"))
    )
    pieces = marked.where("piece is not null").groupBy(*group, "piece").agg(F.sum(F.col("rows") * F.col("size")).alias("bytes")).collect()
    fill, placed, own = [(0, k) for k in range(n)], [], defaultdict(list)
    for r in pieces:
        own[tuple(r[g] for g in group)].append((r["bytes"], r["piece"]))
    for key, parts_ in sorted(own.items(), key=lambda kv: (-sum(b for b, _ in kv[1]), kv[0])):
        whole = sum(b for b, _ in parts_)
        together = len(parts_) == 1 or fill[0][0] + whole <= target
        for bytes_, piece in [(whole, None)] if together else sorted(parts_, reverse=True):
            held, k = heapq.heappop(fill)
            placed += [(*key, p, k) for _, p in parts_ if piece in (None, p)]
            heapq.heappush(fill, (held + bytes_, k))
    wanted = [max(0.0, target - held) for held, _ in sorted(fill, key=lambda f: f[1])]
    schema = "text_hash long, text_crc32 long, size long, piece int, placed int"
    by_piece = F.broadcast(spark.createDataFrame(placed, schema))

    light = groups.join(heavy.select(*group), group, "left_anti")
    leaves = _tree(light, dims, group, wanted)
    sharded = (
        marked.join(by_piece, [*group, "piece"], "left")
        .join(leaves, group, "left")
        .select("doc_id", "size", "text_crc32", "share", "rows", F.coalesce("placed", "leaf").alias("shard"))
    )
    return _slots(cut(sharded), n)


def _tree(points: DataFrame, dims: list[str], group: list[str], wanted: list[float]) -> DataFrame:
    """(group, leaf) for points (group, bytes, dims): leaves 0 to len(wanted) - 1 get near `wanted` bytes."""
    spark = points.sparkSession
    tie = F.shiftrightunsigned(F.xxhash64(*group), 64 - _TIE_BITS)
    points = points.select(*group, "bytes", *dims, tie.alias("tie"), F.lit(0).alias("begin"), F.lit(len(wanted)).alias("end"))
    ranges = points.agg(*[F.max(d) - F.min(d) for d in dims]).first() if dims else ()
    scale = [r if r else math.inf for r in ranges]
    more = len(wanted) > 1
    while more:
        points = cut(points)
        # one row a node; there are never more nodes than shards
        nodes = (
            points.where(F.col("end") - F.col("begin") > 1).groupBy("begin", "end")
            .agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{d}{n}") for d in dims for n, f in (("_lo", F.min), ("_hi", F.max))])
            .collect()
        )
        if not nodes:
            break
        splits = {}
        for r in nodes:
            width = [((r[f"{d}_hi"] or 0) - (r[f"{d}_lo"] or 0)) / s if r[f"{d}_hi"] is not None else 0 for d, s in zip(dims, scale)]
            widest = max(range(len(dims)), key=lambda i: width[i], default=-1)
            a, b = r["begin"], r["end"]
            mid, sum_ = (a + b) // 2, sum(wanted[a:b])
            share = sum(wanted[a:mid]) / sum_ if sum_ else 0.5
            lo, hi = (r[f"d{widest}_lo"], r[f"d{widest}_hi"]) if widest >= 0 and width[widest] > 0 else (0.0, 0.0)
            splits[a, b] = [widest if hi > lo else -1, lo, hi, mid, share * r["bytes"], 0, 0.0]
        points = _cut_nodes(spark, points, splits, dims, sum(wanted) / len(wanted))
    return points.select(*group, F.col("begin").alias("leaf"))


def _cut_nodes(spark, points: DataFrame, splits: dict, dims: list[str], leaf: float) -> DataFrame:
    """Each node's points into its two halves.  splits: dimension, its range, middle, bytes wanted left; then bound and bytes below it."""
    table = lambda: F.broadcast(
        spark.createDataFrame(
            [(a, b, s[0], float(s[1]), float(s[2]), s[3], s[5]) for (a, b), s in splits.items()],
            "begin int, end int, axis int, lo double, hi double, mid int, bound long",
        )
    )
    value = F.lit(0.0)
    for i, d in enumerate(dims):
        value = F.when(F.col("axis") == i, F.coalesce(F.col(d), F.col("lo"))).otherwise(value)
    scaled = F.when(F.col("axis") >= 0, (value - F.col("lo")) / (F.col("hi") - F.col("lo")) * ((1 << _DIM_BITS) - 1)).otherwise(0.0)
    code = (F.floor(scaled).cast("long") * (1 << _TIE_BITS) + F.col("tie")).alias("code")
    bits = max(4, int(math.log2(MOST_BINS / len(splits))))
    left = _DIM_BITS + _TIE_BITS
    # the points are stored; their codes are computed as they are read
    coded = points.join(table().drop("bound"), ["begin", "end"]).select("begin", "end", "bytes", code)
    open_ = set(splits)
    while left > 0 and open_:
        step = min(bits, left)
        # within the bin [bound, bound + 2^left) of each node, bytes of its 2^step parts
        bins = (
            coded.join(table().select("begin", "end", "bound"), ["begin", "end"])
            .where(F.shiftright(F.col("code"), left) == F.shiftright(F.col("bound"), left) if left < _DIM_BITS + _TIE_BITS else F.lit(True))
            .groupBy("begin", "end", F.shiftright("code", left - step).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()
        )
        left -= step
        by: dict = {}
        for r in bins:
            by.setdefault((r["begin"], r["end"]), []).append((r["bin"], r["bytes"]))
        for node in list(open_):
            s = splits[node]
            for bin_, bytes_ in sorted(by.get(node, [])):
                if s[6] + bytes_ > s[4]:
                    s[5] = bin_ << left
                    if bytes_ <= 1e-4 * leaf or left == 0:
                        # the nearer edge of the bin
                        if s[6] + bytes_ - s[4] < s[4] - s[6]:
                            s[5] = (bin_ + 1) << left
                        open_.discard(node)
                    break
                s[6] += bytes_
                s[5] = (bin_ + 1) << left
            else:
                open_.discard(node)
    right = F.col("code") >= F.col("bound")
    return (
        points.join(table(), ["begin", "end"], "left")
        .withColumn("code", code)
        .select(
            *[c for c in points.columns if c not in ("begin", "end")],
            F.when(F.col("mid").isNotNull() & right, F.col("mid")).otherwise(F.col("begin")).alias("begin"),
            F.when(F.col("mid").isNotNull() & ~right, F.col("mid")).otherwise(F.col("end")).alias("end"),
        )
    )


def _slots(sharded: DataFrame, shards: int) -> DataFrame:
    """Numbers the rows of each shard from 0: ranks in buckets of bounded size, after the buckets before."""
    count = sharded.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(count / (SLOT_DOCS * shards)))
    dealt = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "share"), F.lit(buckets)))
    # one row a bucket, a bucket for some ten thousand rows
    held = dealt.groupBy("shard", "bucket").agg(F.sum("rows").alias("held"))
    before = held.withColumn(
        "before", F.coalesce(F.sum("held").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("held")
    upto = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "share").rowsBetween(W.unboundedPreceding, -1)
    first = dealt.withColumn("first", F.coalesce(F.sum("rows").over(upto), F.lit(0))).join(before, ["shard", "bucket"])
    return first.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
