"""MinHash near-duplicates by an inverted join over signature coordinates.

1. A document's distinct word shingles are hashed to 64 bits and reduced to a
   signature of `coordinates` minima.  Documents with equal sets form a class,
   which is all that later steps see of them, so copies cost nothing.
2. Every coordinate-value pair is a posting list of classes.  Two classes of
   the wanted similarity agree in at least `matches` coordinates but for a
   chance of about 1e-7, so it suffices to post a class under the prefix of its
   rarest `coordinates - matches + 1` values: those on which no other class
   agrees are dropped first and only shorten the prefix, and a class with fewer
   than `matches` shared values has no partner at all.
3. Each list is named after one member, its hub; lists of one hub are merged
   and their repeats skipped, so a family of near copies that share many lists
   is looked at once.  Long lists are cut into parts, the hub being in each.
4. In a part, collisions are counted over the signatures; whoever is already
   connected is skipped; pairs with enough collisions are confirmed on the full
   shingle sets.  Only a spanning forest leaves a part.
5. Lists of several parts whose members are now one component, as families of
   near copies are, need nothing more.  In the others, those members that are
   not of the largest component meet all parts once more, so a link across
   parts is found wherever it could still join two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, parts
from ..operators.components import connected
from . import textkit

#: Shingles and classes of a part of a block.
PIECE_SHINGLES, PIECE_DOCS = 1_000_000, 256


def _signature(grams: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """Minimum of each coordinate's hash over each text's shingles; texts without any get zeros."""
    out = np.zeros((len(begin) - 1, coordinates), np.uint64)
    own = np.flatnonzero(np.diff(begin))
    if not len(own):
        return out
    xor, mul, salt = (textkit.stream(coordinates, s) for s in (3, 4, 5))
    for k in range(coordinates):
        x = (grams ^ xor[k]) * (mul[k] | np.uint64(1))
        x ^= x >> np.uint64(32)
        out[own, k] = textkit.mix(np.minimum.reduceat(x, begin[own]) ^ salt[k])
    return out


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in textkit.text_chunks(column, textkit.SMALL_BYTES):
        starts, ends, first = textkit.word_spans(data, offsets)
        yield a, b, *textkit.gram_hashes(textkit.word_hashes(data, starts, ends), first, words)


def _key(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums that name a set."""
    return own.sum(dtype=np.uint64), textkit.mix(own).sum(dtype=np.uint64)


def _sign(words: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, grams, begin in _sets(batch.column(1), words):
                n, k1, k2 = (np.zeros(b - a, t) for t in (np.int64, np.uint64, np.uint64))
                for i in range(b - a):
                    own = np.unique(grams[begin[i] : begin[i + 1]])
                    n[i], (k1[i], k2[i]) = len(own), _key(own)
                signature = _signature(grams, begin, coordinates).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, (b - a) * coordinates + 1, coordinates, dtype=np.int32), signature.ravel()
                )
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists],
                    ["doc_id", "n_shingles", "k1", "k2", "signature"],
                )

    return run


def _gather(words: int):
    """(rep, k1, grams) of texts: distinct shingle hashes, repeats of a set under one id once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, grams, begin in _sets(batch.column(1), words):
                own_ids, keys, sets = [], [], []
                for i in range(b - a):
                    own = np.unique(grams[begin[i] : begin[i + 1]])
                    key = int(_key(own)[0].astype(np.int64))
                    if len(own) and (ids[a + i], key) not in seen:
                        seen.add((ids[a + i], key))
                        own_ids.append(ids[a + i])
                        keys.append(key)
                        sets.append(own.view(np.int64))
                if sets:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own_ids, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], ["rep", "k1", "grams"]
                    )

    return run


class _Block:
    """Classes that meet in a task: their sets, and which component each is in so far."""

    def __init__(self, rep: np.ndarray, component: np.ndarray, left: np.ndarray, sets: list[np.ndarray], coordinates: int):
        self.rep, self.left, self.sets = rep, left, sets
        self.size = np.array([len(x) for x in sets])
        self.flat, self.begin = np.concatenate(sets), np.concatenate([[0], np.cumsum(self.size)])
        self.signature = _signature(self.flat, self.begin, coordinates)
        self.part = np.unique(component, return_inverse=True)[1]

    def links(self, matches: int, percent: int, across: bool) -> Iterator[tuple[int, int]]:
        """Pairs that join components; of all, or with `across` of those on the left with those that are not."""
        n = len(self.rep)
        done = np.zeros(n, bool)
        for i in np.flatnonzero(self.left) if across else range(n):
            other = (self.part != self.part[i]) & (~self.left if across else ~done)
            done[i] = True
            low, high = np.minimum(self.size, self.size[i]), np.maximum(self.size, self.size[i])
            other &= 100 * low >= percent * high
            at = np.flatnonzero(other)
            if len(at):
                at = at[(self.signature[at] == self.signature[i]).sum(1) >= matches]
            for j in at:
                if self.part[j] == self.part[i]:
                    continue
                shared = len(np.intersect1d(self.sets[i], self.flat[self.begin[j] : self.begin[j + 1]], assume_unique=True))
                if 100 * shared >= percent * (self.size[i] + self.size[j] - shared):
                    self.part[self.part == self.part[j]] = self.part[i]
                    yield int(self.rep[i]), int(self.rep[j])


def _confirm(coordinates: int, matches: int, percent: int, across: bool):
    """Links (u, v) of rows (hub, task, rep, k1, component, left, grams) that arrive sorted by (hub, task)."""

    def tasks(batches):
        key, held = None, []
        for batch in batches:
            hub, task = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((np.diff(hub) != 0) | (np.diff(task) != 0)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(hub)]):
                if b > a:
                    if key != (hub[a], task[a]):
                        if held:
                            yield held
                        key, held = (hub[a], task[a]), []
                    held.append(batch.slice(a, b - a))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for held in tasks(batches):
            if sum(map(len, held)) < 2:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            rep, k1, component = (table[c].to_numpy() for c in ("rep", "k1", "component"))
            left = table["left"].to_numpy(zero_copy_only=False)
            # a class whose id is repeated may come more than once
            _, first = np.unique(np.column_stack([rep, k1, left]), axis=0, return_index=True)
            first.sort()
            grams = table["grams"].combine_chunks()
            begin, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
            sets = [flat[begin[i] : begin[i + 1]] for i in first]
            found += _Block(rep[first], component[first], left[first], sets, coordinates).links(matches, percent, across)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

    return run


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 12,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of `docs`.

    Documents are linked if 100 * |intersection| >= `percent` * |union| of their
    distinct shingles of `words` lower-cased words; a text of fewer words is one
    shingle, and null, empty and blank texts have none and are linked with
    nothing.  component_id is the smallest id reachable, kept marks that
    document.  Rows of one id are one document, which is linked by each of its
    texts; every row gets the size of its own text's set.  A row without an id
    is a document of its own without a component, links nothing and is kept.
    Other columns of `docs` are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(
        given.mapInArrow(
            _sign(words, coordinates),
            "doc_id long, n_shingles long, k1 long, k2 long, signature array<long>",
        )
    )
    key = ["k1", "k2", "n_shingles"]
    # documents of equal sets stand for one another; rep names the class, with k1 where an id has several texts
    own = signed.where("n_shingles > 0 and doc_id is not null")
    alone = cut(own.groupBy(*key, "signature").agg(F.min("doc_id").alias("rep")))
    several = cut(own.groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("doc_id"))
    same = own.join(several, "doc_id").join(alone.select(*key, "rep"), key).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    posted = alone.select("rep", "k1", "n_shingles", F.explode("signature").alias("value"))
    shared = cut(posted.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    # rarest first; values that no other class has come before these and use up the prefix
    prefix = (
        posted.join(shared, "value")
        .groupBy("rep", "k1", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
        .where(F.size("values") >= matches)
        .select("rep", "k1", "n_shingles", F.explode(F.slice("values", F.lit(1), F.size("values") - matches + 1)).alias("p"))
        .select("rep", "k1", "n_shingles", F.col("p.value").alias("value"), F.xxhash64("rep", "k1").alias("name"))
    )
    prefix = cut(prefix)
    hubs = cut(prefix.groupBy("value").agg(F.min("name").alias("hub"), F.count("*").alias("df")).where("df > 1").select("value", "hub"))
    members = cut(prefix.join(hubs, "value").select("hub", "name", "rep", "k1", "n_shingles").distinct())
    pieces = cut(
        members.groupBy("hub").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total")).where("docs > 1").select(
            "hub", F.greatest(F.ceil(F.col("docs") / PIECE_DOCS), F.ceil(F.col("total") / PIECE_SHINGLES)).cast("int").alias("pieces")
        )
    )
    dealt = members.join(pieces, "hub").withColumn("task", F.pmod(F.xxhash64("name", F.lit(1)), "pieces"))
    dealt = cut(dealt.select("hub", "name", "rep", "k1", "pieces", "task"))
    wanted = dealt.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(
        given.where("doc_id is not null").join(wanted, "doc_id", "left_semi").mapInArrow(_gather(words), "rep long, k1 long, grams array<long>")
    )

    def meet(rows: DataFrame, across: bool) -> DataFrame:
        filled = (
            rows.join(sets, ["rep", "k1"])
            .select("hub", "task", "rep", "k1", "component", "left", "grams")
            .repartition(parts(spark), "hub", "task")
            .sortWithinPartitions("hub", "task")
        )
        return cut(filled.mapInArrow(_confirm(coordinates, matches, percent, across), "u long, v long"))

    # the hub of a block of several parts is in every one of them
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces") - F.lit(1).cast("long"))
    rows = dealt.select(
        "hub", "rep", "k1", F.explode(F.when((F.col("pieces") > 1) & (F.col("name") == F.col("hub")), every).otherwise(F.array("task"))).alias("task"),
        F.col("rep").alias("component"), F.lit(True).alias("left"),
    )
    edges = meet(rows, False).unionByName(same)
    components = connected(edges)
    long_ = dealt.where("pieces > 1")
    if not long_.isEmpty():
        placed = cut(
            long_.join(components, long_.rep == components.node, "left").select("hub", "name", "rep", "k1", "pieces", "task", F.coalesce("component", "rep").alias("component"))
        )
        counted = placed.groupBy("hub", "component").agg(F.count("*").alias("docs"))
        most = cut(
            counted.groupBy("hub").agg(F.max(F.struct("docs", "component"))["component"].alias("main"), F.count("*").alias("n"), (F.sum("docs") - F.max("docs")).alias("others"))
            .where("n > 1").select("hub", "main", F.ceil(F.col("others") / PIECE_DOCS).cast("int").alias("rests"))
        )
        if not most.isEmpty():
            open_ = placed.join(most, "hub")
            task = lambda rest, part: (rest * F.col("pieces") + part).alias("task")
            rest = F.pmod(F.xxhash64("name", F.lit(2)), "rests")
            keep = ["hub", "rep", "k1", "component"]
            left = open_.where("component <> main").select(*keep, rest.alias("rest"), "pieces", F.explode(every).alias("part")).select(*keep, task(F.col("rest"), F.col("part")), F.lit(True).alias("left"))
            right = open_.select(*keep, "task", "pieces", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest")).select(*keep, task(F.col("rest"), F.col("task")), F.lit(False).alias("left"))
            further = meet(left.unionByName(right), True)
            if not further.isEmpty():
                components = connected(edges.unionByName(further))
    groups = (
        alone.join(components, alone.rep == components.node, "left")
        .select(*key, F.coalesce("component", "rep").alias("component_id"))
    )
    joined = signed.select("doc_id", *key).join(groups, key, "left")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
