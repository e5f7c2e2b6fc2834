"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample by hierarchical k-means whose
assignment charges for list size, kept in memory and searched by walking a
graph that ties each to its nearest ones.  Every vector is posted to the
nearest centroid and, near a boundary, to further ones: those within a distance
ratio that no centroid already taken is nearer to.  A query reads the lists
whose distance is within a ratio of the nearest one's, or of the mean distance
of vectors from their centroids where that is more (a query may be a centroid),
and further ones until they hold as many vectors as are asked for, and some
hundred at least.

The ratio is not guessed: it is measured on the sample, as the least one whose
lists hold the wanted share of the true neighbours of some sample vectors.
Vectors in clusters then read few lists, vectors without any structure many.

Long lists are cut into parts by a hash, so a list that holds a third of all
vectors is read by many tasks.  Distances of what is read are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut, parts

#: Vectors of a list, and queries, that meet in one step; bounds the memory of a task.
PART_ROWS, PART_QUERIES = 4096, 256


@dataclass(frozen=True)
class Settings:
    """How the index is fitted and searched.

    sample: vectors that centroids are fitted on; per_list: vectors a list
    should hold; most_lists: centroids kept in memory at most (lists are longer
    beyond that); replicas: lists that a vector is posted to at most; closure:
    ratio of distances within which it is; recall: share of the true neighbours
    within the sample that the lists read are to hold; probes: sample vectors
    on whose neighbours this is measured; prune: ratio of distances within which
    lists are read, measured where None; least: vectors that a query looks at
    at least, beyond the ratio if need be.
    """

    sample: int = 50_000
    per_list: int = 64
    most_lists: int = 8192
    replicas: int = 4
    closure: float = 1.15
    recall: float = 0.99
    probes: int = 512
    prune: float | None = None
    least: int = 512


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0))


def _balanced(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means whose distances carry a charge on clusters above the mean size: centres and each point's cluster."""
    centres = points[rng.permutation(len(points))[:k]].copy()
    charge = np.zeros(k)
    for _ in range(rounds):
        own = (_distances(points, centres) + charge).argmin(1)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        used = size > 0
        centres[used] = sums[used] / size[used, None]
        if (~used).any():
            centres[~used] = points[rng.integers(0, len(points), int((~used).sum()))]
        spread = np.linalg.norm(points - centres[own], axis=1).mean()
        charge = 0.1 * spread * np.clip(size / (len(points) / k) - 1, 0, 4)
    return centres, (_distances(points, centres) + charge).argmin(1)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5, fan: int = 24) -> np.ndarray:
    """About k centres, each the nearest of near equally many points.

    Balanced k-means splits again and again into `fan` parts at most, so that
    few points meet all centres.  Then points go to their nearest centre a few
    times, centres of more than twice the mean size are split and those of less
    than an eighth of it go.
    """
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    done, open_ = [], [(sample, k)]
    while open_:
        points, want = open_.pop()
        if want >= len(points):
            done.append(points)
        elif want <= fan:
            done.append(_balanced(points, want, rounds, rng)[0])
        else:
            own = _balanced(points, fan, rounds, rng)[1]
            for c in np.unique(own):
                part = points[own == c]
                open_.append((part, max(1, round(len(part) * want / len(points)))))
    centres, mean = np.concatenate(done), len(sample) / k
    for _ in range(4 if k > 1 else 0):
        own = np.concatenate([_distances(sample[a : a + 512], centres).argmin(1) for a in range(0, len(sample), 512)])
        order = np.argsort(own, kind="stable")
        done = []
        for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(at) > 2 * mean:
                done.append(_balanced(sample[at], min(len(at), round(len(at) / mean)), rounds, rng)[0])
            elif len(at) >= mean / 8:
                done.append(sample[at].mean(0)[None])
        centres = np.concatenate(done)
    return centres


class Centroids:
    """Centroids, the graph that is walked to find those near a vector, and the rules by which vectors and queries take lists."""

    def __init__(self, centres: np.ndarray, degree: int = 24, sample: np.ndarray | None = None, replicas: int = 4, closure: float = 1.15, prune: float = 1.35):
        self.centres, self.replicas, self.closure, self.prune = centres, replicas, closure, prune
        k = len(centres)
        self.near = np.empty((k, min(degree, k)), np.int64)
        for a in range(0, k, 1024):
            d = _distances(centres[a : a + 1024], centres)
            self.near[a : a + 1024] = np.argpartition(d, self.near.shape[1] - 1, axis=1)[:, : self.near.shape[1]]
        rng = np.random.default_rng(9)
        # entries spread over the graph, in numbers that grow with its root
        self.entry = np.sort(rng.permutation(k)[: max(1, min(k, 2 * math.isqrt(k)))])
        some = centres[:0] if sample is None else sample
        near = [self.walk(some[a : a + 256], 16)[1][:, 0] for a in range(0, len(some), 256)]
        self.spread = float(np.concatenate(near).mean()) if near else 0.0

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of `q` the nearest `beam` centroids found, nearest first, and their distances: best-first search, all rows in step.

        Rows that find fewer are filled up with -1 at an infinite distance.
        Where the beam is a large part of all centroids, all are looked at.
        """
        k, n = len(self.centres), len(q)
        beam = min(beam, k)
        if 4 * beam >= k:
            d = _distances(q, self.centres)
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            return order, np.take_along_axis(d, order, 1)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k + 1), bool)
        seen[:, self.entry] = seen[:, k] = True
        ids, d = np.tile(self.entry, (n, 1)), _distances(q, self.centres[self.entry])
        if ids.shape[1] < beam:
            gap = beam - ids.shape[1]
            ids, d = np.pad(ids, ((0, 0), (0, gap)), constant_values=-1), np.pad(d, ((0, 0), (0, gap)), constant_values=np.inf)
        best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
        ids, d = ids[rows, best], d[rows, best]
        fresh = ids >= 0
        step = min(4, beam)
        while True:
            at = np.argpartition(np.where(fresh, d, np.inf), step - 1, axis=1)[:, :step]
            go = fresh[rows, at]
            if not go.any():
                break
            fresh[rows, at] = False
            new = np.where(go[:, :, None], self.near[np.maximum(ids[rows, at], 0)], k).reshape(n, -1)
            new.sort(axis=1)
            first = ~seen[rows, new]
            first[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] = True
            found = np.full(new.shape, np.inf)
            r, c = np.nonzero(first)
            found[r, c] = np.linalg.norm(self.centres[new[r, c]] - q[r], axis=1)
            ids, d = np.concatenate([ids, np.where(first, new, -1)], 1), np.concatenate([d, found], 1)
            fresh = np.concatenate([fresh, first], 1)
            best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            ids, d, fresh = ids[rows, best], d[rows, best], fresh[rows, best]
        order = np.lexsort((ids, d), axis=1)
        return ids[rows, order], d[rows, order]

    def read(self, q: np.ndarray, own: np.ndarray, least: int) -> list[np.ndarray]:
        """Lists that each row of `q` reads, nearest first: all within the ratio, and more until they are the nearest list of `least` vectors.

        `own` has the number of vectors that each list is the nearest of.  A
        walk whose beam ends within the ratio is walked again with a wider one,
        up to all centroids, so no list within the ratio is left out for want
        of a beam.
        """
        out: list = [None] * len(q)
        todo, beam = np.arange(len(q)), 64
        held = np.append(own, 0)
        while len(todo):
            left = []
            for a in range(0, len(todo), 64):
                some = todo[a : a + 64]
                ids, d = self.walk(q[some], beam)
                within = (d <= self.prune * np.maximum(d[:, :1], self.spread) + 1e-12).sum(1)
                enough = (np.cumsum(held[ids], axis=1) < least).sum(1) + 1
                for i, near, many in zip(some, ids, np.maximum(within, enough)):
                    if many < len(near) or len(near) == len(self.centres):
                        out[i] = near[:many]
                    else:
                        left.append(i)
            todo, beam = np.array(left, np.int64), 4 * beam
        return out

    def posts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each vector, and which of them count: the nearest, and others within the ratio that are not behind one taken."""
        lists, taken = [np.zeros((0, 1), np.int64)], [np.zeros((0, 1), bool)]
        for a in range(0, len(vectors), 512):
            ids, d = self.walk(vectors[a : a + 512], 32)
            ids, d = ids[:, : 4 * self.replicas], d[:, : 4 * self.replicas]
            c = self.centres[np.maximum(ids, 0)]
            norm = (c * c).sum(2)
            apart = np.sqrt(np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * c @ c.transpose(0, 2, 1), 0))
            use = np.zeros(ids.shape, bool)
            use[:, 0] = True
            for j in range(1, ids.shape[1]):
                behind = (use[:, :j] & (apart[:, j, :j] <= 0.6 * d[:, j : j + 1])).any(1)
                use[:, j] = (ids[:, j] >= 0) & (d[:, j] <= self.closure * d[:, 0] + 1e-12) & (use.sum(1) < self.replicas) & ~behind
            lists.append(ids)
            taken.append(use)
        width = max(x.shape[1] for x in lists)
        pad = lambda x, fill: np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=fill)
        return np.concatenate([pad(x, -1) for x in lists]), np.concatenate([pad(x, False) for x in taken])


def fitted(sample: np.ndarray, lists: int, k: int, s: Settings = Settings()) -> Centroids:
    """Centroids over distinct sample vectors, with the ratio at which lists hold the wanted share of the `k` nearest."""
    index = Centroids(balanced_centroids(sample, lists), sample=sample, replicas=s.replicas, closure=s.closure, prune=s.prune or 1.0)
    if s.prune is None and len(sample) > 1:
        probe = np.random.default_rng(11).permutation(len(sample))[: s.probes]
        needed = []
        for a in range(0, len(probe), 64):
            own = probe[a : a + 64]
            d = _distances(sample[own], sample)
            d[np.arange(len(own)), own] = np.inf
            near = np.argpartition(d, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
            to_list = _distances(sample[own], index.centres)
            lists_, use = index.posts(sample[near.ravel()])
            reach = np.where(use, to_list[np.repeat(np.arange(len(own)), near.shape[1])[:, None], np.maximum(lists_, 0)], np.inf).min(1)
            needed.append(reach / np.maximum(np.repeat(np.maximum(to_list.min(1), index.spread), near.shape[1]), 1e-300))
        index.prune = max(1.0, float(np.quantile(np.concatenate(needed), s.recall, method="higher")) + 1e-9)
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame, vector_col: str, dim: int | None = None):
    """Vectors with components, all of them finite and not all zero, of the commonest length."""
    v = F.col(vector_col)
    good = (
        v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.where(good & (F.size(v) == dim) if dim else good)


def nearest(
    vectors: DataFrame, queries: str, k: int = 10, settings: Settings = Settings(),
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each row that the SQL predicate `queries` over vec_id names.

    score is the Euclidean distance in double precision, ties go to the smaller
    id, and a query's own row is no candidate.  Null vectors, vectors with null
    or non-finite components and zero vectors take no part, as do rows without
    an id; of vectors of several lengths those of the commonest length do.
    Repeated rows of an id count once (the least vector of the id).
    """
    spark = vectors.sparkSession
    given = usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")), "v").where("vec_id is not null")
    sizes = given.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    given = given.where(F.size("v") == sizes["dim"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    given = cut(given)
    count = given.count()
    sample = given.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(settings.sample).select("v").toPandas()
    matrix = np.unique(np.array(sample["v"].tolist()), axis=0)
    lists = max(1, min(settings.most_lists, len(matrix), round(count / settings.per_list)))
    # at most most_lists vectors, whatever the input
    index = spark.sparkContext.broadcast(fitted(matrix, lists, k, settings))
    lists = len(index.value.centres)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                posts, use = index.value.posts(_matrix(batch.column(1)))
                row, at = np.nonzero(use)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(posts[row, at]), batch.column(0).take(of), batch.column(1).take(of), pa.array(at == 0)], ["list", "vec_id", "v", "nearest"]
                )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                # the query itself is one of the vectors
                chosen = index.value.read(_matrix(part.column(1)), own, max(k + 1, settings.least))
                row = pa.array(np.repeat(np.arange(len(part)), [len(c) for c in chosen]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(chosen)), part.column(0).take(row), part.column(1).take(row)], ["list", "vec_id", "v"]
                )

    kind = "list long, vec_id long, v array<double>"
    posted = cut(given.mapInArrow(post, kind + ", nearest boolean"))
    # at most most_lists rows
    own = np.zeros(lists, np.int64)
    for r in posted.where("nearest").groupBy("list").count().collect():
        own[r["list"]] = r["count"]
    asked = given.where(queries).mapInArrow(choose, kind)
    cells = posted.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    # queries go to every part of a list, in blocks; vectors to every block of queries that the list has
    asked = cut(asked.withColumn("is_query", F.lit(True)))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("blocks"))
    plan = cells.join(blocks, "list")
    q = asked.join(plan, "list").select(
        "list", "vec_id", "v", F.lit(True).alias("is_query"), F.pmod(F.xxhash64("vec_id", F.lit(2)), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    p = posted.join(plan, "list").select(
        "list", "vec_id", "v", F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit(3)), "parts").cast("int").alias("part"),
    )
    met = (
        q.select("list", "part", "block", "is_query", "vec_id", "v").unionByName(p)
        .select("list", "part", "block", "is_query", "vec_id", "v")
        .repartition(parts(spark), "list", "part", "block")
        .sortWithinPartitions("list", "part", "block", "is_query", "vec_id")
    )
    local = met.mapInArrow(_meet(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        local.dropDuplicates(["query_id", "vec_id"])
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _meet(k: int):
    """The k nearest of each query among the vectors of one part of a list; rows arrive sorted, vectors before queries."""

    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        is_query = table["is_query"].to_numpy()
        ids, v = table["vec_id"].to_numpy(), _matrix(table["v"].combine_chunks())
        own, vectors = ids[~is_query], v[~is_query]
        if not len(own) or not is_query.any():
            return
        out: list = [[], [], []]
        asked = v[is_query]
        with np.errstate(all="ignore"):
            norms = (asked * asked).sum(1)[:, None] + (vectors * vectors).sum(1)
            rough = norms - 2 * asked @ vectors.T
            # far above what rounding can do to a product; where numbers are too large for it, all are candidates
            off = 1e-12 * len(vectors[0]) * norms
            low = np.where(np.isfinite(rough) & np.isfinite(off), rough - off, -np.inf)
            high = np.where(np.isfinite(low), rough + off, np.inf)
        for query_id, q, least, most in zip(ids[is_query], asked, low, high):
            ok = np.flatnonzero(own != query_id)
            if len(ok) > k:
                ok = ok[least[ok] <= np.partition(most[ok], k - 1)[k - 1]]
            # squares summed from the first component to the last, so that every engine gets the same double
            d = vectors[ok] - q
            d = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
            order = np.lexsort((own[ok], d))[:k]
            ok, d = ok[order], d[order]
            for column, values in zip(out, (np.full(len(ok), query_id), own[ok], d)):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            change = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(keys)]):
                if b > a:
                    if key != tuple(keys[a]):
                        if held:
                            yield from group(held)
                        key, held = tuple(keys[a]), []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from group(held)

    return run
