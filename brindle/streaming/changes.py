"""Streams of change events, sessions and caches.

Every function takes a batch or a streaming DataFrame alike, unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar as s
from ..sources.tree import included

CHANGES = ("add", "change", "unlink", "addDir", "unlinkDir")


def accepted(events: DataFrame, extensions: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Events of known kinds whose path passes the filters; folders pass without an extension."""
    folder = F.col("change").isin("addDir", "unlinkDir")
    return events.where(F.col("change").isin(*CHANGES)).where((folder & included(F.col("path"), (), (), exclude)) | included(F.col("path"), extensions, (), exclude))


def debounced(events: DataFrame, gap: str = "300 milliseconds", delay: str | None = None) -> DataFrame:
    """(path, started, ended, change): the last change of every burst of a path; `delay` is the watermark of a stream."""
    if delay:
        events = events.withWatermark("ts", delay)
    grouped = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("change", F.struct("ts", "change")).alias("change"))
    return grouped.select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "change")


def tumbling(events: DataFrame, width: str, key: str, delay: str | None = None) -> DataFrame:
    if delay:
        events = events.withWatermark("ts", delay)
    return events.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), key, "n")


def sessions(events: DataFrame, key: str, idle: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """(key, started, ended, n): runs of events less than `idle` apart."""
    if delay:
        events = events.withWatermark("ts", delay)
    grouped = events.groupBy(key, F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return grouped.select(key, F.col("w.start").alias("started"), "ended", "n")


def type_stats(events: DataFrame, kind: str, value: str) -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max("ts").alias("last_ts"))


def by_priority(events: DataFrame) -> DataFrame:
    """Batch: the order in which a priority queue gives events out, numbered within each type's lane."""
    return events.withColumn("place", F.row_number().over(W.partitionBy("type").orderBy(F.desc("priority"), "ts", "id")))


def folded(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Batch: `current` (path, ts) after `changes`: add and change upsert, unlink deletes, unlinkDir deletes all below.

    Only the last change of a path counts; deleted folders that came before it do not matter.
    """
    last = changes.groupBy("path").agg(F.max_by("change", F.struct("ts", "change")).alias("change"), F.max("ts").alias("ts"))
    gone_dirs = last.where("change = 'unlinkDir'").select(F.col("path").alias("dir"), F.col("ts").alias("gone"))
    upserts = last.where("change in ('add', 'change')").select("path", "ts")
    rest = current.join(last.where("change in ('add', 'change', 'unlink')").select("path"), "path", "left_anti").select("path", "ts").unionByName(upserts)
    # every folder above a path, so that deletion by prefix is an equi-join
    parts = F.split("path", "/")
    above = rest.select("path", "ts", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("dir"))
    dead = above.join(gone_dirs, "dir").where("ts <= gone").select("path").distinct()
    return rest.join(dead, "path", "left_anti")


def start_index(events: DataFrame, merge, checkpoint: str, trigger: dict | None = None):
    """Streaming: calls `merge(batch, id)` with the last change of each path of every micro-batch; returns the query.

    Stopping and starting again with the same checkpoint loses no event.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("change", F.struct("ts", "change")).alias("change"), F.max("ts").alias("ts"))
        merge(last, batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Watch:
    """An index kept up to date from a stream, which can be paused: a pause stops the query, resuming goes on from its checkpoint.

    `events` makes the streaming DataFrame anew each time; what arrives during a
    pause is read afterwards, none is lost.
    """

    def __init__(self, events, merge, checkpoint: str):
        self.events, self.merge, self.checkpoint, self.query, self.batches = events, merge, checkpoint, None, 0

    def _each(self, batch: DataFrame, batch_id: int) -> None:
        self.merge(batch, batch_id)
        self.batches += 1

    def resume(self, interval: str = "1 second") -> None:
        if not self.active:
            self.query = start_index(self.events(), self._each, self.checkpoint, {"processingTime": interval})

    def pause(self) -> None:
        if self.active:
            self.query.stop()
            self.query.awaitTermination()

    def flush(self) -> None:
        """Works all that is there, then goes on if it was going."""
        going = self.active
        self.pause()
        start_index(self.events(), self._each, self.checkpoint).awaitTermination()
        if going:
            self.resume()

    @property
    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    def status(self) -> dict:
        return {"active": self.active, "batches": self.batches, "checkpoint": self.checkpoint}


class Caches:
    """Named DataFrames kept by the session, each computed once; the driver holds names and counts only."""

    def __init__(self):
        self.held: dict[str, DataFrame] = {}
        self.hits: dict[str, int] = {}
        self.misses: dict[str, int] = {}

    def get(self, name: str, make) -> DataFrame:
        if name in self.held:
            self.hits[name] = self.hits.get(name, 0) + 1
        else:
            self.misses[name] = self.misses.get(name, 0) + 1
            self.held[name] = make().persist()
        return self.held[name]

    def warm_up(self, makers: dict) -> None:
        for name, make in makers.items():
            self.get(name, make).count()

    def invalidate(self, prefix: str = "") -> list[str]:
        """Gives up all whose name begins with the prefix; returns their names."""
        gone = [n for n in self.held if n.startswith(prefix)]
        for name in gone:
            self.held.pop(name).unpersist()
        return gone

    def stats(self) -> list[tuple[str, int, int, bool]]:
        """(name, hits, misses, held) of all names asked for."""
        return [(n, self.hits.get(n, 0), self.misses.get(n, 0), n in self.held) for n in sorted({*self.hits, *self.misses})]


def capped_history(events: DataFrame, key: str, most: int = 1000, tie: str = "event_id") -> DataFrame:
    """Batch: the newest `most` events of each key."""
    order = W.partitionBy(key).orderBy(F.desc("ts"), F.desc(tie))
    return events.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= most)


def as_of(events: DataFrame, key: str, when, tie: str = "event_id") -> DataFrame:
    """Batch: the last event of each key at a time."""
    seen = events.where(F.col("ts") <= F.lit(when))
    return seen.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct("ts", tie)).alias("e")).select(key, "e.*")


def expired(sessions_: DataFrame, now, idle_seconds: int = 1800) -> DataFrame:
    """Sessions that have been idle too long at `now`."""
    return sessions_.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ended") >= idle_seconds)


def state_health(sessions_: DataFrame, bytes_used: Column, now) -> DataFrame:
    """(total, idle, warnings): more than 1000 sessions, more than 100 MB, or any expired one."""
    idle = F.count_if(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ended") >= 1800)
    row = sessions_.agg(F.count("*").alias("total"), idle.alias("idle"), F.sum(bytes_used).alias("bytes"))
    warnings = F.array(
        F.when(F.col("total") > 1000, "too many sessions"), F.when(F.col("bytes") > 100 * 1024 * 1024, "too much memory"), F.when(F.col("idle") > 0, "expired sessions"),
    )
    return row.withColumn("warnings", F.filter(warnings, lambda x: x.isNotNull()))


# --- caches: the algebra of their statistics

def cache_health(hits: Column, misses: Column, bytes_used: Column, millis: Column, evictions: Column) -> Column:
    """Up to 40 for hits, 30 for little memory (of 50 MB), 20 for quick access and 10 for few evictions."""
    total = hits + misses
    return (
        s.ratio(hits, total) * 40 + F.greatest(F.lit(0.0), 30 - 30 * (bytes_used / F.lit(50.0 * 1024 * 1024)))
        + F.greatest(F.lit(0.0), 20 - F.least(millis / 10, F.lit(20.0))) + F.greatest(F.lit(0.0), 10 - 100 * s.ratio(evictions, total))
    )


def merge_cache_stats(stats: DataFrame) -> DataFrame:
    """One row for all caches: sums, and mean access time by accesses."""
    return stats.agg(
        F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("evictions").alias("evictions"), F.sum("bytes").alias("bytes"),
        s.ratio(F.sum(F.col("millis") * (F.col("hits") + F.col("misses"))), F.sum(F.col("hits") + F.col("misses"))).alias("millis"),
    )


def evicted(items: DataFrame, policy: str, count: int, now=None) -> DataFrame:
    """The `count` items (key, created, accessed, uses, expires) that a policy gives up: lru, lfu, fifo, ttl or random."""
    order = {"lru": ["accessed"], "lfu": ["uses", "accessed"], "fifo": ["created"], "ttl": ["expires"], "random": [F.xxhash64("key")]}[policy]
    if policy == "ttl":
        items = items.where(F.col("expires") <= F.lit(now))
    return items.orderBy(*order, "key").limit(count)


def error_stats(errors: DataFrame, most_recent: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by module and type, and the most recent errors."""
    return errors.groupBy("module", "type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")), errors.orderBy(F.desc("ts"), "module", "type").limit(most_recent)


def backoff_millis(attempt: Column, base: int = 1000, kind: str = "exponential", most: int = 30_000) -> Column:
    return F.least(F.lit(most), base * attempt if kind == "linear" else base * F.pow(F.lit(2.0), attempt - 1)).cast("long")
