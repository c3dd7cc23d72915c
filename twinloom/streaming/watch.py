"""Incremental ingestion with Structured Streaming, and the sweeps that a file source can't do (removals, backlog order).

The stream's source reports new files once; each micro-batch is joined to what waits in the pending table, settled files go on to the
batch pipeline and unsettled ones wait there for a later batch (`debounced`). State is what is stored, so a batch that is run again
changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store, create_once


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that hands each micro-batch to `handle`; an error in one batch is the query's error, and the batch is run
    again after a restart. trigger: as of writeStream.trigger; by default all that is there, then stop."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def file_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 4, newest_first: bool = True, kind: str = "parquet") -> DataFrame:
    """New files of a folder (or the one file of that name), newest first, at most per_batch a micro-batch."""
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_batch).option("latestFirst", str(newest_first).lower())
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where) and fs.getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).load(where.getParent().toString())
    return reader.load(folder)


def fast_lane(events: DataFrame, path: str = "path", ts: str = "ts") -> DataFrame:
    """Paths of change events, the newest event first; a repeated event moves its path to the front."""
    return events.groupBy(path).agg(F.max(ts).alias(ts)).orderBy(F.desc(ts), path)


def backlog(listing: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The next n paths that are not done, the oldest first."""
    return listing.join(done.select("path"), "path", "left_anti").orderBy("mtime", "path").limit(n)


def settled(rows: DataFrame, now: float, settle: float) -> tuple[DataFrame, DataFrame]:
    """(files that are no longer being written, files that wait)."""
    ready = F.lit(now) - F.col("mtime") >= settle
    return rows.filter(ready), rows.filter(~ready)


def debounced(store: Store, arrived: DataFrame, listing: DataFrame, now: float, settle: float) -> DataFrame:
    """Files that are ready among those that arrived and those that wait. The others wait in the pending table with what the listing
    says of them now; files that are no longer listed are dropped."""
    from ..sources.scratch import materialise

    waiting = store.read("pending")
    both = arrived.select("path").union(waiting.select("path")).distinct()
    known = waiting.select("path", "seen_at")
    rows = materialise(both.join(listing.select("path", "mtime", "size"), "path").join(known, "path", "left"), "debounced")
    ready, wait = settled(rows, now, settle)
    store.replace("pending", wait.select("path", "mtime", "size", F.coalesce("seen_at", F.lit(float(now))).alias("seen_at")))
    return ready.select("path", "mtime", "size")


class Discovery:
    """When the tree is listed again: at the start, when the backlog is used up, and every `every` seconds; never for each chunk."""

    def __init__(self, every: float = 300.0) -> None:
        self.every, self.last = every, None

    def due(self, now: float, left: int) -> bool:
        if self.last is None or left <= 0 or now - self.last >= self.every:
            self.last = now
            return True
        return False


def routed(events: DataFrame) -> DataFrame:
    """(path, ts, action): created and modified files are changed, deleted ones deleted, moved ones both; folders are ignored."""
    rows = events.filter("not is_directory")
    kind = F.when(F.col("event") == "moved", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("action")), F.struct(F.col("dest").alias("path"), F.lit("changed").alias("action"))))
    kind = kind.when(F.col("event") == "deleted", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("action"))))
    kind = kind.otherwise(F.array(F.struct(F.col("path").alias("path"), F.lit("changed").alias("action"))))
    return rows.select("ts", F.explode(kind).alias("e")).select("e.path", "ts", "e.action")


def removals(deleted: DataFrame, stored: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """Stored paths to forget: deleted ones that are indeed gone, and orphans of the sweep."""
    from ..operators.store import orphans

    gone = stored.select("path").join(deleted.select("path").distinct(), "path", "left_semi").join(listing.select("path"), "path", "left_anti")
    return gone.union(orphans(stored, listing, roots)).distinct()


def idle_waits(first: float = 30.0, most: float = 1800.0) -> Iterator[float]:
    """Waits between idle cycles: doubled up to the most."""
    wait = first
    while True:
        yield wait
        wait = min(most, wait * 2)


def watch(cycle: Callable[[bool], bool], stop: Callable[[], bool], busy: Callable[[], bool] = lambda: False, sweep_every: int = 30, sleep: Callable[[float], None] = time.sleep, log: Callable[[str], None] = print) -> None:
    """Runs cycles until stopped. cycle(sweep) returns whether it found work; a sweep is due at the start and every sweep_every
    idle cycles, but never after a busy one; a cycle that fails is reported and the next one goes on; while another job is busy
    nothing heavy starts."""
    waits, idle, sweep = idle_waits(), 0, True
    while not stop():
        if not busy():
            try:
                worked = cycle(sweep)
            except Exception as e:  # one bad cycle must not end the watch
                log(f"cycle failed: {type(e).__name__}: {e}")
                worked = False
            idle = 0 if worked else idle + 1
            sweep = not worked and idle % sweep_every == 0
            if worked:
                waits = idle_waits()
                continue
        sleep(next(waits))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Event-time counts and sums per window and type, with a watermark for late rows; the same plan for batch and stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


class PriorityLock:
    """Lets a heavy job take precedence over the watcher: numbered files in a shared folder, of which the highest says who holds the
    lock and until when. Taking, renewing and releasing all add the next number, which only one of several owners can; nothing is
    deleted to take it. A lock whose time is over is free, so a job that died holds nothing up for longer than `ttl` seconds."""

    def __init__(self, spark: SparkSession, path: str, owner: str, ttl: float = 3600.0, now: Callable[[], float] = time.time) -> None:
        self.spark, self.owner, self.ttl, self.now = spark, owner, ttl, now
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, str, float]:
        """(number, owner, until) of the highest entry; (0, '', 0) if there is none. One that is still being written counts as held
        by its unknown owner for as long as this one's ttl, from when it appeared."""
        if not self.fs.exists(self.path):
            return 0, "", 0.0
        found = [x for x in self.fs.listStatus(self.path) if x.getPath().getName().isdigit()]
        if not found:
            return 0, "", 0.0
        last = max(found, key=lambda x: int(x.getPath().getName()))
        number = int(last.getPath().getName())
        if not last.getLen():
            return number, "?", last.getModificationTime() / 1000 + self.ttl
        stream = self.fs.open(last.getPath())
        owner, _, until = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode().rpartition(" ")
        stream.close()
        return number, owner, float(until)

    def _add(self, number: int, until: float) -> bool:
        self.fs.mkdirs(self.path)
        name = self.spark._jvm.org.apache.hadoop.fs.Path(self.path, f"{number:012d}")
        if not create_once(self.spark, self.fs, name, f"{self.owner} {until}"):
            return False
        for status in self.fs.listStatus(self.path):  # what is far behind decides nothing any more
            if status.getPath().getName().isdigit() and int(status.getPath().getName()) < number - 8:
                self.fs.delete(status.getPath(), False)
        return True

    def holder(self) -> str | None:
        _, owner, until = self._last()
        return owner if until > self.now() else None

    def acquire(self) -> bool:
        """Takes or renews the lock; false if another owner holds it or was faster."""
        number, owner, until = self._last()
        if until > self.now() and owner != self.owner:
            return False
        return self._add(number + 1, self.now() + self.ttl)

    def release(self) -> None:
        number, owner, until = self._last()
        if owner == self.owner and until > self.now():
            self._add(number + 1, 0.0)

    def busy(self) -> bool:
        """Whether another owner holds the lock: what the watcher asks before heavy work."""
        return self.holder() not in (None, self.owner)
