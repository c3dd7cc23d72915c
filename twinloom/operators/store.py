"""A table store on Parquet: versions of a table side by side, and numbered pointers of which the highest holds.

A write makes a new version's folder and then claims the next number by creating its pointer file, which only one writer can do; the
other gets a `Conflict` and its folder is never seen. Nothing is deleted or renamed when a version is replaced, so there is no moment
without a table, a crash at any step leaves the old version in place, and readers go on with the version that they began with.
Old versions go when `sweep` is called.

Upserts, deletes and replacements are DataFrame plans over the present version; nothing is updated in place. Versions are
sorted by their keys within files, so point reads are pruned by the files' statistics.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema

POINTERS = "_versions"
GRACE_S = 60.0


class Conflict(RuntimeError):
    """Another writer replaced the table meanwhile."""


# --- plans ------------------------------------------------------------------


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given order (descending columns first win)."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys (null keys count as equal)."""
    on = [old[k].eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    gone = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return old.join(gone, cond, "left_anti").unionByName(new)


def touching(matches: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Matches with either end among the paths."""
    own = paths.select(F.col(path).alias("_p")).distinct()
    return matches.join(own, F.col("a") == F.col("_p"), "left_semi").union(matches.join(own, F.col("b") == F.col("_p"), "left_semi")).distinct()


def without_paths(rows: DataFrame, paths: DataFrame, columns: list[str], path: str = "path") -> DataFrame:
    """Rows none of whose columns is among the paths."""
    own = paths.select(F.col(path).alias("_p")).distinct()
    for c in columns:
        rows = rows.join(own, F.col(c) == F.col("_p"), "left_anti")
    return rows


def delete_on_different(matches: DataFrame, decided: DataFrame) -> DataFrame:
    """matches without those pairs that were decided DIFFERENT; decided pairs without a match change nothing."""
    gone = decided.filter("verdict = 'DIFFERENT'").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return matches.join(gone, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def pruned_singletons(clusters: DataFrame) -> DataFrame:
    """clusters without those of fewer than two members."""
    small = clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).filter("n < 2").select("cluster_id")
    return clusters.join(small, "cluster_id", "left_anti")


def with_keep(clusters: DataFrame, cluster_id: int, path) -> DataFrame:
    return clusters.withColumn("is_keep", F.when(F.col("cluster_id") == cluster_id, F.col("path") == path).otherwise(F.col("is_keep")))


def repaired(problems: DataFrame, outcome: DataFrame) -> DataFrame:
    """problems after repair attempts (path, ok, error): repaired ones go; a timeout stays for re-indexing, others are corrupt."""
    from ..functions.scalar import problem_category

    out = problems.join(outcome.select("path", "ok", F.col("error").alias("new_error")), "path", "left").filter("ok is null or not ok")
    return out.select("path", F.coalesce("new_error", "error").alias("error"), "mtime", "size", F.when(F.col("ok").isNull(), F.col("category")).otherwise(problem_category(F.col("new_error"))).alias("category"), F.when(F.col("ok").isNull(), F.col("repair_note")).otherwise(F.col("new_error")).alias("repair_note"))


# --- snapshots --------------------------------------------------------------


def fresh(stored: DataFrame, listing: DataFrame, version: str, tolerance: float) -> DataFrame:
    """listing (path, mtime, size) with `fresh`: stored with about that time, that size and features of the version."""
    old = stored.select("path", F.col("mtime").alias("s_mtime"), F.col("size").alias("s_size"), "feature_version", F.col("has_features") if "has_features" in stored.columns else F.lit(True).alias("has_features"))
    ok = (F.abs(F.col("mtime") - F.col("s_mtime")) <= tolerance) & (F.col("size") == F.col("s_size")) & (F.col("feature_version") == version) & F.col("has_features")
    return listing.join(old, "path", "left").select("path", "mtime", "size", F.coalesce(ok, F.lit(False)).alias("fresh"))


def states(listing: DataFrame, stored: DataFrame, problems: DataFrame, enumerated: DataFrame, version: str, now: float, settle: float, tolerance: float) -> DataFrame:
    """(path, state) of the enumerated paths: gone, copying, done or pending, in that order. A known failure of the same time and
    size is done."""
    own = fresh(stored, listing, version, tolerance)
    bad = problems.select("path", F.col("mtime").alias("p_mtime"), F.col("size").alias("p_size"))
    rows = enumerated.select("path").join(own, "path", "left").join(bad, "path", "left")
    failed = (F.abs(F.col("mtime") - F.col("p_mtime")) <= tolerance) & (F.col("size") == F.col("p_size"))
    state = F.when(F.col("mtime").isNull(), "gone").when(F.lit(now) - F.col("mtime") < settle, "copying").when(F.col("fresh") | F.coalesce(failed, F.lit(False)), "done").otherwise("pending")
    return rows.select("path", state.alias("state"))


def orphans(stored: DataFrame, listing: DataFrame, roots: list[str], offline: list[str] | None = None) -> DataFrame:
    """Stored paths that are gone from a root that can be reached; roots: those that can. offline: mounts below a root that can't be
    reached now, whose files are not known to be gone."""
    from ..functions.scalar import under_root

    reach = F.lit(False)
    for r in roots:
        reach = reach | under_root(F.col("path"), r)
    for mount in offline or ():
        reach = reach & ~under_root(F.col("path"), mount)
    return stored.select("path").filter(reach).join(listing.select(F.lower("path").alias("_l")).distinct(), F.lower("path") == F.col("_l"), "left_anti")


def valid_overrides(overrides: DataFrame, listing: DataFrame, tolerance: float) -> DataFrame:
    """Overrides whose file is still what it was; a file that can't be listed has none."""
    now = listing.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    return overrides.join(now, "path").filter((F.abs(F.col("mtime") - F.col("_m")) <= tolerance) & (F.col("size") == F.col("_s"))).drop("_m", "_s")


def reusable_hashes(stored: DataFrame, listing: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(path, content_hash) that still hold, and the paths to hash; whatever the features' version."""
    old = stored.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), "content_hash")
    rows = listing.join(old, "path", "left").withColumn("ok", F.coalesce((F.abs(F.col("mtime") - F.col("_m")) <= tolerance) & (F.col("size") == F.col("_s")), F.lit(False)))
    return rows.filter("ok").select("path", "content_hash"), rows.filter("not ok").select("path")


def coverage_filled(files: DataFrame, overrides: DataFrame, measured: DataFrame) -> DataFrame:
    """(path, audio_coverage, measure): a valid override counts 1.0, then what is stored, then what was measured; `measure` marks the
    paths that had to be measured, which are those to store."""
    own = overrides.select("path").distinct().withColumn("_o", F.lit(1.0))
    rows = files.select("path", "audio_coverage").join(own, "path", "left").join(measured.select("path", F.col("audio_coverage").alias("_m")), "path", "left")
    return rows.select("path", F.coalesce("_o", "audio_coverage", "_m").alias("audio_coverage"), (F.col("_o").isNull() & F.col("audio_coverage").isNull()).alias("measure"))


# --- tables -----------------------------------------------------------------


def create_once(spark: SparkSession, fs, path, text: str) -> bool:
    """Writes a small file unless there is one; only one of several writers succeeds. On a local disk the file appears with its
    content; elsewhere creation without overwriting is the file system's own exclusive step."""
    if fs.getUri().getScheme() == "file":
        target = path.toUri().getPath()
        part = f"{target}.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(part, target)
        except FileExistsError:
            return False
        finally:
            os.remove(part)
        return True
    try:
        out = fs.create(path, False)
    except Exception:
        if fs.exists(path):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class Store:
    """Tables of schema.TABLES below a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[tuple[int, str, str | None]]:
        """(number, pointer, folder) of all pointers, in order; the folder is None while a pointer is being written."""
        where = self._path(f"{self.root}/{table}/{POINTERS}")
        fs = self._fs(where)
        if not fs.exists(where):
            return []
        out = []
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            if name.isdigit():
                out.append((int(name), status.getPath().toString(), f"{self.root}/{table}/{self._text(fs, status)}" if status.getLen() else None))
        return sorted(out)

    def _text(self, fs, status) -> str:
        stream = fs.open(status.getPath())
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def version(self, table: str) -> int:
        """The number of the present version; 0 if there is none."""
        return max((n for n, _, folder in self._versions(table) if folder), default=0)

    def current(self, table: str) -> str | None:
        """The folder of the present version."""
        found = [folder for _, _, folder in self._versions(table) if folder]
        return found[-1] if found else None

    def read(self, table: str) -> DataFrame:
        now = self.current(table)
        return self.spark.read.schema(schema.TABLES[table]).parquet(now) if now else self.spark.createDataFrame([], schema.TABLES[table])

    def get(self, table: str, *keys: object) -> DataFrame:
        """The rows of one key (or of its first columns): equality filters that Parquet prunes by."""
        rows = self.read(table)
        for column, value in zip(schema.KEYS[table], keys, strict=False):
            rows = rows.filter(F.col(column) == value)
        return rows

    def vectors(self) -> DataFrame:
        """(path, vec) of the stored descriptors; files without one are left out."""
        return self.read("files").filter(F.size("global_vec") > 0).select("path", F.col("global_vec").alias("vec"))

    def replace(self, table: str, rows: DataFrame, expected: int | None = None) -> int:
        """Writes a new version; its number. expected: the version that rows were made from, if another one is to be a conflict."""
        name = f"v-{uuid.uuid4().hex}"
        kinds = dict(self.spark.createDataFrame([], schema.TABLES[table]).dtypes)
        base = expected or 0
        out = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        if schema.KEYS[table]:
            out = out.sortWithinPartitions(*schema.KEYS[table])
        out.write.parquet(f"{self.root}/{table}/{name}")
        found = self._versions(table)
        later = [(pointer, folder) for n, pointer, folder in found if n > base]
        # a pointer without content is another writer's that is at it, or, after GRACE_S, one's that died
        if expected is not None and any(folder or self._age(pointer) < GRACE_S for pointer, folder in later):
            raise Conflict(f"{table}: version {base} is not the present one any more")
        number = max((n for n, _, _ in found), default=0) + 1
        if not self._claim(table, number, name):
            raise Conflict(f"{table}: version {number} is another writer's")
        return number

    def _age(self, pointer: str) -> float:
        path = self._path(pointer)
        return time.time() - self._fs(path).getFileStatus(path).getModificationTime() / 1000

    def _claim(self, table: str, number: int, name: str) -> bool:
        """Creates a pointer if there is none of that number."""
        pointer = self._path(f"{self.root}/{table}/{POINTERS}/{number:012d}")
        fs = self._fs(pointer)
        fs.mkdirs(pointer.getParent())
        return create_once(self.spark, fs, pointer, name)

    def migrate(self) -> list[str]:
        """Brings stored tables to the present columns (new ones are null, others go), and classifies problems anew that no repair was
        tried on; the tables that changed. Nothing is written where nothing changes."""
        from ..functions.scalar import problem_category

        changed = []
        for name, ddl in schema.TABLES.items():
            now = self.current(name)
            if now and self.spark.read.parquet(now).dtypes != self.spark.createDataFrame([], ddl).dtypes:
                self.change(name, lambda old: old)
                changed.append(name)
        problems = self.read("problems")
        stale = F.col("repair_note").isNull() & ~F.col("category").eqNullSafe(problem_category(F.col("error")))
        if not problems.filter(stale).isEmpty():
            self.change("problems", lambda old: old.withColumn("category", F.when(stale, problem_category(F.col("error"))).otherwise(F.col("category"))))
            changed.append("problems")
        return changed

    def sweep(self, table: str | None = None, retain: int = 1, age_s: float = 0.0) -> int:
        """Deletes versions but the last `retain` ones, and folders that no pointer names (of writes that failed), if older than
        age_s, which must exceed what a reader or writer takes; how many folders went."""
        gone = 0
        for name in [table] if table else schema.TABLES:
            where = self._path(f"{self.root}/{name}")
            fs = self._fs(where)
            if not fs.exists(where):
                continue
            kept = [v for v in self._versions(name) if v[2]][-retain:]
            folders, oldest = {v[2].rsplit("/", 1)[1] for v in kept}, min((v[0] for v in kept), default=0)
            for status in fs.listStatus(where):
                folder = status.getPath().getName()
                if folder.startswith("v-") and folder not in folders and status.getModificationTime() / 1000 <= time.time() - age_s:
                    gone += bool(fs.delete(status.getPath(), True))
            for number, pointer, folder in self._versions(name):
                if number < oldest and not (folder and fs.exists(self._path(folder))):
                    fs.delete(self._path(pointer), False)
        return gone

    def change(self, table: str, plan: Callable[[DataFrame], DataFrame], tries: int = 5) -> None:
        """Replaces a table by a plan over its present version; made anew if another writer was faster."""
        for left in range(tries - 1, -1, -1):
            now = self.version(table)
            try:
                self.replace(table, plan(self.read(table)), expected=now)
                return
            except Conflict:
                if not left:
                    raise
                time.sleep(0.2)

    def upsert(self, table: str, rows: DataFrame) -> None:
        kinds = dict(self.spark.createDataFrame([], schema.TABLES[table]).dtypes)
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        keys = schema.KEYS[table]
        self.change(table, lambda old: upserted(old, rows, keys) if keys else old.unionByName(rows))

    def save_files(self, rows: DataFrame) -> None:
        """Upserts files; their problems are cleared and all their matches are void."""
        self.upsert("files", rows)
        self.change("problems", lambda old: without_paths(old, rows, ["path"]))
        self.change("matches", lambda old: without_paths(old, rows, ["a", "b"]))

    def save_meta(self, rows: DataFrame) -> None:
        """Upserts hash and probe of files without touching their other features; for a new path these stay null."""
        own = ["mtime", "size", "content_hash", "probe", "feature_version"]
        old = self.read("files")
        new = rows.select("path", *[F.col(c).alias(f"_{c}") for c in own if c in rows.columns])
        merged = old.join(new, "path", "inner").select(*[F.col(f"_{c}").alias(c) if f"_{c}" in new.columns else F.col(c) for c in old.columns])
        fresh = rows.join(old.select("path"), "path", "left_anti")
        self.upsert("files", merged.unionByName(fresh.select(*[c for c in old.columns if c in rows.columns]), allowMissingColumns=True))

    def delete(self, table: str, condition: Column) -> int:
        """Deletes the rows that meet a condition; how many."""
        rows = self.read(table)
        gone = rows.filter(F.coalesce(condition, F.lit(False))).count()
        if gone:
            self.replace(table, rows.filter(~F.coalesce(condition, F.lit(False))))
        return gone

    def update(self, table: str, rows: DataFrame, column: str) -> None:
        """Sets one column from rows (keys, column); keys that are not in the table are left out."""
        keys = schema.KEYS[table]
        new = rows.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_set"))
        old = self.read(table)
        self.replace(table, old.join(new, keys, "left").withColumn(column, F.when(F.col("_set"), F.col("_new")).otherwise(F.col(column))).select(*old.columns))

    def problems(self, category: str) -> DataFrame:
        return self.read("problems").filter(F.col("category") == category).orderBy("path")

    def forget(self, paths: DataFrame) -> None:
        """Takes paths out of all tables."""
        for table, columns in (("files", ["path"]), ("frames", ["path"]), ("windows", ["path"]), ("matches", ["a", "b"]), ("clusters", ["path"]), ("overrides", ["path"]), ("pending", ["path"])):
            self.change(table, lambda old, columns=columns: without_paths(old, paths, columns))

    def ledger(self, version: str) -> DataFrame:
        """Pairs evaluated under this fingerprint."""
        return self.read("ledger").filter(F.col("fingerprint") == version)

    def add_to_ledger(self, pairs: DataFrame, version: str) -> None:
        """Adds pairs; entries of other fingerprints are dropped."""
        from ..functions.scalar import pair_digest

        new = pairs.select(pair_digest(F.col("a"), F.col("b")).alias("pair_hash"), F.lit(version).alias("fingerprint")).distinct()
        self.change("ledger", lambda old: upserted(old.filter(F.col("fingerprint") == version), new, ["pair_hash"]))


def prune_missing(store: Store, listing: DataFrame, roots: list[str], offline: list[str] | None = None) -> dict[str, int]:
    """Takes files and problems that are gone from reachable roots out of the store; how many of each."""
    from ..sources.scratch import materialise

    counts = {}
    for table in ("files", "problems"):
        gone = materialise(orphans(store.read(table), listing, roots, offline), "gone")
        counts[table] = gone.count()
        if counts[table] and table == "files":
            store.forget(gone)
        elif counts[table]:
            store.replace(table, without_paths(store.read(table), gone, ["path"]))
    return counts


def offline_mounts(missing: DataFrame, root: str, is_dir: Callable[[str], bool], is_mount: Callable[[str], bool], most: int = 10_000) -> list[str] | None:
    """Mounts between a root and missing paths that can't be reached. The folders that missing paths lie in are walked up on the
    driver to the nearest one that is there; None, which says that nothing is known to be gone, if there are more than `most`."""
    folders = missing.select(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1).alias("d")).distinct().limit(most + 1).collect()
    if len(folders) > most:
        return None
    found, seen, root = set(), set(), root.rstrip("/")
    for row in folders:
        at = row["d"]
        while at.startswith(root + "/") and at not in seen and not is_dir(at):
            seen.add(at)
            if is_mount(at):
                found.add(at)
            at = at.rpartition("/")[0]
    return sorted(found)


def reachable(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that can be listed now; what is below the others is not known to be gone."""
    out = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out.append(root)
    return out


def quality_fix(store: Store, paths: DataFrame, mode: str, kind: str = "audio") -> None:
    """What a user decides about a quality warning: `override` (it is fine), `restore` (take that back), `recheck` (measure anew)."""
    own = paths.select("path").distinct()
    if mode == "override":
        store.upsert("overrides", store.read("files").join(own, "path", "left_semi").select("path", F.lit(kind).alias("kind"), "mtime", "size"))
        return
    overrides = store.read("overrides")
    store.replace("overrides", overrides.filter(F.col("kind") == kind).join(own, "path", "left_anti").unionByName(overrides.filter(F.col("kind") != kind)))
    if mode == "recheck":
        files = store.read("files").join(own.withColumn("_again", F.lit(True)), "path", "left")
        store.replace("files", files.withColumn("audio_coverage", F.when(F.col("_again").isNull(), F.col("audio_coverage"))).drop("_again"))
    elif mode != "restore":
        raise ValueError(f"unknown mode {mode}")


def repair_accepted(before: Column, after: Column) -> Column:
    """Whether a remuxed file's duration is the original's, give or take two seconds or 2%."""
    return F.abs(after - before) <= F.greatest(F.lit(2.0), before * 0.02)
