"""The table store, sources and sinks, and the watcher."""

import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from twinloom.operators.store import Store, pruned_singletons, repaired, states, touching, valid_overrides, with_keep
from twinloom.sources import media
from twinloom.streaming import watch


def files(spark, *paths):
    return spark.createDataFrame([(p, 123.456, 999, "h" + p, "v1", [0, 1, 2**31, 2**32 - 1]) for p in paths], "path string, mtime double, size bigint, content_hash string, feature_version string, audio_fp array<bigint>")


def test_round_trip_and_upsert(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("files").count() == 0
    s.save_files(files(spark, "a", "b"))
    s.upsert("matches", spark.createDataFrame([("a", "b", "CERTAIN"), ("b", "c", "HIGH")], "a string, b string, verdict string"))
    s.upsert("files", files(spark, "b", "c").withColumn("size", F.lit(5)))
    got = {r.path: (r.size, r.audio_fp, r.mtime) for r in s.read("files").collect()}
    assert got["a"] == (999, [0, 1, 2**31, 2**32 - 1], 123.456) and got["b"][0] == got["c"][0] == 5
    assert s.read("matches").count() == 2 and touching(s.read("matches"), files(spark, "c")).count() == 1
    s.save_files(files(spark, "c"))  # saving a file voids its matches
    assert [(r.a, r.b) for r in s.read("matches").collect()] == [("a", "b")]
    s.forget(files(spark, "a").select("path"))
    assert s.read("matches").count() == 0 and {r.path for r in s.read("files").collect()} == {"b", "c"}


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.replace("files", files(spark, "a"))
    with pytest.raises(Exception):
        s.replace("files", files(spark, "b").withColumn("size", F.raise_error(F.lit("boom")).cast("bigint")))
    assert [r.path for r in s.read("files").collect()] == ["a"]


def test_a_crash_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    """Between the steps of a write, and after a failure there, readers see the old version; a lazy reader goes on with its own."""
    from twinloom.operators import store as module

    s = Store(spark, str(tmp_path))
    s.replace("files", files(spark, "a"))
    lazy = s.read("files")

    def dies(*_):
        assert [r.path for r in s.read("files").collect()] == ["a"]
        raise OSError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(module, "create_once", dies)
        with pytest.raises(OSError):
            s.replace("files", files(spark, "b"))
    assert [r.path for r in s.read("files").collect()] == ["a"]
    s.upsert("files", files(spark, "c"))
    assert {r.path for r in s.read("files").collect()} == {"a", "c"} and [r.path for r in lazy.collect()] == ["a"]
    # an empty pointer, of a writer that died while writing it, is passed over by readers and by the next writer
    (tmp_path / "files" / "_versions" / "000000000003").touch()
    assert {r.path for r in s.read("files").collect()} == {"a", "c"}
    with pytest.raises(module.Conflict):  # it may be at it still
        s.replace("files", files(spark, "x"), expected=2)
    monkeypatch.setattr(module, "GRACE_S", 0.0)
    assert s.replace("files", files(spark, "d"), expected=2) == 4
    assert [r.path for r in s.read("files").collect()] == ["d"]
    assert s.sweep("files") == 4 and [r.path for r in s.read("files").collect()] == ["d"] and s.sweep() == 0


def test_of_two_writers_one_wins_and_the_other_tries_again(spark, tmp_path):
    from twinloom.operators.store import Conflict

    s = Store(spark, str(tmp_path))
    s.replace("files", files(spark, "a"))
    seen = s.version("files")
    s.replace("files", files(spark, "b"))
    with pytest.raises(Conflict):
        s.replace("files", files(spark, "c"), expected=seen)
    calls = []

    def plan(old):
        if not calls:
            s.upsert("files", files(spark, "between"))
        calls.append(1)
        return old.unionByName(files(spark, "late"), allowMissingColumns=True)

    s.change("files", plan)
    assert len(calls) == 2 and {r.path for r in s.read("files").collect()} == {"b", "between", "late"}


def test_point_reads_are_pushed_down(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.save_files(files(spark, "a", "b", "c").withColumn("global_vec", F.when(F.col("path") == "b", F.array(F.lit(1.0)))))
    got = s.get("files", "b")
    assert [r.path for r in got.collect()] == ["b"] and "EqualTo(path,b)" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.path for r in s.vectors().collect()] == ["b"]


def test_unsettled_files_wait(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(list(x), "path string, mtime double, size bigint")
    first = rows(("old", 10.0, 1), ("fresh", 95.0, 1), ("gone", 99.0, 1))
    assert [r.path for r in watch.debounced(s, first, first, 100.0, 15.0).collect()] == ["old"]
    assert {r.path for r in s.read("pending").collect()} == {"fresh", "gone"}
    later = rows(("old", 10.0, 1), ("fresh", 104.0, 2))
    assert watch.debounced(s, rows(), later, 110.0, 15.0).count() == 0
    assert [(r.path, r.size, r.seen_at) for r in s.read("pending").collect()] == [("fresh", 2, 100.0)]
    assert [r.path for r in watch.debounced(s, rows(), later, 119.0, 15.0).collect()] == ["fresh"] and s.read("pending").count() == 0


def test_discovery_is_not_repeated_for_each_chunk():
    d = watch.Discovery(every=300)
    assert [d.due(*x) for x in ((0, 0), (10, 5), (20, 0), (319, 3), (320, 3), (321, 3))] == [True, False, True, False, True, False]


def test_ledger_drops_other_fingerprints(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "a string, b string")
    s.add_to_ledger(pairs, "one")
    s.add_to_ledger(pairs.limit(1), "one")
    assert s.ledger("one").count() == 2
    s.add_to_ledger(pairs.limit(1), "two")
    assert s.ledger("one").count() == 0 and s.read("ledger").count() == 1


def test_clusters_and_problems(spark):
    c = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", True)], "cluster_id bigint, path string, is_keep boolean")
    assert {r.path for r in pruned_singletons(c).collect()} == {"a", "b"}
    assert {r.path: r.is_keep for r in with_keep(c, 1, "b").collect()} == {"a": False, "b": True, "c": True}
    p = spark.createDataFrame([("a", "x", 1.0, 1, "corrupt", None), ("b", "x", 1.0, 1, "corrupt", None), ("c", "x", 1.0, 1, "reindex", None)], "path string, error string, mtime double, size bigint, category string, repair_note string")
    out = spark.createDataFrame([("a", True, None), ("b", False, "ffmpeg timed out")], "path string, ok boolean, error string")
    assert {r.path: r.category for r in repaired(p, out).collect()} == {"b": "reindex", "c": "reindex"}


def test_states_and_overrides(spark):
    listing = spark.createDataFrame([("new", 10.0, 1), ("copy", 99.0, 1), ("known", 10.0, 1), ("bad", 10.0, 1)], "path string, mtime double, size bigint")
    stored = spark.createDataFrame([("known", 11.0, 1, "v1")], "path string, mtime double, size bigint, feature_version string")
    problems = spark.createDataFrame([("bad", 10.0, 1), ("new", None, 1)], "path string, mtime double, size bigint")
    names = spark.createDataFrame([(x,) for x in ("new", "copy", "known", "bad", "lost")], "path string")
    got = {r.path: r.state for r in states(listing, stored, problems, names, "v1", 100.0, 15.0, 2.0).collect()}
    assert got == {"new": "pending", "copy": "copying", "known": "done", "bad": "done", "lost": "gone"}
    o = spark.createDataFrame([("known", "audio", 10.5, 1), ("bad", "audio", 50.0, 1), ("lost", "audio", 1.0, 1)], "path string, kind string, mtime double, size bigint")
    assert [r.path for r in valid_overrides(o, listing, 2.0).collect()] == ["known"]


def test_listing_and_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mkv", "b.MP4", "c.txt", "sub/d.avi"):
        (tmp_path / name).write_bytes(b"x" * 10)
    names = lambda d: sorted(r.path.rsplit("/", 1)[1] for r in d.collect())
    assert names(media.listing(spark, [str(tmp_path), str(tmp_path / "none")])) == ["a.mkv", "b.MP4", "d.avi"]
    assert names(media.listing(spark, [str(tmp_path)], recursive=False)) == ["a.mkv", "b.MP4"]
    assert names(media.listing(spark, [str(tmp_path / "a.mkv"), str(tmp_path / "a.mkv")])) == ["a.mkv"]
    (tmp_path / "l.json").write_text(json.dumps([{"path_a": "x", "path_b": "y", "label": "same"}]))
    (tmp_path / "l.csv").write_text("path_a,path_b,label\nx,y,same\n")
    for f in ("l.json", "l.csv"):
        assert [tuple(r) for r in media.labelled_pairs(spark, str(tmp_path / f)).collect()] == [("x", "y", "same")]
    media.write_report(spark.createDataFrame([("x", 1)], "p string, n int"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().p == "x"


class Sizes:
    version = "1"

    def __call__(self, path):
        if "bad" in path:
            raise ValueError("no frames")
        return {"n": len(path)}


def test_featuriser_reports_errors(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("good",)], "path string")

    def make():
        def extract(path):
            if "bad" in path:
                raise ValueError("no frames")
            return {"n": len(path)}

        return extract

    got = {r.path: (r.n, r.error) for r in media.featurise(df, make, "n int").collect()}
    assert got == {"good": (4, None), "bad": (None, "ValueError: no frames")}


def test_watch_loop():
    calls, waits = [], []
    results = iter([False, True, "fail", False, False])

    def cycle(sweep):
        calls.append(sweep)
        r = next(results)
        if r == "fail":
            raise RuntimeError("x")
        return r

    watch.watch(cycle, stop=lambda: len(calls) == 5, sweep_every=2, sleep=waits.append, log=lambda _: None)
    assert calls == [True, False, False, False, True] and waits == [30.0, 30.0, 60.0, 120.0]
    assert list(itertools.islice(watch.idle_waits(30, 100), 4)) == [30, 60, 100, 100]


def test_stream_is_idempotent_and_newest_first(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"p{i}", float(i))], "path string, mtime double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = watch.file_stream(spark, str(tmp_path / "in"), "path string, mtime double", per_batch=1)
    for _ in range(2):
        watch.ingest(stream, lambda df, n: seen.append((n, [r.path for r in df.collect()])), str(tmp_path / "state")).awaitTermination()
    assert sorted(p for _, ps in seen for p in ps) == ["p0", "p1", "p2"] and len(seen) == 3


def test_windows_with_late_rows(spark, tmp_path):
    row = lambda h, v: (f"2024-01-01 {h}:00:00", "view", v)
    ddl = "ts timestamp, event_type string, value double"
    for i, part in enumerate([[row("01", 1.0)], [row("09", 1.0)], [row("10", 1.0)], [row("01", 5.0), row("10", 2.0)]]):
        df = spark.createDataFrame(part, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
        old = set((tmp_path / "in").glob("*.parquet"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - old:
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
    stream = watch.file_stream(spark, str(tmp_path / "in"), ddl, per_batch=1, newest_first=False)
    q = watch.windowed_counts(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "st")).start()
    q.awaitTermination()
    assert {(r.start.hour, r.n) for r in spark.table("late").collect()} == {(1, 1)}  # hour 1's second row comes too late; the others are open


def test_settled_and_removals(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 95.0)], "path string, mtime double")
    ready, waiting = watch.settled(rows, 100.0, 15.0)
    assert [r.path for r in ready.collect()] == ["a"] and [r.path for r in waiting.collect()] == ["b"]
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "path string")
    got = watch.removals(p("/r/a", "/r/b"), p("/r/a", "/r/b", "/r/c", "/off/d"), p("/r/b"), ["/r"])
    assert sorted(r.path for r in got.collect()) == ["/r/a", "/r/c"]


def test_prune_reachable_and_fixes(spark, tmp_path):
    from twinloom.operators.store import prune_missing, quality_fix, reachable, repair_accepted

    s = Store(spark, str(tmp_path / "store"))
    root = str(tmp_path)
    s.save_files(files(spark, f"{root}/a", f"{root}/b", "/offline/c").withColumn("audio_coverage", F.lit(0.4)))
    s.upsert("problems", spark.createDataFrame([(f"{root}/z", "x")], "path string, error string"))
    roots = reachable(spark, [root, "/offline"])
    assert roots == [root]
    listing = spark.createDataFrame([(f"{root}/a",)], "path string")
    assert prune_missing(s, listing, roots) == {"files": 1, "problems": 1}
    assert {r.path for r in s.read("files").collect()} == {f"{root}/a", "/offline/c"}
    quality_fix(s, listing, "override")
    assert [r.path for r in s.read("overrides").collect()] == [f"{root}/a"]
    quality_fix(s, listing, "recheck")
    assert s.read("overrides").count() == 0 and {r.path: r.audio_coverage for r in s.read("files").collect()} == {f"{root}/a": None, "/offline/c": 0.4}
    with pytest.raises(ValueError):
        quality_fix(s, listing, "?")
    got = spark.createDataFrame([(10.0, 12.0), (10.0, 12.1), (1000.0, 1019.0)], "a double, b double").select(repair_accepted(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True]


def test_thresholds_from_files(tmp_path):
    from twinloom import config

    base, own = tmp_path / "base.json", str(tmp_path / "own.json")
    base.write_text('{"theta_v": 0.6, "theta_a": 0.7}')
    assert config.load(str(base), own).theta_v == 0.6
    assert config.save_override(own, theta_v=0.9).theta_v == 0.9
    both = config.load(str(base), own)
    assert (both.theta_v, both.theta_a) == (0.9, 0.7) and config.load("missing") == config.Thresholds()
    with pytest.raises(TypeError):
        config.save_override(own, nonsense=1)
    assert config.load(override=own).theta_v == 0.9


def test_titles_and_deletables(spark):
    from twinloom.functions import scalar as S

    rows = spark.createDataFrame([("/x/B.mkv", ["/x/A.mkv", "/x/B.mkv"]), (None, ["/x/D.mkv", "/x/C.mkv"])], "keep string, members array<string>")
    got = rows.select(S.cluster_title(F.col("keep"), F.col("members")).alias("t"), S.deletable(F.col("members"), F.col("keep")).alias("d")).collect()
    assert [(r.t, r.d) for r in got] == [("B", ["/x/A.mkv"]), ("C", [])]


def test_priority_lock(spark, tmp_path):
    clock = [100.0]
    path = str(tmp_path / "scan.lock")
    scan, watcher = (watch.PriorityLock(spark, path, who, ttl=10, now=lambda: clock[0]) for who in ("scan 1", "watch"))
    assert not watcher.busy() and scan.acquire() and scan.acquire() and watcher.busy() and not scan.busy() and not watcher.acquire()
    watcher.release()
    assert watcher.busy()
    clock[0] = 111.0
    assert not watcher.busy() and watcher.acquire() and scan.busy()
    watcher.release()
    assert not scan.busy()


def test_one_of_two_takers_of_an_expired_lock_wins(spark, tmp_path):
    clock = [100.0]
    a, b = (watch.PriorityLock(spark, str(tmp_path / "lock"), who, ttl=10, now=lambda: clock[0]) for who in "ab")
    assert a.acquire()
    clock[0] = 200.0
    seen = a._last()
    b._last = lambda: seen  # both looked before either took it
    assert a.acquire() and not b.acquire()
    del b._last
    assert b.holder() == "a"


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from twinloom.sources import scratch

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(cluster)


def test_scratch_tables(spark):
    from twinloom.sources.scratch import discard, materialise, scratch_path

    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and spark.sparkContext.applicationId in df.scratch_path
    discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.scratch_path)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_partial_writes(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.save_files(files(spark, "a", "b"))
    s.save_meta(spark.createDataFrame([("a", 7, "new"), ("c", 8, "hc")], "path string, size bigint, content_hash string"))
    got = {r.path: (r.size, r.content_hash, r.audio_fp) for r in s.read("files").collect()}
    assert got["a"][:2] == (7, "new") and len(got["a"][2]) == 4 and got["b"][0] == 999 and got["c"] == (8, "hc", None)
    s.update("files", spark.createDataFrame([("a", 0.25), ("x", 0.5)], "path string, audio_coverage double"), "audio_coverage")
    assert {r.path: r.audio_coverage for r in s.read("files").collect()} == {"a": 0.25, "b": None, "c": None}
    s.upsert("matches", spark.createDataFrame([("a", "b", "PROBABLE"), ("a", "c", "CERTAIN")], "a string, b string, verdict string"))
    assert s.delete("matches", F.col("verdict") == "PROBABLE") == 1 and s.delete("matches", F.col("confidence") > 1) == 0 and s.read("matches").count() == 1
    s.upsert("problems", spark.createDataFrame([("z", "corrupt"), ("y", "corrupt"), ("x", "reindex")], "path string, category string"))
    assert [r.path for r in s.problems("corrupt").collect()] == ["y", "z"]


def test_sql_functions(spark):
    from twinloom.functions import scalar as S
    from twinloom.functions import sql

    assert "base_stem" in sql.register(spark)
    spark.createDataFrame([("movie (1) (2)", 185742.0, "a", "b"), ("x", 59.0, "b", "a"), ("y (2009)", -1.0, None, "c")], "s string, d double, a string, b string").createOrReplaceTempView("sql_rows")
    got = spark.sql("select base_stem(s) s, duration_text(d) d, pair_digest(a, b) p, hamming32(5, 6) h, vector_dot(array(1D, 2D), array(3D, 4D)) v, problem_category('Timed out') c, long_coverage(0.8D, 10D, 20D) l from sql_rows").collect()
    want = spark.table("sql_rows").select(S.base_stem(F.col("s")).alias("s"), S.duration_text(F.col("d")).alias("d"), S.pair_digest(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r.s, r.d, r.p) for r in got] == [(r.s, r.d, r.p) for r in want]
    assert (got[0].h, got[0].v, got[0].c, got[0].l) == (2, 11.0, "reindex", 0.4)
