"""Store flows, maintenance and display on the driver's tables; what is written goes to a store in the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import scalar as S
from ..functions import vectors as V
from ..operators import cluster, store
from ..sources import media
from ..sources.scratch import scratch_path
from ..streaming import watch
from .catalog import longs, query, table

TH = Thresholds()


def _store(spark):
    return store.Store(spark, scratch_path(spark, "store"))


_FILES_SQL = "f as (select o_orderkey::varchar as path, (o_orderkey % 1000)::double as mtime, o_custkey as size, 'v' || o_orderkey % 3 as feature_version from orders)"


def files(spark, sf):
    """orders as files."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.cast("string").alias("path"), (k % 1000).cast("double").alias("mtime"), F.col("o_custkey").cast("long").alias("size"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("feature_version"))


_EVENTS_SQL = "p as (select event_id::varchar as path, case event_id % 4 when 0 then 'probe timeout' when 1 then 'broken header' when 2 then 'Timed out' else null end as error, case when event_id % 5 = 0 then 'note' end as repair_note, case when event_id % 4 in (0, 2) then 'reindex' else 'corrupt' end as category from events)"


def problems(spark, sf):
    """events as problem files."""
    k = F.col("event_id")
    error = F.when(k % 4 == 0, "probe timeout").when(k % 4 == 1, "broken header").when(k % 4 == 2, "Timed out")
    return table(spark, sf, "events").select(k.cast("string").alias("path"), error.alias("error"), F.when(k % 5 == 0, "note").alias("repair_note"), S.problem_category(error).alias("category"), F.lit(1.0).alias("mtime"), k.cast("long").alias("size"))


@query(f"with {_FILES_SQL} select path, feature_version, case when path::bigint % 7 = 0 then 1 when path::bigint % 5 = 0 then 2 else 0 end + size as size from f")
def store_upsert(spark, sf):
    """Two upserts and a read of what then stands."""
    s, own = _store(spark), files(spark, sf)
    k = F.col("path").cast("long")
    s.upsert("files", own)
    s.upsert("files", own.filter((k % 5 == 0) | (k % 7 == 0)).withColumn("size", F.col("size") + 2))
    s.upsert("files", own.filter(k % 7 == 0).withColumn("size", F.col("size") + 1))
    return s.read("files").select("path", "feature_version", "size")


@query(f"with {_FILES_SQL} select path, size from f where path = (select min(o_orderkey)::varchar from orders where o_orderkey % 10 = 4)")
def store_point_read(spark, sf):
    s, own = _store(spark), files(spark, sf)
    s.replace("files", own)
    key = own.filter(F.col("path").cast("long") % 10 == 4).agg(F.min(F.col("path").cast("long"))).first()[0]
    return s.get("files", str(key)).select("path", "size")


@query("with m as (select o_orderkey::varchar as a, (o_orderkey + 1 + o_custkey % 5)::varchar as b, o_orderstatus as verdict from orders) select a, b, verdict from m where a::bigint % 9 <> 0 and b::bigint % 9 <> 0")
def save_files_voids(spark, sf):
    """Saving files voids their matches."""
    s, k = _store(spark), F.col("o_orderkey")
    s.replace("matches", table(spark, sf, "orders").select(k.cast("string").alias("a"), (k + 1 + F.col("o_custkey") % 5).cast("string").alias("b"), F.col("o_orderstatus").alias("verdict")))
    ends = s.read("matches").select(F.col("a").alias("path")).union(s.read("matches").select("b")).distinct()
    s.save_files(ends.filter(F.col("path").cast("long") % 9 == 0).select("path", F.lit(1.0).alias("mtime"), F.lit(1).alias("size")))
    return s.read("matches").select("a", "b", "verdict")


@query("with q as (select distinct least(o_orderkey::varchar, (o_orderkey + 1 + o_custkey % 7)::varchar) as a, greatest(o_orderkey::varchar, (o_orderkey + 1 + o_custkey % 7)::varchar) as b, o_orderkey % 2 as half from orders) select sha256(a || chr(31) || b) as pair_hash, 'now' as fingerprint from q where half = 0 union select sha256(a || chr(31) || b), 'now' from q where half = 1")
def ledger_rows(spark, sf):
    """The ledger after two runs under one fingerprint; what another fingerprint entered before is gone."""
    s, k = _store(spark), F.col("o_orderkey")
    pairs = table(spark, sf, "orders").select(k.cast("string").alias("a"), (k + 1 + F.col("o_custkey") % 7).cast("string").alias("b"), (k % 2).alias("half"))
    s.add_to_ledger(pairs.select(F.concat("a", F.lit("x")).alias("a"), "b"), "before")
    s.add_to_ledger(pairs.filter("half = 0"), "now")
    s.add_to_ledger(pairs.filter("half = 1").select(F.col("b").alias("a"), F.col("a").alias("b")), "now")
    return s.read("ledger")


@query(f"with {_EVENTS_SQL} select path, error from p where category = 'reindex'")
def problems_by_category(spark, sf):
    s = _store(spark)
    s.replace("problems", problems(spark, sf))
    return s.problems("reindex").select("path", "error")


@query(f"with {_EVENTS_SQL} select path, case when repair_note is null then category else 'corrupt' end as category from p")
def problems_reclassified(spark, sf):
    """Rows of an older version, all `corrupt`, classified anew; those that a repair was tried on stay as they are."""
    s = _store(spark)
    s.replace("problems", problems(spark, sf).withColumn("category", F.lit("corrupt")))
    s.migrate()
    return s.read("problems").select("path", "category")


@query(f"with {_EVENTS_SQL} select path, case when path::bigint % 3 = 1 then 'corrupt' else category end as category, case when path::bigint % 3 = 1 then 'remux failed' else repair_note end as repair_note from p where path::bigint % 3 <> 0")
def problems_repaired(spark, sf):
    """A third was repaired, a third failed, and the rest was not tried."""
    rows, k = problems(spark, sf), F.col("path").cast("long")
    tried = rows.filter(k % 3 != 2).select("path", (k % 3 == 0).alias("ok"), F.when(k % 3 == 1, "remux failed").alias("error"))
    return store.repaired(rows, tried).select("path", "category", "repair_note")


@query("with c as (select p_size % 50 * 100 + p_partkey % 100 as cluster_id, p_partkey as path from part) select cluster_id, path from c where (select count(*) from c d where d.cluster_id = c.cluster_id) > 1")
def singletons_pruned(spark, sf):
    rows = table(spark, sf, "part").select((F.col("p_size") % 50 * 100 + F.col("p_partkey") % 100).alias("cluster_id"), F.col("p_partkey").alias("path"))
    return store.pruned_singletons(rows)


@query("select p_size as cluster_id, p_partkey as path, case when p_size = 7 then p_partkey = (select min(p_partkey) from part where p_size = 7) else p_partkey % 3 = 0 end as is_keep from part")
def keep_override(spark, sf):
    """A user keeps another copy of one cluster."""
    rows = table(spark, sf, "part").select(F.col("p_size").alias("cluster_id"), F.col("p_partkey").alias("path"), (F.col("p_partkey") % 3 == 0).alias("is_keep"))
    return store.with_keep(rows, 7, rows.filter("cluster_id = 7").agg(F.min("path")).first()[0])


@query(f"with {_FILES_SQL} select path from f where path::bigint % 4 = 0 and not (path::bigint % 8 = 0) and not (path::bigint % 12 = 0)")
def overrides_valid(spark, sf):
    """Overrides hold while their file has about the same time and the same size."""
    own, k = files(spark, sf), F.col("path").cast("long")
    made = own.filter(k % 4 == 0).select("path", F.lit("audio").alias("kind"), (F.col("mtime") + F.when(k % 8 == 0, 9.0).otherwise(1.5)).alias("mtime"), "size")
    now = own.select("path", "mtime", F.when(k % 12 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return store.valid_overrides(made, now, TH.mtime_tolerance_s).select("path")


@query(f"with {_FILES_SQL} select path, case when path::bigint % 6 = 0 then null else (path::bigint % 20) / 20.0::double end as audio_coverage, path::bigint % 6 <> 0 and path::bigint % 4 = 0 as overridden from f")
def quality_fixed(spark, sf):
    """Warnings overridden for a quarter of the files, and a sixth of all measured anew."""
    s, own, k = _store(spark), files(spark, sf), F.col("path").cast("long")
    s.replace("files", own.withColumn("audio_coverage", k % 20 / 20.0))
    store.quality_fix(s, own.filter(k % 4 == 0), "override")
    store.quality_fix(s, own.filter(k % 6 == 0), "recheck")
    held = s.read("overrides").select("path", F.lit(True).alias("overridden"))
    return s.read("files").join(held, "path", "left").select("path", "audio_coverage", F.coalesce("overridden", F.lit(False)).alias("overridden"))


@query(f"with {_FILES_SQL} select path from f where not (path::bigint % 3 = 0 and path::bigint % 5 <> 0 and path::bigint % 7 <> 0)")
def missing_pruned(spark, sf):
    """A third of the files is no longer listed; a fifth lies on a disk that can't be reached, a seventh below a mount that is off."""
    s, own, k = _store(spark), files(spark, sf), F.col("path").cast("long")
    where = F.when(k % 5 == 0, "/off/").when(k % 7 == 0, "/lib/nas/").otherwise("/lib/")
    placed = own.withColumn("path", F.concat(where, "path"))
    s.replace("files", placed)
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    store.prune_missing(s, placed.filter(n % 3 != 0), ["/lib"], ["/lib/nas"])
    return s.read("files").select(F.regexp_extract("path", r"(\d+)$", 1).alias("path"))


@query("with m as (select o_orderkey::varchar as a, o_custkey::varchar as b, o_orderstatus as verdict, (o_orderkey % 10) / 10.0::double as confidence from orders) select a, b, verdict, case when a::bigint % 3 = 0 then 1.0 else confidence end as confidence from m where verdict <> 'P'")
def rows_deleted_and_updated(spark, sf):
    s, o = _store(spark), table(spark, sf, "orders")
    s.replace("matches", o.select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_custkey").cast("string").alias("b"), F.col("o_orderstatus").alias("verdict"), (F.col("o_orderkey") % 10 / 10.0).alias("confidence")))
    s.delete("matches", F.col("verdict") == "P")
    s.update("matches", s.read("matches").filter(F.col("a").cast("long") % 3 == 0).select("a", "b", F.lit(1.0).alias("confidence")), "confidence")
    return s.read("matches").select("a", "b", "verdict", "confidence")


@query(f"with {_FILES_SQL} select path, '/trash/' || path as dest, size from f where path::bigint % 11 = 0")
def deletions_audited(spark, sf):
    from ..engine import Engine

    engine = Engine(spark, scratch_path(spark, "store"))
    engine.store.replace("files", files(spark, sf))
    engine.delete(files(spark, sf).filter(F.col("path").cast("long") % 11 == 0).select("path"), "/trash")
    return engine.store.read("deletions").select("path", "dest", "size")


@query("select label as path, count(*) as n from embeddings group by 1")
def stored_vectors(spark, sf):
    """Descriptors computed once and read from the store."""
    from ..engine import Engine

    engine = Engine(spark, scratch_path(spark, "store"))
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("path"), F.col("vec_id").cast("int").alias("frame_no"), F.lit(0.0).alias("ts"), F.col("embedding").cast("array<float>").alias("vec"))
    engine.store.replace("frames", rows)
    engine.store.replace("files", rows.select("path").distinct())
    engine.describe()
    found = engine.store.vectors().filter(F.abs(V.norm(F.col("vec")) - 1) < 1e-5).join(rows.groupBy("path").agg(F.count("*").alias("n")), "path")
    return found.select(F.col("path").cast(dict(e.dtypes)["label"]).alias("path"), "n")


@query(f"with {_FILES_SQL} select path, mtime from f where path::bigint % 2 = 0 and mtime <= 900 - 15")
def settled_files(spark, sf):
    """Half the files arrive; those that are still written wait in the pending table and then are looked at again."""
    s, own = _store(spark), files(spark, sf)
    first = own.filter(F.col("path").cast("long") % 2 == 0)
    ready = watch.debounced(s, first, own, 500.0, TH.settle_s)
    later = watch.debounced(s, first.limit(0), own, 900.0, TH.settle_s)
    return ready.union(later).select("path", "mtime")


@query(f"with {_FILES_SQL} select path from f where path::bigint % 5 = 0 and path::bigint % 10 <> 0 union select path from f where path::bigint % 3 = 0 and path::bigint % 10 <> 0")
def removed_files(spark, sf):
    """Deleted files that are indeed gone, and orphans of the sweep."""
    own, k = files(spark, sf), F.col("path").cast("long")
    placed = own.select(F.concat(F.lit("/lib/"), "path").alias("path"), k.alias("k"))
    listing = placed.filter("not (k % 3 = 0 or k % 5 = 0) or k % 10 = 0")
    return watch.removals(placed.filter("k % 5 = 0"), placed, listing, ["/lib"]).select(F.regexp_extract("path", r"(\d+)$", 1).alias("path"))


@query("with c as (select p_size as c, p_partkey as path from part), n as (select c, path from c where not (c % 4 = 0 and path % 2 = 0)) select c as cluster_id, path, path % 3 = 0 as is_keep from n where c % 4 <> 0 or not exists (select 1 from c x where x.c = n.c and x.path % 2 = 0)")
def rankings_carried_over(spark, sf):
    """After a removal, clusters of the same members keep their choice; the others are to be ranked."""
    old = table(spark, sf, "part").select(F.col("p_size").alias("cluster_id"), F.col("p_partkey").alias("path"), (F.col("p_partkey") % 3 == 0).alias("is_keep"), F.lit("r").alias("rank_reason"))
    new = old.filter("not (cluster_id % 4 = 0 and path % 2 = 0)").select("cluster_id", "path")
    return cluster.carried_over(new, old)[0].select("cluster_id", "path", "is_keep")


@query("select p_partkey, case when p_size > 25 then p_size || 'p' else '?' end as resolution, p_name || ': ' || p_size || ' copies, keep ' || p_brand as note, p_partkey % 7 + 1 as n_frames, round((p_partkey % 7) / 2.0::double, 6) as last_frame from part")
def display_text(spark, sf):
    rows = table(spark, sf, "part")
    times = S.frame_times((F.col("p_partkey") % 7 + 1).cast("int"), 2.0)
    return longs(rows.select("p_partkey", S.resolution_text(F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0)).alias("resolution"), S.notification(F.col("p_name"), F.col("p_size").cast("int"), F.col("p_brand")).alias("note"), F.size(times).alias("n_frames"), F.round(F.element_at(times, -1), 6).alias("last_frame")), "n_frames")


@query("select doc_id, case when n_chars % 3 > n_chars % 2 then n_chars % 3 else n_chars % 2 end as n from documents")
def longer_fingerprint(spark, sf):
    d = table(spark, sf, "documents")
    prints = lambda n: F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), n.cast("int"))
    return longs(d.select("doc_id", F.size(S.longer_fingerprint(prints(F.col("n_chars") % 2), prints(F.col("n_chars") % 3))).alias("n")), "n")


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 0.0 else round((o_orderkey % 100) / 100.0::double, 6) end as score, case when o_orderkey % 4 = 0 then 0 else o_orderkey % 3 - 1 end as dir, o_orderkey % 4 <> 0 and o_orderkey % 3 = 1 as superset from orders")
def evidence_json(spark, sf):
    """Evidence of alignments as JSON, with a field that is not known and others that are missing."""
    k = F.col("o_orderkey")
    body = F.when(k % 4 != 0, F.concat(F.lit('{"score": '), (k % 100 / 100.0).cast("string"), F.lit(', "new_field": [1], "superset_dir": '), (k % 3 - 1).cast("string"), F.lit(', "superset": '), (k % 3 == 1).cast("string"), F.lit("}")))
    return longs(table(spark, sf, "orders").select("o_orderkey", S.alignment_from_json(body).alias("e")).select("o_orderkey", F.round("e.score", 6).alias("score"), F.col("e.superset_dir").alias("dir"), "e.superset"), "dir")


@query("select p_partkey, round(((p_size % 256) / 255.0::double - 0.485) / 0.229, 6) as red, round(((p_partkey % 256) / 255.0::double - 0.456) / 0.224, 6) as green, round((0 - 0.406) / 0.225::double, 6) as blue, true as back from part")
def model_pixels(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size") % 256, F.col("p_partkey") % 256, F.lit(0)).alias("rgb"))
    out = rows.withColumn("x", V.normalised_pixels(F.col("rgb")))
    return out.select("p_partkey", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(("red", "green", "blue"))], (V.visible_pixels(F.col("x")) == F.col("rgb").cast("array<int>")).alias("back"))


@query("select n_nationkey::varchar as path, length(n_name) as n, case when n_nationkey % 5 = 0 then 'ValueError: no frames' end as error from nation")
def features_in_batches(spark, sf):
    """A featuriser that is fed batches; one that fails is run path by path."""
    names = {r.n_nationkey: r.n_name for r in table(spark, sf, "nation").collect()}  # 25 rows

    def make():
        def extract(paths):
            if len(paths) > 1 and any(int(p) % 5 == 0 for p in paths):
                raise RuntimeError("one of them")
            if any(int(p) % 5 == 0 for p in paths):
                raise ValueError("no frames")
            return [{"n": len(names[int(p)])} for p in paths]

        return extract

    found = media.featurise_batches(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path")), make, "n long", 4)
    return found.join(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.length("n_name").cast("long").alias("m")), "path").select("path", F.coalesce("n", "m").alias("n"), "error")


@query("select p_partkey, case when p_partkey % 5 = 0 then 0 else 3 end as n, case when p_partkey % 5 = 0 then null else p_partkey + (4294967296 - p_size) + 7 end as total from part")
def fingerprint_lines(spark, sf):
    """Output of the fingerprint tool: unsigned numbers, some written as negative ones; without the line there are none."""
    line = F.concat(F.lit("DURATION=10\nFINGERPRINT="), F.col("p_partkey").cast("string"), F.lit(",-"), F.col("p_size").cast("string"), F.lit(",7\n"))
    rows = table(spark, sf, "part").select("p_partkey", S.parse_fingerprint(F.when(F.col("p_partkey") % 5 == 0, "DURATION=10").otherwise(line)).alias("fp"))
    total = F.when(F.size("fp") > 0, F.aggregate("fp", F.lit(0).cast("long"), lambda a, x: a + x))
    return longs(rows.select("p_partkey", F.size("fp").alias("n"), total.alias("total")), "n")


@query("select p_partkey, (10 * 11025) // 22050 as n, p_size + p_partkey + (case when (p_size + p_partkey) % 2 = 0 then 0 else -1 end) as twice_first from part")
def mono_pcm(spark, sf):
    """Ten stereo frames at twice the target rate."""
    samples = F.flatten(F.array_repeat(F.array(F.col("p_size").cast("long"), F.col("p_partkey").cast("long")), 10))
    rows = table(spark, sf, "part").select("p_partkey", S.mono_samples(samples, F.lit(2), F.lit(22050)).alias("x"))
    return longs(rows.select("p_partkey", F.size("x").alias("n"), (F.col("x")[0] * 2).alias("twice_first")), "n")


@query("select o_orderkey::varchar as path_a, o_custkey::varchar as path_b, case when o_orderkey % 2 = 0 then 'same' else 'different' end as label from orders")
def labels_round_trip(spark, sf):
    """Labelled pairs written as a CSV report and read again."""
    where = scratch_path(spark, "labels")
    k = F.col("o_orderkey")
    media.write_report(table(spark, sf, "orders").select(k.cast("string").alias("path_a"), F.col("o_custkey").cast("string").alias("path_b"), F.when(k % 2 == 0, "same").otherwise("different").alias("label")), where, "csv")
    return media.labelled_pairs(spark, where)


@query("select o_orderkey, abs((o_orderkey % 100) - (o_custkey % 100)) <= greatest(2.0::double, (o_orderkey % 100) * 0.02::double) as ok from orders")
def repair_accepted(spark, sf):
    """Whether a remuxed file is as long as the original."""
    return table(spark, sf, "orders").select("o_orderkey", store.repair_accepted((F.col("o_orderkey") % 100).cast("double"), (F.col("o_custkey") % 100).cast("double")).alias("ok"))


@query(f"with {_FILES_SQL} select path, size, mtime from f where feature_version = 'v1'")
def files_migrated(spark, sf):
    """A files table of an older version, with fewer columns, brought to the present ones."""
    s = _store(spark)
    own = files(spark, sf).filter("feature_version = 'v1'")
    own.select("path", "mtime", "size").write.parquet(f"{s.root}/files/v-old")
    s._claim("files", 1, "v-old")
    changed = s.migrate()
    return s.read("files").filter(F.lit("files" in changed) & F.col("global_vec").isNull()).select("path", "size", "mtime")
