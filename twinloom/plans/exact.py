"""Exact duplicates, snapshots, names and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cluster, names, rank, store, views
from ..operators.graph import cluster_name, components
from ..config import Thresholds
from .catalog import query, table

_FILES_SQL = "files as (select doc_id as path, md5(text) as content_hash, n_chars as size, source, lang, n_chars from documents)"


def files(spark, sf):
    """documents as files: doc_id is the path, the text its content."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"), F.col("n_chars").alias("size"), "source", "lang", "n_chars")


@query(f"with {_FILES_SQL} select content_hash, size, count(*) as n, min(path) as smallest from files group by all having count(*) > 1")
def t0_groups(spark, sf):
    return cluster.exact_groups(files(spark, sf))


@query(f"with {_FILES_SQL}, g as (select content_hash, size, min(path) as keep from files group by all having count(*) > 1) select g.keep as a, f.path as b from files f join g using (content_hash, size) where f.path <> g.keep")
def t0_star_edges(spark, sf):
    own = files(spark, sf)
    return cluster.star_edges(own, cluster.exact_groups(own).withColumnRenamed("smallest", "keep"))


@query(
    f"""
    with {_FILES_SQL}, g as (select *, min(path) over w as first, count(*) over w as n, row_number() over (partition by content_hash, size order by size desc, length(cast(path as varchar)), path) as r from files window w as (partition by content_hash, size))
    select ('0x' || substr(sha256(cast(first as varchar)), 1, 14))::bigint as cluster_id, max(case when r = 1 then path end) as keep, cast(max(n) as bigint) as n_copies,
           cast(sum(case when r > 1 then size else 0 end) as bigint) as reclaimable
    from g where n > 1 group by first
    """
)
def keep_view(spark, sf):
    """Hash, groups, star edges, components, ranking and the space that can be had back."""
    own = files(spark, sf)
    groups = cluster.exact_groups(own)
    found = components(cluster.star_edges(own, groups.withColumnRenamed("smallest", "keep")))
    members = found.select(cluster_name(F.col("component")).alias("cluster_id"), F.col("id").alias("path")).join(own.select("path", "size"), "path")
    ranked = rank.ranked(members.withColumn("score", F.col("size")))
    return ranked.groupBy("cluster_id").agg(F.min_by("path", "rank").alias("keep"), F.count("*").alias("n_copies"), F.sum(F.when(F.col("rank") > 1, F.col("size")).otherwise(0)).alias("reclaimable"))


@query("select doc_id, md5(case when n_chars > 128 then substr(text, 1, 64) || substr(text, n_chars // 2 + 1, 64) || substr(text, n_chars - 63, 64) else substr(text, 1, 64) end) as h from documents")
def sampled_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.sampled_hash(F.col("text"), F.col("n_chars"), 64).alias("h"))


@query("with p as (select p_partkey, case when p_partkey % 11 = 0 then null else p_size end as height from part) select p_partkey, height, height is null or height <= 25 as kept from p")
def height_filter(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")).alias("height"))
    kept, gone = views.within_height(rows, 25)
    return kept.withColumn("kept", F.lit(True)).union(gone.withColumn("kept", F.lit(False)))


@query("select event_id, case when event_id % 3 <> 0 and (event_id % 2 = 0) then 'reindex' else 'corrupt' end as category from events")
def problem_category(spark, sf):
    error = F.when(F.col("event_id") % 3 == 0, F.lit("moov atom not found")).when(F.col("event_id") % 2 == 0, F.lit("Probe Timeout after 30 s")).otherwise(F.lit("decode failed"))
    return table(spark, sf, "events").select("event_id", S.problem_category(error).alias("category"))


@query(
    """
    select doc_id, case when n_chars <= 0 then 8 else least(48, greatest(8, cast(ceil(n_chars / 120.0) as int))) end as points,
           case when n_chars > 0 and n_chars <= 3600 then 0.0 else 600.0 end as cap,
           least(1.0, n_chars * 4 / 8.0 / least(n_chars, 600.0)) as coverage,
           case when n_chars > 6000 or doc_id % 5000 >= 4320 then 'seek' else 'demux' end as method
    from documents
    """
)
def extraction_policy(spark, sf):
    """How a file is to be read: probe points, fingerprint length and coverage, decode method."""
    n = F.col("n_chars").cast("double")
    return table(spark, sf, "documents").select(
        "doc_id", S.coverage_points(n).alias("points"), S.fingerprint_cap(n, 600.0, 3600.0).alias("cap"), S.fingerprint_coverage(n * 4, n, F.lit(600.0)).alias("coverage"),
        S.decode_method(F.col("n_chars") * 1_000_000, F.col("doc_id") % 5000, 6.0, 4320).alias("method"),
    )


_SNAPSHOT_SQL = """
    listing as (select doc_id as path, doc_id * 10.0 + case when doc_id % 9 = 0 then 5 else 0.5 end as mtime, n_chars + case when doc_id % 13 = 0 then 1 else 0 end as size from documents where doc_id % 7 <> 0),
    stored as (select doc_id as path, doc_id * 10.0 as s_mtime, n_chars as s_size, case when doc_id % 17 = 0 then 'old' else 'v1' end as fv, md5(text) as content_hash from documents where doc_id % 5 <> 0)
"""


def snapshot(spark, sf):
    """A listing and a store that differ in some files."""
    docs = table(spark, sf, "documents")
    listing = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), (F.col("doc_id") * 10.0 + F.when(F.col("doc_id") % 9 == 0, 5.0).otherwise(0.5)).alias("mtime"), (F.col("n_chars") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("size"))
    stored = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), (F.col("doc_id") * 10.0).alias("mtime"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 17 == 0, "old").otherwise("v1").alias("feature_version"), F.md5("text").alias("content_hash"))
    return listing, stored


@query(
    f"""
    with {_SNAPSHOT_SQL}, problems as (select path, mtime as p_mtime, size as p_size from listing where path % 10 = 5)
    select d.doc_id as path, case when l.path is null then 'gone' when 9000.0 - l.mtime < 15 then 'copying'
           when coalesce(abs(l.mtime - s.s_mtime) <= 2 and l.size = s.s_size and s.fv = 'v1', false) or p.path is not null then 'done' else 'pending' end as state
    from documents d left join listing l on l.path = d.doc_id left join stored s on s.path = d.doc_id left join problems p on p.path = d.doc_id
    """
)
def freshness_state(spark, sf):
    listing, stored = snapshot(spark, sf)
    problems = listing.filter("path % 10 = 5")
    return store.states(listing, stored, problems, table(spark, sf, "documents").select(F.col("doc_id").alias("path")), "v1", 9000.0, 15.0, 2.0)


@query(f"with {_SNAPSHOT_SQL} select l.path from listing l left join stored s using (path) where not coalesce(abs(l.mtime - s.s_mtime) <= 2 and l.size = s.s_size and s.fv = 'v1', false)")
def changed_set(spark, sf):
    listing, stored = snapshot(spark, sf)
    return store.fresh(stored, listing, "v1", 2.0).filter("not fresh").select("path")


@query(f"with {_SNAPSHOT_SQL} select path, case when coalesce(abs(l.mtime - s.s_mtime) <= 2 and l.size = s.s_size, false) then s.content_hash end as content_hash from listing l left join stored s using (path)")
def reusable_hashes(spark, sf):
    listing, stored = snapshot(spark, sf)
    known, todo = store.reusable_hashes(stored, listing, 2.0)
    return known.unionByName(todo.withColumn("content_hash", F.lit(None).cast("string")))


@query("select '/lib/' || source || '/' || doc_id as path from documents where doc_id % 7 = 0 and source in ('src1', 'src2')")
def orphan_paths(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", F.lit("/lib"), "source", F.col("doc_id").cast("string")).alias("path"))
    return store.orphans(docs, docs.filter("doc_id % 7 <> 0"), ["/LIB/src1", "/lib/src2/"])


@query(f"with {_FILES_SQL}, d as (select content_hash, size, min(path) as donor from files where path % 3 = 0 group by all) select f.path, d.donor from files f join d using (content_hash, size) where f.path % 3 <> 0")
def donor_lookup(spark, sf):
    own = files(spark, sf).withColumn("has_features", F.col("path") % 3 == 0)
    return own.filter("not has_features").join(cluster.donors(own, keys=("content_hash", "size")), ["content_hash", "size"]).select("path", "donor")


@query(
    """
    select event_id, case when event_id % 4 = 0 then value + 1 else value end as duration_s, cast(user_id * 2 as int) as width, 'h264' as vcodec,
           case when event_id % 5 = 0 then 900 else event_id * 10 // 1000 end as bitrate_kbps, case when event_id % 3 = 0 then null else 'spa' end as lang, cast(1 as int) as tracks
    from events
    """
)
def probe_json(spark, sf):
    e = table(spark, sf, "events")
    text = lambda c: c.cast("string")
    body = F.concat(
        F.lit('{"streams":[{"index":0,"codec_type":"video","codec_name":"h264","width":'), text(F.col("user_id") * 2), F.lit(',"duration":"'), text(F.col("value") + 1), F.lit('"'),
        F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(',"bit_rate":"'), text(F.col("event_id") * 10), F.lit('"'))),
        F.lit('},{"index":1,"codec_type":"audio","channels":2,"tags":{"'), F.when(F.col("event_id") % 2 == 0, "language").otherwise("LANGUAGE"), F.lit('":"'), F.when(F.col("event_id") % 3 == 0, "und").otherwise(" SPA "),
        F.lit('"}},{"index":2,"codec_type":"subtitle"}],"format":{"bit_rate":"900999"'), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(',"duration":"'), text(F.col("value")), F.lit('"'))), F.lit("}}"),
    )
    p = e.select("event_id", S.parse_probe(body).alias("p"))
    return p.select("event_id", "p.duration_s", "p.width", "p.vcodec", "p.bitrate_kbps", F.col("p.audio_tracks")[0]["lang_tag"].alias("lang"), F.size("p.audio_tracks").alias("tracks"))


@query(
    r"""
    with raw as (select p_partkey, replace(p_name, ' ', '.') || '_(' || (1980 + p_size) || ').1080p.WEB-DL.x264.DTS-HD-GRP' as s from part),
    a as (select p_partkey, regexp_replace(regexp_replace(s, '[._]', ' ', 'g'), '[\[\](){}]', ' ', 'g') as s from raw),
    b as (select p_partkey, regexp_replace(s, '(?i)\b(1080p|web-?dl|x264|dts(-hd)?)\b', ' ', 'g') as s from a),
    c as (select p_partkey, regexp_replace(regexp_replace(s, '-\s*[A-Za-z0-9]+$', ''), '\s+', ' ', 'g') as s from b)
    select p_partkey, trim(s, ' -') as title from c
    """
)
def clean_title(spark, sf):
    path = F.concat(F.lit("/films/"), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), F.lit("_("), (F.col("p_size") + 1980).cast("string"), F.lit(").1080p.WEB-DL.x264.DTS-HD-GRP.mkv"))
    return table(spark, sf, "part").select("p_partkey", S.clean_title(path).alias("title"))


def _named(spark, sf):
    n = F.col("p_partkey")
    mark = F.when(n % 3 == 0, F.concat(F.lit(" ("), (n % 4 + 1).cast("string"), F.lit(")"))).when(n % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(" (1) ("), (n % 7).cast("string"), F.lit(")")))
    return table(spark, sf, "part").select(n, F.concat(F.lit("/d"), F.col("p_size").cast("string"), F.lit("/"), "p_name", mark, F.lit(".mkv")).alias("path"))


_NAMED_SQL = "named as (select p_partkey, '/d' || p_size || '/' || p_name || case p_partkey % 3 when 0 then ' (' || (p_partkey % 4 + 1) || ')' when 1 then '' else ' (1) (' || (p_partkey % 7) || ')' end || '.mkv' as path, lower('/d' || p_size || '/' || p_name) as k, p_name from part)"


@query(f"with {_NAMED_SQL} select p_partkey, p_name as stem from named")
def base_stem(spark, sf):
    return _named(spark, sf).select("p_partkey", S.base_stem(S.stem(F.col("path"))).alias("stem"))


@query(f"with {_NAMED_SQL}, p as (select distinct path, k from named), f as (select path, first_value(path) over (partition by k order by length(path), path) as a from p) select a, path as b from f where a <> path")
def name_siblings(spark, sf):
    return names.name_siblings(_named(spark, sf))


@query("select event_id, (floor(value) * 1000)::bigint as s, case when floor(value) * 1000 >= 86400 then ((floor(value) * 1000)::bigint // 86400) || 'd ' || lpad(((floor(value) * 1000)::bigint % 86400 // 3600)::varchar, 2, '0') else ((floor(value) * 1000)::bigint // 3600)::varchar end || ':' || lpad(((floor(value) * 1000)::bigint % 3600 // 60)::varchar, 2, '0') || ':' || lpad(((floor(value) * 1000)::bigint % 60)::varchar, 2, '0') as clock from events")
def duration_text(spark, sf):
    s = (F.floor("value") * 1000).cast("long")
    return table(spark, sf, "events").select("event_id", s.alias("s"), S.duration_text(s).alias("clock"))


@query("select event_id, case when event_id % 10 = 0 then 0 else (event_id % 5) * 3600 + (event_id % 60) * 60 + event_id % 7 end as secs from events")
def clock_seconds(spark, sf):
    n = F.col("event_id")
    clock = F.when(n % 10 == 0, F.lit("n/a")).otherwise(F.concat_ws(":", (n % 5).cast("string"), F.lpad((n % 60).cast("string"), 2, "0"), F.lpad((n % 7).cast("string"), 2, "0")))
    return table(spark, sf, "events").select("event_id", S.clock_seconds(clock).alias("secs"))


@query("select event_id, case event_id % 4 when 0 then 'RuntimeError: ' || event_type when 1 then 'KeyError' when 2 then 'Traceback of ' || event_type else event_type end as reason from events")
def error_summary(spark, sf):
    t = F.col("event_type")
    kinds = [F.array(F.lit("╭ Traceback ╮"), F.concat(F.lit("│ RuntimeError: "), t, F.lit(" │")), F.lit("")), F.array(F.lit("ValueError: inner"), F.lit("KeyError"), F.lit("bye")), F.array(F.concat(F.lit("Traceback of "), t), F.lit("x")), F.array(t, F.lit(" "), F.lit("│ │"))]
    lines = F.when(F.col("event_id") % 4 == 0, kinds[0]).when(F.col("event_id") % 4 == 1, kinds[1]).when(F.col("event_id") % 4 == 2, kinds[2]).otherwise(kinds[3])
    return table(spark, sf, "events").select("event_id", S.error_summary(lines).alias("reason"))


@query("select doc_id, '/lib/' || source || '/' || lang || '/' || doc_id || '.mkv' as path, '/lib' as anchor, case when lang in ('en', 'fr') then lang else '' end as genre, substr(sha1('/lib/' || source || '/' || lang || '/' || doc_id || '.mkv'), 1, 16) as digest, case lang when 'en' then 'eng' when 'fr' then 'fre' when 'de' then 'ger' when 'es' then 'spa' else lang end as lang3 from documents")
def path_functions(spark, sf):
    raw = F.concat(F.lit("\\lib//"), "source", F.lit("/./"), "lang", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".mkv/"))
    rows = table(spark, sf, "documents").select("doc_id", "lang", S.canonical_path(raw).alias("path"))
    return rows.select("doc_id", "path", S.volume_anchor(F.col("path")).alias("anchor"), S.genre_of(F.col("path"), ["en", "fr"]).alias("genre"), S.path_digest(F.col("path")).alias("digest"), S.iso3(F.col("lang")).alias("lang3"))


@query("select n, [greatest(0.0::double, least(n * i / 4.0::double, n - 60.0::double)) for i in range(1, 4)] as starts from (select distinct n_chars as n from documents)")
def region_starts(spark, sf):
    n = F.col("n").cast("double")
    return table(spark, sf, "documents").select(F.col("n_chars").alias("n")).distinct().select("n", S.region_starts(n, 3, 60.0).alias("starts"))


@query("select o_orderkey, case when cov >= 0.85 then '' when cov <= 0.001 then ', no audio' else ', audio ends ~' || (cast(floor(cov * d) as bigint) // 60) || ':' || lpad((cast(floor(cov * d) as bigint) % 60)::varchar, 2, '0') || ' of ' || (d // 60) || ':' || lpad((d % 60)::varchar, 2, '0') end as note from (select o_orderkey, (o_orderkey % 101) / 100.0::double as cov, cast(floor(o_totalprice / 100) as bigint) as d from orders)")
def audio_note(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 101 / 100.0).alias("cov"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("d"))
    return rows.select("o_orderkey", S.audio_note(F.col("cov"), F.col("d"), 0.85).alias("note"))


@query(f"with {_FILES_SQL}, c as (select source as cluster_id, path, size, path % 5 = 0 as is_keep from files), f as (select path, size, path % 1080 as height, case when path % 6 = 0 then null else (path % 20) / 20.0 end as cov from files where path % 11 <> 0), v as (select c.cluster_id, c.is_keep, coalesce(f.size, 0) as size, case when c.path % 8 = 0 then 1.0 else coalesce(f.cov, 1.0) end as cov from c left join f using (path)) select cluster_id, count(*) as n_copies, cast(sum(case when not is_keep then size else 0 end) as bigint) as reclaimable, min(cov) < 0.85 and max(cov) - min(cov) > 0.05 as audio_warning from v group by 1 having count(*) > 1")
def cluster_view(spark, sf):
    own = files(spark, sf)
    members = own.select(F.col("source").alias("cluster_id"), "path", (F.col("path") % 5 == 0).alias("is_keep"))
    stored = own.filter("path % 11 <> 0").select("path", "size", (F.col("path") % 1080).alias("height"), F.when(F.col("path") % 6 != 0, F.col("path") % 20 / 20.0).alias("audio_coverage"))
    return views.cluster_summary(views.cluster_view(members, stored, own.filter("path % 8 = 0").select("path"), Thresholds()), Thresholds())


@query("select doc_id as path from documents where (doc_id % 20) / 20.0 < 0.85 and doc_id % 6 <> 0 and doc_id % 4 <> 0")
def audio_warnings(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 20 / 20.0).alias("audio_coverage"))
    return views.audio_warnings(rows, rows.filter("path % 4 = 0"), Thresholds()).select("path")


@query("select doc_id as path, case when doc_id % 4 = 0 then 1.0 when doc_id % 6 <> 0 then (doc_id % 20) / 20.0 when doc_id % 5 <> 0 then 0.5 end as audio_coverage, doc_id % 4 <> 0 and doc_id % 6 = 0 as measure from documents")
def coverage_fill(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 20 / 20.0).alias("audio_coverage"))
    return store.coverage_filled(rows, rows.filter("path % 4 = 0"), rows.filter("path % 6 = 0 and path % 5 <> 0").select("path", F.lit(0.5).alias("audio_coverage")))


@query("select distinct source from documents where lower(source) like '%c1%' or exists (select 1 from documents d where d.source = documents.source and lower(d.lang) like '%es%')")
def cluster_search(spark, sf):
    rows = table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("members"))
    return views.search(rows, "C1", "source").union(views.search(rows, "ES", "source")).select("source").distinct()
