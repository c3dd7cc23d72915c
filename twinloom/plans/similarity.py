"""Candidates, alignment and verdicts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import scalar as S
from ..functions import vectors as V
from ..operators import align, blocking, decide, store
from ..operators.graph import cluster_name, components
from ..operators.cluster import membership_key, split_vetoes, touched_clusters
from .catalog import longs, query, table

TH = Thresholds()


def frames(spark, sf):
    """embeddings as frames: label is the file, vec_id the order, two seconds apart."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "embeddings")
    no = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("path"), no.alias("frame_no"), (no * 2.0).alias("ts"), F.col("embedding").alias("vec"), "vec_id")


_VEC = "cast(embedding as double[])"
_CELLS = f"cells as (select label as path, vec_id, row_number() over (partition by label order by vec_id) as f, unnest({_VEC}) as x, generate_subscripts(embedding, 1) as pos from embeddings)"


@query(f"with {_CELLS}, m as (select path, pos, avg(x) as x from cells group by all) select path, pos - 1 as pos, round(x / sqrt(sum(x * x) over (partition by path)), 6) as x from m")
def global_descriptor(spark, sf):
    return longs(V.global_descriptor(frames(spark, sf)).select("path", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6)), "pos")


@query(f"with w as (select vec_id, ntile(12) over (partition by label order by vec_id) - 1 as w from embeddings), {_CELLS}, m as (select path, w, pos, avg(x) as x from cells join w using (vec_id) group by all) select path, w, pos - 1 as pos, round(x / sqrt(sum(x * x) over (partition by path, w)), 6) as x from m")
def window_descriptors(spark, sf):
    return longs(V.window_descriptors(frames(spark, sf)).select("path", "w", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6)), "pos", "w")


@query(f"with s as (select a.vec_id as id, b.vec_id as other, list_dot_product({_VEC.replace('embedding', 'a.embedding')}, {_VEC.replace('embedding', 'b.embedding')}) as s from embeddings a, embeddings b) select id, other, round(s, 6) as score, r as rank from (select *, row_number() over (partition by id order by round(s, 12) desc, other) as r from s) where r <= 25")
def knn_global(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return longs(blocking.top_k(e, e, TH.knn_k).select("id", "other", F.round("score", 6).alias("score"), "rank"), "rank")


@query(
    f"""
    with w as (select vec_id, ntile(12) over (partition by label order by vec_id) - 1 as w from embeddings), {_CELLS},
    m as (select path, w, pos, avg(x) as x from cells join w using (vec_id) group by all),
    v as (select path, w, list(x / n order by pos) as vec from (select *, sqrt(sum(x * x) over (partition by path, w)) as n from m) group by all),
    s as (select a.path as a, a.w, b.path as b, b.w as bw, row_number() over (partition by a.path, a.w order by round(list_dot_product(a.vec, b.vec), 12) desc, b.path, b.w) as r from v a, v b)
    select distinct a, b from s where r <= 10 and a <> b
    """
)
def knn_window_owner(spark, sf):
    return blocking.window_owners(V.window_descriptors(frames(spark, sf)), TH.window_k)


@query("select a.doc_id as a, b.doc_id as b from documents a, documents b where b.n_chars between a.n_chars * (1 - 0.03::double) and a.n_chars * (1 + 0.03::double) and a.doc_id <> b.doc_id")
def duration_block(spark, sf):
    return blocking.duration_pairs(table(spark, sf, "documents"), "doc_id", "n_chars", TH.duration_tolerance)


@query(f"with p as (select a.vec_id as a, b.vec_id as b, a.embedding as x, b.embedding as y from embeddings a, embeddings b where a.label = b.label and a.vec_id < b.vec_id) select a, b from p where a % 10 = 0 or b % 10 = 0 or list_dot_product({_VEC.replace('embedding', 'x')}, {_VEC.replace('embedding', 'y')}) >= 0.2")
def cosine_gate(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("path"), F.col("embedding").alias("vec"), "label")
    x, y = e.alias("x"), e.alias("y")
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.path") < F.col("y.path"))).select(F.col("x.path").alias("a"), F.col("y.path").alias("b"))
    return blocking.cosine_gate(pairs, e.filter("path % 10 <> 0"), 0.2)


@query(
    f"""
    with s as (select a.vec_id as a, b.vec_id as b, row_number() over (partition by a.vec_id order by round(list_dot_product({_VEC.replace('embedding', 'a.embedding')}, {_VEC.replace('embedding', 'b.embedding')}), 12) desc, b.vec_id) as r from embeddings a, embeddings b),
    near as (select a, b from s where r <= 5 union select a.doc_id, b.doc_id from documents a, documents b where b.n_chars between a.n_chars * (1 - 0.01::double) and a.n_chars * (1 + 0.01::double))
    select distinct least(a, b) as a, greatest(a, b) as b from near where a <> b
    """
)
def candidates(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = blocking.top_k(e, e, 5).select(F.col("id").alias("a"), F.col("other").alias("b"))
    return blocking.candidates(near, blocking.duration_pairs(table(spark, sf, "documents"), "doc_id", "n_chars", 0.01))


@query(f"with s as (select a.vec_id as id, b.vec_id as other, list_dot_product({_VEC.replace('embedding', 'a.embedding')}, {_VEC.replace('embedding', 'b.embedding')}) as s from embeddings a, embeddings b where a.vec_id % 50 = 0) select id, other, round(s, 6) as score, r as rank from (select *, row_number() over (partition by id order by round(s, 12) desc, other) as r from s) where r <= 25")
def knn_new(spark, sf):
    """What a few new files ask of the whole library."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return longs(blocking.top_k(e.filter("id % 50 = 0"), e, TH.knn_k).select("id", "other", F.round("score", 6).alias("score"), "rank"), "rank")


@query("select a.doc_id as a, b.doc_id as b from documents a, documents b where a.doc_id % 50 = 0 and b.n_chars between a.n_chars * (1 - 0.03::double) and a.n_chars * (1 + 0.03::double) and a.doc_id <> b.doc_id")
def duration_new(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return blocking.duration_pairs(d, "doc_id", "n_chars", TH.duration_tolerance, d.filter("doc_id % 50 = 0"))


@query()
def knn_lists(spark, sf):
    """The nearest by an inverted file: 12 of 16 lists, fitted on a bounded sample. The tests measure its recall (0.95 on sf0.1, whose
    vectors form no clusters; on data that does, fewer lists do)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return longs(blocking.top_k_by_lists(e.filter("id % 50 = 0"), e, 10, blocking.fitted_lists(e, 16), 12), "rank")


_PAIRS_SQL = "pairs as (select o_orderkey as a, o_orderkey + 1 + o_custkey % 7 as b from orders)"


def _pairs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 7).alias("b"))


@query(f"with {_PAIRS_SQL} select a, b from pairs where not (a % 4 = 0) or a % 10 = 3 or b % 10 = 3")
def ledger_skip(spark, sf):
    pairs = _pairs(spark, sf)
    done = pairs.filter("a % 4 = 0").select(S.pair_digest(F.col("b"), F.col("a")).alias("pair_hash"))
    changed = pairs.select(F.col("a").alias("path")).union(pairs.select("b")).filter("path % 10 = 3")
    return blocking.not_evaluated(pairs, done, changed)


@query(f"with {_PAIRS_SQL} select a, b from pairs where a % 3 <> 0")
def veto_edges(spark, sf):
    pairs = _pairs(spark, sf)
    return blocking.without_pairs(pairs, pairs.filter("a % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


@query(f"with f as (select label as path, vec_id, (row_number() over (partition by label order by vec_id) - 1) * 2.0 as ts, {_VEC} as v, lag({_VEC}) over (partition by label order by vec_id) as p from embeddings) select path, ts from f where p is not null and list_cosine_similarity(v, p) < 0.1")
def scene_cuts(spark, sf):
    return align.scene_cuts(frames(spark, sf), 0.1)


@query("select user_id as path, count(*) as n, round(count(*) / (max(epoch(ts)) - min(epoch(ts))), 9) as density from events group by 1")
def cut_density(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("d")).select("path", "n", F.round(S.cut_density(F.col("n"), F.col("d")), 9).alias("density"))


@query("select * from (select user_id as path, row_number() over w - 2 as i, round((epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6, 6) as gap from events window w as (partition by user_id order by ts)) where gap is not null")
def cut_intervals(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return longs(align.intervals(e).select("path", "i", F.round(F.col("gap") / 1e6, 6).alias("gap")), "i")


_ITEMS_SQL = "items as (select user_id as key, row_number() over (partition by user_id order by ts) - 1 as i, (event_id * 2654435761) % 4294967296 as x from events)"


@query(
    f"""
    with {_ITEMS_SQL}, s as (select a.key as a, b.key as b, b.i - a.i as off, count(*) as n, sum(bit_count(xor(a.x, b.x))) as bits from items a join items b on b.key - a.key between 1 and 3 and b.i - a.i between -20 and 20 group by all),
    r as (select *, 1 - bits / (32.0::double * n) as sim from s where n >= 30)
    select a, b, off, n, round(sim, 9) as sim from (select *, row_number() over (partition by a, b order by sim desc, off) as k from r) where k = 1 and sim > 0
    """
)
def audio_offset_search(spark, sf):
    """Every user against the next three."""
    from pyspark.sql import Window as W

    items = table(spark, sf, "events").select(F.col("user_id").alias("key"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts")) - 1).alias("i"), (F.col("event_id") * 2654435761 % 4294967296).alias("x"))
    keys = items.select("key").distinct()
    pairs = keys.select(F.col("key").alias("a"), F.explode(F.array(*[F.col("key") + i for i in (1, 2, 3)])).alias("b")).join(keys.select(F.col("key").alias("b")), "b", "left_semi")
    return longs(align.audio_offsets_sql(pairs, items, 20, 30).select("a", "b", "off", "n", F.round("sim", 9).alias("sim")), "off")


@query(
    """
    with f as (select user_id as path, event_id as v, epoch_us(ts) / 1e6 - 1704067200 as t from events), g as (select path, unnest(range(0, cast(floor(max(t) / 3600) as bigint) + 1)) as i from f group by path),
    n as (select g.path, g.i, f.v, row_number() over (partition by g.path, g.i order by abs(f.t - g.i * 3600.0), f.t desc) as r from g join f using (path))
    select path, i, i * 3600.0 as t, v as frame_no from n where r = 1
    """
)
def grid_resample(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("frame_no"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("ts"))
    return longs(align.nearest_grid(e, 3600.0), "i")


@query("with p as (select distinct l_orderkey as k, l_linenumber * 3 + l_partkey % 3 as pos, 40 as total from lineitem), g as (select *, pos - lag(pos) over (partition by k order by pos) - 1 as gap from p) select k, cast(coalesce(sum(case when gap >= 3 then gap else 0 end), 0) as bigint) as foreign_, coalesce(sum(case when gap >= 3 then gap else 0 end), 0) / 40.0::double as ratio from g group by k")
def gap_runs(spark, sf):
    path = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 3 + F.col("l_partkey") % 3).alias("pos"), F.lit(40).alias("total"))
    return align.gap_runs(path, "k", "pos", "total", 3).withColumnRenamed("foreign", "foreign_")


@query(
    """
    with e as (select l_orderkey as k, count(distinct l_linenumber) as n, min(l_linenumber) as lo, max(l_linenumber) as hi, cast(max(l_partkey) % 4 as int) as more from lineitem group by 1),
    x as (select *, hi - lo + 1 as span, hi as na, hi + more as nb from e),
    d as (select *, n >= 0.9 * span and span / na::double >= 0.9 and nb - span > na - span as to_b, n >= 0.9 * span and span / nb::double >= 0.9 and na - span > nb - span as to_a from x),
    r as (select *, case when to_b then (nb - span) / nb::double when to_a then (na - span) / na::double else 0.0 end as extra from d)
    select k, case when extra >= 0.08 and to_b then 1 when extra >= 0.08 and to_a then -1 else 0 end as dir, round(extra, 9) as extra, extra >= 0.08 as edition from r
    """
)
def superset(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.countDistinct("l_linenumber").alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), (F.max("l_partkey") % 4).alias("more"))
    r = align.superset(F.col("n"), F.col("lo"), F.col("hi"), F.col("hi"), F.col("lo"), F.col("hi"), F.col("hi") + F.col("more"), TH.superset_min_extra_ratio)
    return e.select("k", r.alias("r")).select("k", "r.dir", F.round("r.extra", 9).alias("extra"), "r.edition")


@query(
    """
    with recursive f as (select label as path, row_number() over (partition by label order by vec_id) - 1 as k, cast(embedding as double[]) as v from embeddings),
    spliced as (
      select (path + 1) % 10 as path, k as pos, v from f where k < 10 union all select path, k + 10 + case when k >= 20 then 12 else 0 end, v from f
      union all select (path + 1) % 10, k + 10, v from f where k between 20 and 31
    ),
    b as (select path, row_number() over (partition by path order by pos) - 1 as k, v from spliced),
    sizes as (select x.path, x.c as na, y.c as nb from (select path, count(*) as c from f group by 1) x join (select path, count(*) as c from b group by 1) y using (path)),
    sims as (select x.path, x.k as i, y.k as j, list_dot_product(x.v, y.v) as sim from f x join b y using (path) where y.k - x.k between -150 and 150),
    dp as (
      select path, na, nb, cast(-1 as bigint) as i, d, 0.0::double as v, cast(null as struct(n bigint, s double, fa bigint, fb bigint, la bigint, lb bigint, ga bigint, gb bigint)) as c
      from sizes, unnest(range(-150, 151)) as t(d)
      union all
      select path, na, nb, i, d, case when jump then reach else r end as v, (last_value(case when not jump then {'x': own} end ignore nulls) over (partition by path order by d rows between unbounded preceding and current row)).x as c
      from (select *, coalesce(sim is not null and reach > r + 1e-6, false) as jump from (
        select *, max(r + 0.3::double * (d + 150)) over (partition by path order by d rows between unbounded preceding and 1 preceding) - 0.3::double * (d + 150) as reach from (
          select *, case way when 1 then diagonal when 2 then above else 0.0 end as r,
            case way when 1 then case when c is null then {'n': 1, 's': sim, 'fa': i, 'fb': i + d, 'la': i, 'lb': i + d, 'ga': 0, 'gb': 0}
              else {'n': c.n + 1, 's': c.s + sim, 'fa': c.fa, 'fb': c.fb, 'la': i, 'lb': i + d, 'ga': c.ga + case when i - c.la - 1 >= 5 then i - c.la - 1 else 0 end, 'gb': c.gb + case when i + d - c.lb - 1 >= 5 then i + d - c.lb - 1 else 0 end} end
              when 2 then uc end as own
          from (select *, case when sim is null then 0 when coalesce(above, -1.0) > greatest(diagonal, 0.0) then 2 when diagonal > 0 then 1 else 0 end as way from (
            select q.path, q.na, q.nb, q.i, q.d, q.c, q.uc, s.sim, q.v + s.sim - 0.5::double as diagonal, q.uv - 0.3::double as above
            from (select path, na, nb, i + 1 as i, d, v, c, lead(v) over (partition by path order by d) as uv, lead(c) over (partition by path order by d) as uc from dp where i + 1 < na) q
            left join sims s on s.path = q.path and s.i = q.i and s.j = q.i + q.d)))))
    ),
    best as (select * from (select *, row_number() over (partition by path order by v desc, i, d) as k from dp where v > 0) where k = 1),
    spans as (select path, na, nb, c.n as n, c.s / c.n as score, (c.fb - c.fa) / 0.5::double as offset_s, c.n / least(na, nb)::double as coverage, c.la - c.fa + 1 as sa, c.lb - c.fb + 1 as sb, c.ga as ga, c.gb as gb from best),
    ways as (select *, case when n >= 0.9::double * greatest(sa, sb) then case when sa / na::double >= 0.9::double and nb - sb > na - sa then 1 when sb / nb::double >= 0.9::double and na - sa > nb - sb then -1 else 0 end else 0 end as way from spans),
    extras as (select *, case way when 1 then (nb - sb) / nb::double when -1 then (na - sa) / na::double else 0.0 end as extra, case when nb >= na then gb else ga end as foreign_ from ways),
    found as (select *, way <> 0 and extra >= 0.08::double as super from extras)
    select 'a' || s.path as a, 'b' || s.path as b, round(coalesce(score, 0.0), 6) as score, coalesce(offset_s, 0.0) as offset_s, round(coalesce(coverage, 0.0), 6) as coverage, coalesce(super, false) as superset,
      case when super then way else 0 end as superset_dir, round(coalesce(extra, 0.0), 6) as extra_ratio,
      round(case when super or coalesce(foreign_, 0) = 0 then 0.0 else foreign_ / greatest(s.na, s.nb)::double end, 6) as interleaved_ratio,
      case when super or coalesce(foreign_, 0) = 0 then 0 when s.nb >= s.na then 1 else -1 end as ad_dir
    from sizes s left join found using (path)
    """
)
def video_dp(spark, sf):
    """Files against themselves with ten frames of another file put before and a block put in after frame 20."""
    f = frames(spark, sf).select("path", "frame_no", "vec")
    other = f.select(((F.col("path") + 1) % 10).alias("path"), "frame_no", "vec")
    head = other.filter("frame_no < 10")
    spliced = head.union(f.select("path", (F.col("frame_no") + 10 + F.when(F.col("frame_no") >= 20, 12).otherwise(0)).alias("frame_no"), "vec")).union(other.filter("frame_no between 20 and 31").select("path", (F.col("frame_no") + 10).alias("frame_no"), "vec"))
    both = f.withColumn("path", F.concat(F.lit("a"), "path")).union(spliced.withColumn("path", F.concat(F.lit("b"), "path")))
    pairs = f.select(F.concat(F.lit("a"), "path").alias("a"), F.concat(F.lit("b"), "path").alias("b")).distinct()
    found = align.align_pairs(pairs, both, TH, fps=0.5).select("a", "b", "video.*")
    return longs(found.withColumns({c: F.round(c, 6) for c in ("score", "coverage", "extra_ratio", "interleaved_ratio")}), "superset_dir", "ad_dir")


@query(
    """
    with recursive cuts as (select user_id % 60 as p, epoch_us(ts) / 1e6 as t from events),
    gaps as (select p, i, greatest(g, 0.0) as g from (select p, row_number() over (partition by p order by t) - 1 as i, t - lag(t) over (partition by p order by t) as g from cuts) where g is not null),
    sizes as (select p, count(*) as c from gaps group by p),
    ends as (select distinct p as a, (p + 1) % 60 as b from cuts),
    pairs as (select * from (select a, b, x.c as n, y.c as m, cast(greatest(25, ceil(0.2::double * greatest(x.c, y.c))) as bigint) as band from ends join sizes x on x.p = a join sizes y on y.p = b) where abs(n - m) <= band),
    dp as (
      select a, b, n, m, band, cast(1 as bigint) as i, j, total - 0.2::double as v from (
        select *, sum(cost + 0.2::double) over (partition by a order by j) as total from (
          select a, b, n, m, band, y.i as j, least(1.0::double, abs(x.g - y.g) / (x.g + y.g + 1e-6)) as cost from pairs join gaps x on x.p = a and x.i = 1 join gaps y on y.p = b and y.i <= 1 + band))
      union all
      select a, b, n, m, band, i, j, total + min(enter - total) over (partition by a order by j) as v from (
        select *, sum(cost + 0.2::double) over (partition by a order by j) as total from (
          select q.a, q.b, q.n, q.m, q.band, q.i, q.j, least(1.0::double, abs(x.g - y.g) / (x.g + y.g + 1e-6)) as cost, least(1.0::double, abs(x.g - y.g) / (x.g + y.g + 1e-6)) + q.c as enter from (
            select a, b, n, m, band, i + 1 as i, j + o as j, min(v + case when o = 0 then 0.2::double else 0.0 end) as c from dp, (values (0), (1)) as s(o) where i < n group by all
          ) q join gaps x on x.p = q.a and x.i = q.i join gaps y on y.p = q.b and y.i = q.j where q.j between greatest(1, q.i - q.band) and least(q.m, q.i + q.band)))
    )
    select ends.a::varchar as a, ends.b::varchar as b, round(case when v is null then 0.0 else greatest(0.0, least(1.0, 1 - v / greatest(n, m))) end, 6) as score, round(coalesce(least(n, m) / greatest(n, m)::double, 0.0), 6) as coverage
    from ends left join (select * from dp where i = n and j = m) d on d.a = ends.a
    """
)
def scene_dtw(spark, sf):
    """Event times of users against the next user's, as cut times."""
    e = table(spark, sf, "events").select((F.col("user_id") % 60).cast("string").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    cuts = e.groupBy("path").agg(F.sort_array(F.collect_list("t")).alias("scene_cuts"))
    pairs = cuts.select(F.col("path").alias("a"), ((F.col("path").cast("int") + 1) % 60).cast("string").alias("b"))
    return align.align_scenes(pairs, cuts, TH).select("a", "b", F.round("scenes.score", 6).alias("score"), F.round("scenes.coverage", 6).alias("coverage"))


@query(
    """
    with items as (select path, x, row_number() over (partition by path order by ts, x) - 1 as i from (select user_id % 20 as path, ts, (event_id * 2654435761) % 4294967296 as x from events)),
    ends as (select path, count(*) as m from items group by path),
    s as (select a.path as a, b.path as b, b.i - a.i as off, count(*) as n, sum(bit_count(xor(a.x, b.x))) as bits from items a join items b on a.path < b.path and b.i - a.i between -2400 and 2400 group by all),
    r as (select *, 1 - bits / (32.0::double * n) as sim from s where n >= 64),
    best as (select * from (select *, row_number() over (partition by a, b order by sim desc, off) as k from r) where k = 1 and sim > 0)
    select x.path as a, y.path as b, round(coalesce(sim, 0.0), 9) as score, coalesce(off / 8.0::double, 0.0) as offset_s, round(coalesce(n / least(x.m, y.m)::double, 0.0), 9) as coverage
    from ends x join ends y on x.path < y.path left join best on best.a = x.path and best.b = y.path
    """
)
def audio_fft(spark, sf):
    """Offset search by cross-correlation; the oracle is the relational form."""
    items = table(spark, sf, "events").select((F.col("user_id") % 20).alias("path"), "ts", (F.col("event_id") * 2654435761 % 4294967296).alias("x"))
    prints = items.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "x"))), lambda s: s["x"]).alias("audio_fp"))
    pairs = prints.select(F.col("path").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("b")).filter("a < b").join(prints.select(F.col("path").alias("b")), "b", "left_semi").select("a", "b")
    return align.align_audio(pairs, prints, TH.override(min_overlap_s=8.0)).select("a", "b", F.round("audio.score", 9).alias("score"), "audio.offset_s", F.round("audio.coverage", 9).alias("coverage"))


_SIGNALS_SQL = """
    signals as (select o_orderkey as k, (o_custkey % 5)::varchar as hash_a, (o_orderkey % 5)::varchar as hash_b, o_custkey % 3 as size_a, o_orderkey % 3 as size_b,
      5.0 + o_orderkey % 100 as dur_a, 5.0 + o_custkey % 90 as dur_b, (o_orderkey % 9) / 100.0::double as density_a, (o_custkey % 9) / 100.0::double as density_b,
      (o_orderkey % 21) / 20.0::double as a_score, (o_custkey % 41) / 40.0::double as v_score, (o_orderkey % 11) / 10.0::double as v_coverage, o_orderkey % 8 = 0 as superset, (o_custkey % 17) / 16.0::double as s_score from orders)
"""
_TREE_SQL = """
    case when hash_a = hash_b and size_a = size_b then 'T0' when least(dur_a, dur_b) >= 15 and v_score >= 0.75 and superset then 'edition'
      when v_score >= 0.75 and v_coverage >= 0.7 and v_coverage * (least(dur_a, dur_b) / greatest(dur_a, dur_b)) < 0.5 then 'contains'
      when least(dur_a, dur_b) >= 15 and a_score >= 0.8 and v_score >= 0.75 and v_coverage >= 0.7 then 'T1'
      when least(dur_a, dur_b) >= 15 and v_score >= 0.85 and v_coverage >= 0.7 and a_score < 0.3 then 'T2'
      when least(dur_a, dur_b) >= 15 and v_score >= 0.75 and v_coverage >= 0.7 and s_score >= 0.7 then 'T3'
      when s_score >= 0.8 and v_score < 0.75 and density_a >= 0.04 and density_b >= 0.04 then 'T4' when v_score >= 0.75 and v_coverage >= 0.7 then 'T4b' else 'T5' end as tier
"""
_VERDICT_SQL = "case tier when 'T0' then 'CERTAIN' when 'T1' then 'CERTAIN' when 'T2' then 'VERY_HIGH' when 'T3' then 'HIGH' when 'T4' then 'PROBABLE' when 'T4b' then 'PROBABLE' when 'edition' then 'DIFFERENT_EDITION' when 'contains' then 'CONTAINS' else 'DIFFERENT' end as verdict"


def signals(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        k.alias("k"), (c % 5).cast("string").alias("hash_a"), (k % 5).cast("string").alias("hash_b"), (c % 3).alias("size_a"), (k % 3).alias("size_b"),
        (k % 100 + 5.0).alias("dur_a"), (c % 90 + 5.0).alias("dur_b"), (k % 9 / 100.0).alias("density_a"), (c % 9 / 100.0).alias("density_b"),
        (k % 21 / 20.0).alias("a_score"), (c % 41 / 40.0).alias("v_score"), (k % 11 / 10.0).alias("v_coverage"), (k % 8 == 0).alias("superset"), (c % 17 / 16.0).alias("s_score"),
    )


@query(
    f"""
    with {_SIGNALS_SQL}, t as (select *, {_TREE_SQL} from signals)
    select k, tier, {_VERDICT_SQL}, case tier when 'T0' then 1.0 when 'T1' then 0.99 when 'T2' then 0.95 when 'T3' then 0.88 when 'T4' then 0.65 when 'T4b' then 0.55 when 'edition' then least(0.9, v_score) when 'contains' then least(0.85, v_score) else 0.0 end::double as confidence from t
    """
)
def decision_tree(spark, sf):
    return decide.decide(signals(spark, sf), TH).select("k", "tier", "verdict", "confidence")


@query(f"with {_SIGNALS_SQL}, t as (select *, {_TREE_SQL} from signals), v as (select {_VERDICT_SQL} from t) select case when verdict in ('CERTAIN', 'VERY_HIGH', 'HIGH') then 'duplicate' when verdict = 'PROBABLE' then 'review' when verdict in ('DIFFERENT_EDITION', 'CONTAINS') then 'editions' else 'none' end as route, verdict, count(*) as n from v group by all")
def verdict_routing(spark, sf):
    return decide.decide(signals(spark, sf), TH).groupBy(decide.route(F.col("verdict")).alias("route"), "verdict").agg(F.count("*").alias("n"))


@query(f"with {_SIGNALS_SQL} select k, v_coverage * (least(dur_a, dur_b) / greatest(dur_a, dur_b)) as cov_long, v_score >= 0.75 and v_coverage >= 0.7 as needs_audio from signals")
def cov_long(spark, sf):
    return signals(spark, sf).select("k", S.long_coverage(F.col("v_coverage"), F.col("dur_a"), F.col("dur_b")).alias("cov_long"), decide.needs_audio(TH).alias("needs_audio"))


_MATCH_SQL = "matches as (select o_orderkey % 500 as a, o_custkey % 500 as b, o_orderkey as k, o_orderstatus as verdict, (o_orderkey % 100)::double as ad_offset_s, cast(o_orderkey % 3 - 1 as int) as ad_dir from orders where o_orderkey % 500 <> o_custkey % 500)"


def matches(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").filter(k % 500 != c % 500).select((k % 500).alias("a"), (c % 500).alias("b"), k.alias("k"), F.col("o_orderstatus").alias("verdict"), (k % 100).cast("double").alias("ad_offset_s"), (k % 3 - 1).cast("int").alias("ad_dir"))


@query(f"with {_MATCH_SQL} select least(a, b) as a, greatest(a, b) as b, k, verdict, case when a > b then -ad_offset_s else ad_offset_s end as ad_offset_s, case when a > b then -ad_dir else ad_dir end as ad_dir from matches")
def sign_flip(spark, sf):
    return decide.canonical_match(matches(spark, sf))


@query(f"with {_MATCH_SQL}, c as (select least(a, b) as a, greatest(a, b) as b, k, verdict from matches) select a, b, k, verdict from (select *, row_number() over (partition by a, b order by k desc) as r from c) where r = 1")
def match_upsert(spark, sf):
    rows = decide.canonical_match(matches(spark, sf)).select("a", "b", "k", "verdict")
    last = lambda d: store.latest(d, ["a", "b"], [F.desc("k")])
    cut = rows.agg(F.expr("cast(percentile(k, 0.5) as bigint)")).first()[0] or 0  # later rows come as an upsert on earlier ones
    return store.upserted(last(rows.filter(F.col("k") <= cut)), last(rows.filter(F.col("k") > cut)), ["a", "b"])


@query(f"with {_MATCH_SQL} select m.k from matches m where not exists (select 1 from matches d where d.verdict = 'P' and least(d.a, d.b) = least(m.a, m.b) and greatest(d.a, d.b) = greatest(m.a, m.b))")
def delete_on_different(spark, sf):
    rows = matches(spark, sf)
    return store.delete_on_different(rows, rows.filter("verdict = 'P'").withColumn("verdict", F.lit("DIFFERENT"))).select("k")


@query(f"with {_MATCH_SQL} select k from matches where a % 10 <> 4 and b % 10 <> 4")
def forget_paths(spark, sf):
    rows = matches(spark, sf)
    return store.without_paths(rows, rows.filter("a % 10 = 4").select(F.col("a").alias("path")).union(rows.filter("b % 10 = 4").select("b")), ["a", "b"]).select("k")


_GRAPH_SQL = "edges as (select doc_id as a, doc_id - doc_id % 16 + (doc_id * 7 + n_chars) % 16 as b from documents)"
_REACH_SQL = "both_ as (select a, b from edges union select b, a from edges), reach as (select a as x, a as y from both_ union select r.x, e.b from reach r join both_ e on e.a = r.y), comp as (select x as id, min(y) as component from reach group by x)"


def edges(spark, sf):
    """Each document with another one of its sixteen."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(d.alias("a"), (d - d % 16 + (d * 7 + F.col("n_chars")) % 16).alias("b"))


@query(f"with recursive {_GRAPH_SQL}, {_REACH_SQL} select id, component, ('0x' || substr(sha256(component::varchar), 1, 14))::bigint as cluster_id from comp")
def connected_components(spark, sf):
    return components(edges(spark, sf)).withColumn("cluster_id", cluster_name(F.col("component")))


@query()
def connected_components_long(spark, sf):
    """A graph of few large components. Without an oracle, as its closure grows with the square of them; the tests use union-find."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("a"), ((F.col("doc_id") * 7 + 3) % 1009).alias("b"))
    return components(rows).withColumn("cluster_id", cluster_name(F.col("component")))


@query(f"with recursive {_GRAPH_SQL}, {_REACH_SQL} select component, sha256(string_agg(id::varchar, chr(31) order by id::varchar)) as members_key from comp group by 1")
def cluster_membership(spark, sf):
    return membership_key(components(edges(spark, sf)), "component", "id")


@query("with g as (select source as c, doc_id from documents) select least(x.doc_id, y.doc_id) as a, greatest(x.doc_id, y.doc_id) as b from g x join g y using (c) where x.doc_id % 7 = 1 and y.doc_id % 7 <> 1")
def split_veto_pairs(spark, sf):
    g = table(spark, sf, "documents").select(F.col("source").alias("cluster_id"), F.col("doc_id").alias("path"))
    return split_vetoes(g, g.filter("path % 7 = 1"))


@query("select distinct source as cluster_id from documents where doc_id % 97 = 1")
def affected_clusters(spark, sf):
    g = table(spark, sf, "documents").select(F.col("source").alias("cluster_id"), F.col("doc_id").alias("path"))
    return touched_clusters(g, g.filter("path % 97 = 1"))
