"""Graph, candidates, verdicts, ranking, names and calibration on small tables."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom import config
from twinloom.config import Thresholds
from twinloom.functions import scalar as S
from twinloom.operators import blocking, calibrate, cluster, decide, names, rank, views
from twinloom.operators.graph import components

TH = Thresholds()


def comps(spark, edges):
    """By union-find in one task and by rounds of joins."""
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = ({r.id: r.component for r in components(df, small=n).collect()} for n in (10**6, -1))
    assert one == many
    return one


@pytest.mark.parametrize(
    "edges",
    [[(1, 2), (2, 3), (3, 1)], [(0, i) for i in range(1, 40)], [(i, i + 1) for i in range(60)], [(5, 5)], [(1, 2), (1, 2), (2, 1), (9, 8), (7, 7)], [(i * 7 % 101, i * 13 % 101) for i in range(60)]],
)
def test_components(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert comps(spark, edges) == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert comps(spark, []) == {} and comps(spark, [(None, 1)]) == {}


def test_clusters_veto_and_verdicts(spark):
    m = spark.createDataFrame([("a", "b", "CERTAIN"), ("b", "c", "HIGH"), ("c", "d", "CONTAINS"), ("e", "f", "NAME_COPY"), ("f", "g", "PROBABLE")], "a string, b string, verdict string")
    veto = spark.createDataFrame([("c", "b")], "a string, b string")
    groups = lambda d: {frozenset(r.m) for r in d.groupBy("cluster_id").agg(F.collect_list("path").alias("m")).collect()}
    assert groups(cluster.clusters(m)) == {frozenset("abc"), frozenset("ef")}
    assert groups(cluster.clusters(m, veto)) == {frozenset("ab"), frozenset("ef")}
    ids = lambda d: {r.path: r.cluster_id for r in d.collect()}
    assert ids(cluster.clusters(m)) == ids(cluster.clusters(m.union(m).repartition(5)))


def test_reuse_by_members(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "cluster_id long, path string")
    old = cluster.membership_key(spark.createDataFrame([(9, "b"), (9, "a")], "cluster_id long, path string")).select("members_key", F.lit("a").alias("keep"), F.lit("r").alias("rank_reason"))
    known, todo = cluster.reuse_rank(new, old)
    assert [r.cluster_id for r in known.collect()] == [1] and [r.cluster_id for r in todo.collect()] == [2]


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(40, 6)).round(3)
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for x in blocking.top_k(df, df, 5).collect():
        got.setdefault(x.id, {})[x.rank] = x.other
    for i, x in enumerate(v):
        s = np.round(v @ x, 12)
        assert [got[i][k] for k in range(1, 6)] == sorted(range(40), key=lambda j: (-s[j], j))[:5]
    assert set(got) == set(range(40))


@pytest.mark.parametrize("tolerance", [0.03, 0.3])
def test_duration_pairs_equal_brute_force(spark, tolerance):
    v = [0.0, 0.0, -3.0, 1.0, 1.03, 0.97, 100.0, 103.0, 97.0, 96.9, 1e6, 1.03e6, 130.0]
    df = spark.createDataFrame(list(enumerate(v)) + [(50, None)], "k long, d double")
    got = sorted((r.a, r.b) for r in blocking.duration_pairs(df, "k", "d", tolerance).collect())
    want = sorted((i, j) for i, x in enumerate(v) for j, y in enumerate(v) if i != j and (x * (1 - tolerance) <= y <= x * (1 + tolerance) if x > 0 else x == y))
    assert got == want


def test_gate_lets_unindexed_pass(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "path long, vec array<float>")
    assert sorted(r.b for r in blocking.cosine_gate(pairs, vecs, 0.7).collect()) == [2, 4]
    assert blocking.cosine_gate(pairs, vecs, 0.0) is pairs


CASES = [
    (dict(hash_a="x", hash_b="x", size_a=1, size_b=1, v_score=0.0), "T0", 1.0),
    (dict(v_score=0.95, v_coverage=1.0, superset=True), "edition", 0.90),
    (dict(v_score=0.8, v_coverage=0.9, dur_a=100.0, dur_b=1000.0), "contains", 0.8),
    (dict(v_score=0.8, v_coverage=0.9, a_score=0.9), "T1", 0.99),
    (dict(v_score=0.9, v_coverage=0.9, a_score=0.1), "T2", 0.95),
    (dict(v_score=0.8, v_coverage=0.9, a_score=0.5, s_score=0.75), "T3", 0.88),
    (dict(v_score=0.1, s_score=0.9, density_a=0.1, density_b=0.1), "T4", 0.65),
    (dict(v_score=0.1, s_score=0.9, density_a=0.1, density_b=0.01), "T5", 0.0),
    (dict(v_score=0.9, v_coverage=0.9, a_score=0.9, dur_a=5.0, dur_b=5.0), "T4b", 0.55),
    (dict(v_score=0.9, v_coverage=0.9, dur_a=0.0, dur_b=0.0), "T4b", 0.55),
    (dict(v_score=0.9, v_coverage=0.1, a_score=0.9), "T5", 0.0),
    (dict(hash_a="x", hash_b="x", size_a=1, size_b=2), "T5", 0.0),
]


@pytest.mark.parametrize("case,tier,confidence", CASES)
def test_tiers(spark, case, tier, confidence):
    full = {**decide.DEFAULTS, "hash_a": "p", "hash_b": "q", "size_a": 1, "size_b": 1, **case}
    ddl = "hash_a string, hash_b string, size_a int, size_b int, dur_a double, dur_b double, density_a double, density_b double, a_score double, v_score double, v_coverage double, superset boolean, s_score double"
    row = decide.decide(spark.createDataFrame([tuple(full[c.split()[0]] for c in ddl.split(", "))], ddl)).first()
    assert (row.tier, row.confidence) == (tier, pytest.approx(confidence))


def test_canonical_match_flips_directions(spark):
    m = spark.createDataFrame([("b", "a", 45.0, 1), ("a", "b", 45.0, 1), ("b", "a", None, 0)], "a string, b string, ad_offset_s double, ad_dir int")
    got = decide.canonical_match(m).collect()
    assert [(r.a, r.b, r.ad_offset_s, r.ad_dir) for r in got] == [("a", "b", -45.0, -1), ("a", "b", 45.0, 1), ("a", "b", None, 0)]


def keep(spark, rows):
    m = spark.createDataFrame(rows, "path string, score double, audio_coverage double, clip double, cast_ double")
    m = m.withColumn("cluster_id", F.lit(1)).withColumn("color", F.struct("clip", F.col("cast_").alias("cast"), F.lit(0.3).alias("saturation"), F.lit(0.3).alias("contrast")))
    m = rank.ranked(m)
    return rank.keep_by_color(m, rank.keep_by_audio(m, TH), TH).first()


def test_keep_rules(spark):
    assert keep(spark, [("movie (1).avi", 5.0, 1.0, 0.0, 0.0), ("movie.avi", 5.0, 1.0, 0.0, 0.0)]).keep == "movie.avi"
    assert keep(spark, [("best", 9.0, 0.1, 0.0, 0.0), ("next", 5.0, 0.9, 0.0, 0.0)]).keep == "next"
    r = keep(spark, [("best", 9.0, 0.1, 0.0, 0.0), ("next", 5.0, 0.5, 0.0, 0.0)])
    assert r.keep == "best" and r.audio_warning
    assert not keep(spark, [("best", 9.0, 0.1, 0.0, 0.0), ("next", 5.0, 0.12, 0.0, 0.0)]).audio_warning
    assert keep(spark, [("best", 9.0, 1.0, 0.26, 0.9), ("orig", 5.0, 1.0, 0.01, 0.1)]).keep == "orig"
    assert keep(spark, [("best", 9.0, 1.0, 0.04, 0.9), ("orig", 5.0, 1.0, 0.01, 0.1)]).keep == "best"
    assert keep(spark, [("best", 9.0, 1.0, 0.26, 0.9), ("mute", 5.0, 0.1, 0.01, 0.1)]).keep == "best"


def test_names(spark):
    paths = ["/v/movie.avi", "/v/movie (1).avi", "/v/movie(2).avi", "/v/Movie (1) (1).avi", "/v/Film (2009).avi", "/v/Film.avi", "/w/movie.avi", "/v/x CD1.avi", "/v/x CD2.avi", "/v/movie (1).mkv"]
    got = {(r.a, r.b) for r in names.name_siblings(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("/v/movie.avi", "/v/movie (1).avi"), ("/v/movie.avi", "/v/movie(2).avi"), ("/v/movie.avi", "/v/Movie (1) (1).avi")}
    sib = spark.createDataFrame([("b", "a"), ("c", "d"), ("e", "f")], "a string, b string")
    matches = spark.createDataFrame([("c", "d")], "a string, b string")
    content = spark.createDataFrame([("a", "b", "PROBABLE"), ("e", "f", "DIFFERENT")], "a string, b string, verdict string")
    assert [(r.a, r.b, r.verdict) for r in names.name_copies(sib, matches, content).collect()] == [("a", "b", "NAME_COPY")]


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        S.clean_title(F.lit("/x/The.Movie.(2009).1080p.x264-GRP.mkv")).alias("title"), S.duration_text(F.lit(185742)).alias("d"), S.clock_seconds(F.lit("51:41:54")).alias("c"), S.clock_seconds(F.lit("x")).alias("c0"),
        S.parse_fingerprint(F.lit("DURATION=3\nFINGERPRINT=1,-1,4294967295")).alias("fp"), S.volume_anchor(F.lit("D:\\a\\b")).alias("v"), S.volume_anchor(F.lit("x")).alias("v0"), S.canonical_path(F.lit("/a//b/./c/")).alias("p"),
        S.longer_fingerprint(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("lf"), S.coverage_points(F.lit(-1.0)).alias("n"), S.extension(F.lit("/a.b/c")).alias("e"),
        S.bitrate_cam(F.lit(None).cast("int"), F.lit(1), F.lit(1)).alias("cam"), S.sampled_hash(F.lit("abc"), F.lit(3), 2).alias("h"),
    ).first()
    assert row.title == "The Movie 2009" and row.d == "2d 03:35:42" and row.c == 186114 and row.c0 == 0 and row.fp == [1, 2**32 - 1, 2**32 - 1]
    assert row.v == "D:" and row.v0 == "" and row.p == "/a/b/c" and row.lf == [1, 2] and row.n == 8 and row.e == "" and row.cam is None and len(row.h) == 32


def test_probe_of_container_without_stream_values(spark):
    body = '{"streams":[{"codec_type":"video","codec_name":"hevc","width":3840,"height":2160},' + ",".join(['{"codec_type":"audio","index":"%d","channels":2}' % i for i in range(15)]) + '],"format":{"duration":"8297.504","bit_rate":"78901234"}}'
    p = spark.createDataFrame([(body,), ("not json",), (None,)], "b string").select(S.parse_probe(F.col("b")).alias("p")).collect()
    assert p[0].p.duration_s == 8297.504 and p[0].p.bitrate_kbps == 78901 and len(p[0].p.audio_tracks) == 15 and p[0].p.audio_tracks[0].lang_tag is None
    assert p[1].p.duration_s == 0.0 and p[1].p.vcodec == "" and p[1].p.bitrate_kbps is None and p[2].p.audio_tracks == []


def test_calibration_refuses_one_sided_labels(spark):
    ddl = "label string, a_score double, v_score double, v_coverage double, s_score double"
    same = [("same", 0.9, 0.9, 0.9, 0.9)] * 3
    r = calibrate.suggest(spark.createDataFrame(same, ddl)).first()
    assert r.degenerate and r.theta_v == TH.theta_v and r.false_positives is None
    r = calibrate.suggest(spark.createDataFrame([*same, ("different", 0.9, 0.72, 0.9, 0.1)], ddl)).first()
    assert not r.degenerate and r.false_positives == 0 and r.recall == 1.0 and r.theta_v == 0.5 and r.theta_a == 0.95
    genre = spark.createDataFrame([("different", 0.0, 0.0, 0.0, 0.0, " ")], ddl + ", genre string")
    g = calibrate.confusion_by_genre(genre).first()
    assert g.genre == "(unlabeled)" and g.precision is None and g.recall is None


def test_fingerprints_follow_thresholds():
    assert config.fingerprint(TH) == config.fingerprint(Thresholds()) != config.fingerprint(TH.override(theta_v=0.7))


def test_sorts(spark):
    s = spark.createDataFrame([("b", 2, 5), ("a", 2, 9), ("c", 3, 1)], "title string, n_copies int, reclaimable int")
    assert [r.title for r in views.sort_clusters(s, "copies").collect()] == ["c", "a", "b"] == [r.title for r in views.sort_clusters(s, "?").collect()]
    assert [r.title for r in views.sort_clusters(s, "space").collect()] == ["a", "b", "c"]


def test_inverted_lists_recall_and_whole_index(spark):
    """Against brute force: recall of at least 0.9 with three quarters of the lists (the vectors form no clusters), all with all."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = e.filter("id % 50 = 0")
    exact = {(r.id, r.other) for r in blocking.top_k(asked, e, 10).collect()}
    centres = blocking.fitted_lists(e, 16)
    by = lambda probes: {(r.id, r.other) for r in blocking.top_k_by_lists(asked, e, 10, centres, probes).collect()}
    assert len(exact & by(12)) >= 0.9 * len(exact)
    assert by(16) == exact


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    rows = [(i, 100.0 if i < 60 else 95.0 + i) for i in range(80)] + [(90, 0.0), (91, 0.0), (92, None)]
    df = spark.createDataFrame(rows, "k long, d double")
    want = sorted((r.a, r.b) for r in blocking.duration_pairs(df, "k", "d", 0.03).collect())
    monkeypatch.setattr(blocking, "BUCKET_ITEMS", 7)
    assert sorted((r.a, r.b) for r in blocking.duration_pairs(df, "k", "d", 0.03).collect()) == want
    asked = df.filter("k % 9 = 0")
    assert sorted((r.a, r.b) for r in blocking.duration_pairs(df, "k", "d", 0.03, asked).collect()) == [p for p in want if p[0] % 9 == 0]


def test_connected_components_of_a_long_graph(spark):
    from twinloom.plans import load_all

    sf = "/root/testdata/sf0.01"
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect():
        x, y = sorted((root(r.doc_id), root((r.doc_id * 7 + 3) % 1009)))
        up[y] = x
    assert {r.id: r.component for r in load_all().QUERIES["connected_components_long"](spark, sf).collect()} == {x: root(x) for x in up}


def test_offline_mounts_keep_their_files(spark):
    from twinloom.operators.store import offline_mounts

    there, mounts = {"/lib", "/lib/a"}, {"/lib/nas"}
    missing = spark.createDataFrame([("/lib/a/x",), ("/lib/nas/b/c/y",), ("/lib/gone/d/z",), ("/other/q",)], "path string")
    assert offline_mounts(missing, "/lib/", there.__contains__, mounts.__contains__) == ["/lib/nas"]
    assert offline_mounts(missing, "/lib", there.__contains__, mounts.__contains__, most=2) is None


def _likely(rows, done=(), reviewed=(), most=4, tolerance=0.02):
    """label_candidates by hand; rows are (path, title, duration)."""
    sizes = Counter(t for _, t, _ in rows)
    out = []
    for (a, ta, da), (b, tb, db) in permutations(rows, 2):
        if a >= b or a in reviewed or (a, b) in done or (b, a) in done or ta is None or tb is None:
            continue
        if ta == tb and 2 <= sizes[ta] <= most:
            out.append((a, b, "recall"))
        if ta != tb and da is not None and db is not None and abs(da - db) < max(da, db) * tolerance:
            out.append((a, b, "negative"))
    return sorted(out)


@pytest.mark.parametrize("items, shuffled", [(700, False), (3, False), (3, True)])
def test_label_candidates_equal_brute_force(spark, monkeypatch, items, shuffled):
    r = np.random.default_rng(3)
    durations = [100.0] * 12 + [98.0, 98.0000001, 102.0, 102.04081632653062, 0.0, 0.0, -5.0, -5.0, None, 1e-9, 1.01e-9, 3e8, 3.05e8, 1.0, 0.98, 0.99] + r.uniform(90, 110, 40).round(1).tolist()
    rows = [(int(k), f"t{k % 23}" if k % 11 else None, d) for k, d in zip(r.permutation(len(durations)), durations)]
    rows.append((rows[0][0], "again", 100.0))  # a path of two rows
    df = spark.createDataFrame(rows, "path long, title string, duration double")
    every = _likely(rows)
    done, reviewed = {(b, a) for a, b, _ in every[::3]} | {(a, b) for a, b, _ in every[::7]}, {a for a in range(0, 60, 5)}
    monkeypatch.setattr(blocking, "LIKE_ITEMS", items)
    if shuffled:
        monkeypatch.setattr(blocking, "DECIDED_ROWS", 2)
    decided, seen = spark.createDataFrame(sorted(done), "a long, b long"), spark.createDataFrame([(a,) for a in sorted(reviewed)] * 2, "path long")
    got = lambda *x, **y: sorted(map(tuple, blocking.label_candidates(df, *x, **y).collect()))
    assert got(decided.limit(0)) == every and {k for _, _, k in every} == {"recall", "negative"}
    assert got(decided) == _likely(rows, done)
    assert got(decided, reviewed=seen) == _likely(rows, done, reviewed)


def test_label_candidates_shuffle_items_and_no_pairs(spark, tmp_path):
    """1,500 documents of about one length are a million pairs; before, each was shuffled several times."""
    from twinloom.plans import load_all

    spark.range(1500).select(F.col("id").alias("doc_id"), (10_000 + F.col("id") % 90).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        none = spark._jvm.java.util.ArrayList()
        stages = context.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    load_all().QUERIES["label_candidates"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 800_000
    assert sum(n for stage, n in written().items() if stage not in before) < 100_000
