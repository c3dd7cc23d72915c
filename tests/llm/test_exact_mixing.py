"""Exact dedup and mixing."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from compare import check
from twinloom.llm import common, exact_dedup, mixing, queries

DDL = "doc_id long, text string, source string"
BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op3_mixing", "op6_exact_dedup"])
def test_oracle(spark, sf, name):
    check(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def brute_dedup(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0))
    out = []
    for i, t, *_ in rows:
        own = groups[norm := BLANK.sub("", t or "")]
        best = min(own)
        keep = None if best[1] else best[2]
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def dedup_rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


CASES = [
    [],
    [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "x", "a")],
    [(5, "a b", "s"), (3, "ab", "s"), (4, "a  b", "s"), (2, "a\x0bb ", "s"), (1, "a\u00a0b", "s")],
    [(7, "same", "s"), (7, "same", "s"), (9, "same", "s")],
    [(None, "n", "s"), (2, "n", "s"), (None, "m", "s")],
    [(i, "long " * 5000 if i % 2 else "é" * 70000, "s") for i in range(6)],
    [(i, "hot", "s") for i in range(500)],
]


@pytest.mark.parametrize("rows", CASES)
def test_dedup_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, DDL).withColumn("digest", F.lit("clash")).withColumn("n", F.lit(0))
    assert dedup_rows(exact_dedup.dedup(df)) == brute_dedup(rows)


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.unhex(F.lit("00" * 32)))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b "), (5, "c")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_index_takes_batches(spark):
    index = exact_dedup.MergeIndex(spark)
    for rows in ([(5, "a"), (6, "b")], [(1, "a"), (2, "c")]):
        index.append(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.best.id, r.n) for r in index.compact().collect()) == [(1, 2), (2, 1), (6, 1)]
    found = index.lookup([hashlib.sha256(b"a").digest(), hashlib.sha256(b"none").digest()])
    assert sorted(r.best.id for r in found.collect()) == [1, 5]
    assert "PushedFilters: [In(digest" in found._jdf.queryExecution().toString() or "In(digest" in found._jdf.queryExecution().executedPlan().toString()


def test_many_batches_are_probed_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SENT_FILTERS", 4)
    index = exact_dedup.MergeIndex(spark)
    for b in range(3):
        index.append(spark.createDataFrame([(10 * b + i, f"text {(b + 1) * i}") for i in range(10)], "doc_id long, text string"))
    want = {}
    for b in range(3):
        for i in range(10):
            want.setdefault((b + 1) * i, []).append(10 * b + i)
    assert sorted((r.best.id, r.n) for r in index.compact().collect()) == sorted((min(x), len(x)) for x in want.values())


def test_only_entries_that_the_filters_find_are_merged(spark):
    index = exact_dedup.MergeIndex(spark)
    rows = [(i, f"text {i % 900}") for i in range(1000)]
    index.append(spark.createDataFrame(rows, "doc_id long, text string"))
    runs = index.runs[0].collect()
    assert {r.run for r in runs} == set(range(exact_dedup.MEMTABLES)) and sum(r.n for r in runs) == 1000
    for run in range(exact_dedup.MEMTABLES):  # sorted within a file, a digest once in a run
        own = [bytes(r.digest) for r in runs if r.run == run]
        assert len(own) == len(set(own))
    assert sorted((r.best.id, r.n) for r in index.compact().collect()) == [(i, 2 if i < 100 else 1) for i in range(900)]
    others = index.filters[0].filter("run > 0").groupBy("_f_bucket").agg(F.bitmap_or_agg("_f_bits").alias("_f_bits"))
    probed = common.in_bits(index.runs[0].filter("run = 0"), "digest", others).collect()
    elsewhere = {bytes(r.digest) for r in runs if r.run > 0}
    assert all(r._found for r in probed if bytes(r.digest) in elsewhere) and sum(r._found for r in probed) < len(probed) / 2


def test_filter_lets_all_wanted_pass(spark):
    rows = spark.range(5000)
    wanted = spark.range(0, 5000, 50)
    got = {r.id for r in common.maybe_in(rows, "id", wanted, "id").collect()}
    assert got >= set(range(0, 5000, 50)) and len(got) < 200


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share by weight, cut at the cap, share again: as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, out = sum(sizes.values()) * share, set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        rest = left - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else rest * weight[s] / total for s in names}
        above = [s for s in open_ if out[s] > cap * sizes[s] + 1e-9]
        if not above:
            return out
        full |= set(above)
        if len(full) == len(names):
            return {s: cap * sizes[s] for s in names}


@pytest.mark.parametrize("counts", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 50, "c": 3, "d": 900, "é": 5, None: 7, "Z": 20}, {"a": 0, "b": 5}, {None: 3}, {f"s{i}": (i * 37) % 11 for i in range(30)}])
def test_targets_equal_water_filling(spark, counts):
    sizes = spark.createDataFrame(list(counts.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    want = water_fill(counts)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_plan_and_mix(spark):
    rows = [(i, "w " * (1 + i % 9), ["big", "big", "small", None][i % 4]) for i in range(4000)] + [(5000, None, "big"), (5001, "", "void"), (None, "a b", "big")]
    docs = spark.createDataFrame(rows, DDL).withColumn("rate", F.lit("clash")).withColumn("copy", F.lit("clash")).withColumn("size", F.lit(1))
    planned = mixing.plan(docs).collect()
    assert len(planned) == len(rows)
    again = {r.doc_id: r.copies for r in mixing.plan(docs.repartition(7)).collect()}
    taken, target = {}, {}
    source = {i: s for i, _, s in rows}
    for r in planned:
        assert 0 <= r.copies <= 2 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and again[r.doc_id] == r.copies
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.copies * r.size
        target[source[r.doc_id]] = r.target
    assert all(taken[s] == pytest.approx(target[s], rel=0.06, abs=3) for s in target)
    copies = {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.copies for r in planned if r.copies}
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "rate", "size", "copy"]


def test_phase_is_the_nearest_to_the_target(spark):
    """Sources of 60 documents with some long ones: of all steps the one that misses least, by hand."""
    import random

    r = random.Random(4)
    rows = [(i, "w " * int(r.paretovariate(1.5) * 20), f"s{i % 12:02d}") for i in range(12 * 60)]
    by, independent, chosen = {}, [], []
    for p in mixing.plan(spark.createDataFrame(rows, DDL)).collect():
        by.setdefault(rows[p.doc_id][2], []).append(p)
    for own in by.values():
        target, rate = own[0].target, own[0].rate
        draws = [int(hashlib.md5(f"mix-1:{p.doc_id}".encode()).hexdigest()[:13], 16) / 2**52 for p in own]
        totals = [sum(p.size * (math.floor(rate) + ((d + k / 64) % 1 < rate % 1)) for p, d in zip(own, draws, strict=True)) for k in range(64)]
        best = min(range(64), key=lambda k: (abs(totals[k] - target), k))
        assert [p.copies for p in own] == [math.floor(rate) + ((d + best / 64) % 1 < rate % 1) for d in draws]
        chosen.append(abs(totals[best] - target) / target)
        independent.append(abs(totals[0] - target) / target)
    assert max(independent) > 0.1 and sum(chosen) < sum(independent) / 5


def test_rates_that_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), ["big", "big", "small", None][i % 4]) for i in range(300)], DDL)
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = order(mixing.plan(docs)), order(mixing.mix(docs))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert (order(mixing.plan(docs)), order(mixing.mix(docs))) == want


def test_mixing_nothing(spark):
    docs = spark.createDataFrame([], DDL)
    assert mixing.plan(docs).count() == mixing.mix(docs).count() == 0
