"""Near-dedup, suffix dedup, sentence spans, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import check
from twinloom.llm import near_dedup, queries, sentence_spans, suffix_dedup

DDL = "doc_id long, text string"


# --- near dedup -------------------------------------------------------------


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {b" ".join(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {b" ".join(w)} if w else set()
    return out


def plain_groups(rows):
    sets = plain_sets(rows)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}


def variant(words, edits, r):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"q{r.randrange(10**6)}"
    return " ".join(out)


def corpus():
    r = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"b{base}w{r.randrange(400)}" for _ in range(120)]
        rows += [(len(rows) + 0, variant(words, k % 5, r)) for k in range(6)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  TWO"), (n + 5, "two one"), (n + 6, "É a b c d e"), (n + 7, "é a b c d e"), (n + 8, "a\u00a0b c"), (n + 9, "x " * 30000), (n + 10, "X\t" * 29990)]


def test_near_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DDL).withColumn("n", F.lit("clash")).withColumn("component", F.lit(1))
    assert near_rows(df) == plain_groups(rows)


@pytest.mark.parametrize("name", ["op8_suffix_dedup", "op9_near_dedup"])
def test_oracle(spark, sf, name):
    check(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def test_near_edges(spark):
    assert near_rows(spark.createDataFrame([], DDL)) == {}
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    got = near_dedup.near_groups(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], DDL)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == [("3", True), ("None", True), ("None", True)]


def test_rows_that_share_an_identifier_are_linked_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(5, a), (5, b), (5, b), (2, b + " end"), (7, a + " more"), (9, c), (9, c), (3, None), (3, c + " x"), (None, a), (4, "own words of the fourth text here")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(spark.createDataFrame(rows, DDL)).collect() if r.doc_id is not None)
    assert got == sorted([(5, 36, 5, True), (5, 36, 2, False), (5, 36, 2, False), (2, 37, 2, True), (7, 37, 5, False), (9, 36, 3, False), (9, 36, 3, False), (3, 0, 3, True), (3, 37, 3, True), (4, 3, 4, True)])


def test_templates_below_the_threshold_don_t_meet(spark):
    """82 shared shingles and 18 own ones: no two are similar, and none meets another at the shared shingles."""
    r = random.Random(8)
    shared = [f"t{i}" for i in range(86)]
    rows = [(i, " ".join([*shared, *(f"u{i}x{j}" for j in range(18))])) for i in range(200)] + [(900, " ".join([*shared, *(f"u900x{j}" for j in range(4))])), (901, " ".join([*shared, *(f"u901x{j}" for j in range(4))]))]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "id long, text string")
    search = type("Search", (), {"docs": docs, "used": []})()
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in near_dedup._prefix_pairs(search, docs.select("id", F.col("id").alias("component"))).collect()}
    sets = plain_sets(rows)
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert want <= got and (900, 901) in want and not {p for p in got if max(p) < 900}


def test_hot_bands_are_joined_exactly(spark, monkeypatch):
    """Bands that many components share go by rare shingles; with a bound of one component all bands that are open do."""
    monkeypatch.setattr(near_dedup, "HOT_COMPONENTS", 1)
    rows = corpus()[:72]
    assert near_rows(spark.createDataFrame(rows, DDL)) == plain_groups(rows)


def test_prefix_pairs_are_complete(spark):
    rows = [(i, t) for i, t in corpus() if t and len(t.split()) < 1000]
    docs = spark.createDataFrame(rows, "id long, text string")
    search = type("Search", (), {"docs": docs, "used": []})()
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in near_dedup._prefix_pairs(search, docs.select("id", F.col("id").alias("component"))).collect()}
    sets = plain_sets(rows)
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert want <= got


def test_sketches_estimate_and_candidates_recall():
    r = np.random.default_rng(0)
    hits = passed = 0
    for _ in range(120):
        both, own = r.integers(0, 2**63, 150, np.uint64), r.integers(0, 2**63, (2, 25), np.uint64)
        m = np.stack([near_dedup.samples(np.unique(np.concatenate([both, o]))) for o in own])  # similarity 0.75
        odd = near_dedup.sketches(m).view(np.uint64)
        passed += int(np.bitwise_count(odd[0] ^ odd[1]).sum()) <= near_dedup.SKETCH_MOST
        keys = near_dedup.band_keys(m)
        hits += bool((keys[0] == keys[1]).any())
    assert passed == 120 and hits == 120
    far = np.stack([near_dedup.samples(r.integers(0, 2**63, 200, np.uint64)) for _ in range(2)])
    odd = near_dedup.sketches(far).view(np.uint64)
    assert int(np.bitwise_count(odd[0] ^ odd[1]).sum()) > near_dedup.SKETCH_MOST


# --- suffix dedup -----------------------------------------------------------


def plain_cut(rows, depth=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, b in rows:
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            if w not in first or key(i) < first[w]:
                first[w] = key(i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            if first[b[s : s + depth]] < key(i):
                gone[s : s + depth] = b"\1" * depth
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cut_rows(df, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(df, **how).collect()), key=repr)


EDGES = [(1000, "ab" * 500), (1001, "ab" * 300 + "x"), (1002, None), (1003, ""), (1004, "a" * 49), (1005, "a" * 50), (1006, "a" * 200), (1007, "é" * 100), (1008, "é" * 26), (1009, "é" * 26), (1009, "é" * 30), (None, "ab" * 60), (None, "n" * 70), (None, "n" * 70)]


def test_cut_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + EDGES
    df = spark.createDataFrame(rows, DDL).withColumn("body", F.lit("clash")).withColumn("kept", F.lit(1))
    assert cut_rows(df) == plain_cut(rows)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_substrings(df.filter("doc_id in (1005, 1006)")).collect()}
    assert kept == {1005: b"a" * 50, 1006: b""}


def test_what_stays_and_how_long_runs_are(spark):
    shared = "".join(random.Random(3).choices("abcdefgh", k=300))
    rows = [(1, "é" + shared), (2, "x" + shared[:260] + "yy" + shared[:70]), (3, "zé" + shared[:49]), (4, None)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.longest_removed, r.n_passages, r.kept_text) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, DDL), kept_bytes=False).collect()}
    # the last byte of é and 49 bytes are a window of the first document; what is left of é is no character
    assert got == {1: (0, 0, 0, 0, rows[0][1]), 2: (330, 2, 260, 1, "xyy"), 3: (51, 1, 51, 0, "z"), 4: (0, 0, 0, 0, "")}


def test_places_in_a_block_do_not_depend_on_the_order_of_arrival():
    import pyarrow as pa

    from twinloom.llm.passes import in_order

    rows = [(3, b"c"), (None, b"z"), (1, b"b"), (1, b"a"), (None, None), (3, None), (2**63 - 1, b"m"), (1, b"a")]
    want = [(1, b"a"), (1, b"a"), (1, b"b"), (3, None), (3, b"c"), (2**63 - 1, b"m"), (None, None), (None, b"z")]
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        table = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "body": pa.array([b for _, b in rows], pa.binary())})
        assert [(r["id"], r["body"]) for r in in_order(table, "body").to_pylist()] == want


@pytest.mark.parametrize("groups,parts", [(1, 1), (13, 4), (100, 7), (64, 64)])
def test_groups_are_dealt_evenly(spark, groups, parts):
    from twinloom.llm import common

    keys = common.even_keys(groups, parts)
    assert len(set(keys)) == groups
    rows = spark.range(groups).withColumn("k", common.dealt(F.col("id"), keys))
    assert [r.k for r in rows.orderBy("id").collect()] == keys
    sizes = [r["count"] for r in rows.repartition(parts, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == min(groups, parts) and max(sizes) - min(sizes) <= 1
    some = np.array([0, 1, -1, 2**40 + 17, -(2**62)], np.int64)
    assert common.spark_hash(some).tolist() == [r[0] for r in spark.createDataFrame([(int(x),) for x in some], "v long").select(F.hash("v")).collect()]


def test_blocks_of_short_texts_only(spark):
    """No block has a window or span to send."""
    rows = [(i, f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, DDL)
    assert cut_rows(df) == plain_cut(rows) and span_rows(df) == plain_spans(rows)


def test_cut_of_nothing(spark):
    assert cut_rows(spark.createDataFrame([], DDL)) == []


@pytest.mark.parametrize("hot", [1, 10**9])
def test_passes_agree_for_hot_anchors(monkeypatch, hot):
    """The passes without Spark, with all anchors hot and with none, in pieces of a few hundred positions."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    r = random.Random(2)
    shared = "".join(r.choice("abcdef ") for _ in range(400))
    rows = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(200))) + shared[i * 7 : i * 7 + 130] + "".join(r.choice("xyz") for _ in range(r.randrange(90)))) for i in range(40)]
    rows += [(100, "zz" * 100), (101, "zz" * 90 + "y"), (50, shared), (102, shared)]
    blocks, buckets, width, depth = 3, 4, 5, 50
    tables = [pa.table({"blk": pa.array([b] * len(own), pa.int64()), "id": pa.array([i for i, _ in own], pa.int64()), "body": pa.array([t.encode() for _, t in own], pa.binary())}) for b in range(blocks) for own in [[x for x in rows if x[0] % blocks == b]]]
    by = lambda t, c: [t.filter(pa.compute.equal(t.column(c), v)) for v in sorted(set(t.column(c).to_pylist()))]
    sent = pa.concat_tables([suffix_dedup._anchor_rows(t, depth, buckets, width) for t in tables])
    again = pa.concat_tables([suffix_dedup.answer(t, width, hot) for t in by(sent, "bucket")])
    runs = pa.concat_tables([suffix_dedup._run_rows((pa.scalar(b),), t, again.filter(pa.compute.equal(again.column("blk"), b)), depth, buckets) for b, t in enumerate(tables)])
    marks = pa.concat_tables([suffix_dedup._marks(t, depth) for t in by(runs, "bucket")])
    got = []
    for b, t in enumerate(tables):
        out = suffix_dedup._with_digest(suffix_dedup._cut(t, marks.filter(pa.compute.equal(marks.column("blk"), b))), False)
        got += [(x["id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out.to_pylist()]
    assert sorted(got, key=repr) == plain_cut(rows)


# --- sentence spans ---------------------------------------------------------


def plain_spans(rows, least=sentence_spans.MIN_SENTENCES, words=sentence_spans.MIN_WORDS):
    """Every run from every sentence, the shortest that is long enough; removal of all that is not first."""
    order = lambda r: (r[0] is None, r[0] or 0)
    seen, found = {}, []
    parts = [(i, sentence_spans.sentences(t or "")) for i, t in rows]
    for row, (i, p) in sorted(enumerate(parts), key=lambda r: order(r[1])):
        full = [k for k, x in enumerate(p) if x.split()]
        for a in range(len(full)):
            for b in range(a + least, len(full) + 1):
                run = [tuple(p[k].lower().split()) for k in full[a:b]]
                if sum(map(len, run)) >= words:
                    at = (order((i, p)), full[a])
                    if seen.setdefault(tuple(run), at) != at:
                        found.append((row, full[a], full[b - 1] + 1))
                    break
    out = []
    for row, (i, p) in enumerate(parts):
        gone = {k for j, a, b in found if j == row and i is not None for k in range(a, b)}
        out.append((i, "".join(x for k, x in enumerate(p) if k not in gone), len(p), len([k for k in gone if k < len(p)])))
    return sorted(out, key=repr)


def span_rows(df):
    return sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in sentence_spans.dedup_spans(df).collect()), key=repr)


def test_spans_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, "No end"), (1003, "One two three four. Five six seven eight nine! Ten.\nOne two three four.\nFive six seven eight nine!"), (1004, "Hi. Hi. Hi. Hi."), (1005, "same. " * 5000), (1006, "same. " * 5000), (None, "One two three four. Five six seven eight nine!")]
    df = spark.createDataFrame(rows, DDL).withColumn("at", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("hits", F.lit(1))
    assert span_rows(df) == plain_spans(rows)


def test_rows_that_share_an_identifier_lose_their_own_spans_only(spark):
    passage = "One two three four five. Six seven eight nine ten."
    rows = [(1, passage), (2, f"{passage} Tail of the second text."), (2, "Other words that repeat nowhere. They are in no other text."), (3, f"Head goes first here. {passage}"), (3, passage), (3, passage)]
    rows += [(None, passage), (None, f"{passage} More.")]
    got = span_rows(spark.createDataFrame(rows, DDL))
    assert got == plain_spans(rows)
    assert (2, rows[2][1], 2, 0) in got and (2, "Tail of the second text.", 3, 2) in got


def test_span_edges(spark):
    assert span_rows(spark.createDataFrame([], DDL)) == []
    twice = [(1, "A b c d e. F g h i j."), (1, "A b c d e. F g h i j."), (2, "A b c d e. F g h i j.")]
    got = sentence_spans.dedup_spans(spark.createDataFrame(twice, DDL)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "A b c d e. F g h i j.")] * 2 + [(2, "")]
    assert [[s.asDict() for s in r.removed_spans] for r in got if r.doc_id == 2] == [[{"first": 0, "n": 2}]]


@pytest.mark.parametrize("sizes", [(20, 34, 17, 1, 1), (2, 10, 24, 1, 6), (3, 3, 3), (1, 1, 9, 1, 1), (5, 1, 1, 1)])
def test_short_ends_of_copies_go(spark, tmp_path, sizes):
    words = iter(f"w{i}" for i in range(99))
    copied = " ".join(" ".join(next(words) for _ in range(n)) + "." for n in sizes)
    rows = [(1, f"{copied} Here the first text goes on by itself, at some length."), (2, copied), (3, f"Own words of the third text stand before it. {copied} And others follow it here.")]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op4_sentence_spans(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "Own words of the third text stand before it. And others follow it here."}


@pytest.mark.parametrize("text", ["", "a", "a.b. c", "x!? \"Y.\" z\n\n w", "\n", "...", "a. " * 50, "e.g. f", ".", ". .\n.", "?!)]\n"])
def test_sentences_join_to_the_text(text):
    assert "".join(sentence_spans.sentences(text)) == text


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline
    from twinloom.llm import decontaminate, exact_dedup, language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    now, kept = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, sf)
        assert new.columns == docs.columns
        now = spark.createDataFrame(new.collect(), docs.schema)
        ids = {r.doc_id for r in now.collect()}
        if name == "language_id":
            want = {i for i, t in kept.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(kept):
                norm = "".join(c for c in kept[i] if c not in " \t\n\x0b\x0c\r")
                if norm not in first or len(kept[i]) > len(kept[first[norm]]):
                    first[norm] = i
            want = set(first.values())
        elif name == "near_dedup":
            want = {i for i, (_, _, stays) in plain_groups(list(kept.items())).items() if stays}
        else:
            items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            whole = {i for i, t in kept.items() if any(f" {' '.join(x)} " in f" {' '.join(decontaminate.words_of(t))} " for x in items)}
            assert ids.isdisjoint(whole) and len(ids) >= 0.9 * len(kept)
            want = ids
        assert ids == want
        kept = {i: kept[i] for i in ids}
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(kept) and max(copies.values()) <= 2 and mixed.columns == [*docs.columns, "copy"]


def test_stages_decide_rows_not_identifiers(spark, sf):
    import corpus_pipeline

    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, "the only text of its kind"), (3, b + " end")]
    docs = spark.createDataFrame(rows, DDL).withColumn("kept", F.lit("x")).withColumn("_node", F.lit(7))
    once = corpus_pipeline.exact(spark, docs, sf)
    assert once.columns == docs.columns
    assert sorted(r.text for r in once.collect()) == sorted([a, b, "the only text of its kind", b + " end"])
    assert sorted(r.text for r in corpus_pipeline.near(spark, once, sf).collect()) in (sorted([a, b, "the only text of its kind"]), sorted([a, b + " end", "the only text of its kind"]))


def test_pipeline_of_odd_tables(spark, sf):
    import corpus_pipeline

    rows = [(None, "the of and", None, None, 3), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "Word " * 50, "en", "s", 5), (3, "Word " * 50, "en", "s", 5), (4, "Other words here " * 9, "en", None, 9), (7, "Clean text of its own", "en", "t", 9)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copy", F.lit("x")).withColumn("kept", F.lit(False))
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            found = docs.collect()
        assert bool(found) == bool(own)
