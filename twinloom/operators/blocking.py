"""Candidate pairs: range blocking, similarity search, union of sources, and what was evaluated before."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import pair_digest
from ..functions.vectors import dot, doubles


def canonical(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs with the smaller end first; loops are dropped."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()


#: Items of a bucket that one task compares with; hotter buckets are dealt over several.
BUCKET_ITEMS = 20_000


def duration_pairs(items: DataFrame, key: str, value: str, tolerance: float, asked: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (a, b) with b's value within a's value * (1 +- tolerance), ends included, a <> b. asked: the keys that a may be
    (all, if None).

    A plain inequality would be a nested loop. Values are put in logarithmic buckets of width -ln(1 - tolerance), so a partner is
    in the same bucket or a neighbour; a's side is exploded to three buckets and joined by equality, the range stays as residual.
    A bucket of more than BUCKET_ITEMS items is dealt over parts, and a's side visits each. Values of zero or less match their equals only.
    """
    width = -math.log(1 - tolerance)
    base = items.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    mine = base if asked is None else base.join(asked.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    right = base.filter("v > 0").select(F.col("k").alias("b"), F.col("v").alias("vb"), _bucket("v", width).alias("bucket"))
    parts = right.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_ITEMS).cast("int").alias("parts"))
    right = right.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    left = mine.filter("v > 0").select(F.col("k").alias("a"), F.col("v").alias("va"), F.explode(F.array(_bucket("v", width) - 1, _bucket("v", width), _bucket("v", width) + 1)).alias("bucket"))
    left = left.join(parts, "bucket").select("a", "va", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = left.join(right, ["bucket", "part"]).filter((F.col("vb") >= F.col("va") * (1 - tolerance)) & (F.col("vb") <= F.col("va") * (1 + tolerance)))
    still = mine.filter("v <= 0").select(F.col("k").alias("a"), F.col("v").alias("va")).join(base.filter("v <= 0").select(F.col("k").alias("b"), F.col("v").alias("vb")), F.col("va") == F.col("vb"))
    return near.select("a", "b").union(still.select("a", "b")).filter("a <> b")


def _bucket(value: str, width: float) -> Column:
    return F.when(F.col(value) > 0, F.floor(F.log(F.col(value)) / width)).cast("long")


#: Bytes of vectors that a block of the searched side may have; more are searched block by block.
SEARCH_BLOCK_BYTES = 64 << 20


def top_k(queries: DataFrame, base: DataFrame, k: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """(id, other, score, rank): the k nearest of base for every query by inner product, itself included; ties by smaller id.

    Blocked matrix products: the base is dealt into blocks of bounded size, each query row visits each block once (a salted
    equi-join, no cross join of rows), every block keeps its own top k, and a window keeps the best k of all blocks. Rows whose
    vector is null or of another length than the first block's are left out.
    """
    spark = base.sparkSession
    n, dim = base.filter(F.size(vec) > 0).agg(F.count("*"), F.max(F.size(vec))).first()
    schema = "id long, other long, score double"
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    blocks = max(1, math.ceil(n * dim * 8 / SEARCH_BLOCK_BYTES))
    n_asked = queries.count()
    # as many parts as keep a group's queries within the same bytes, and the cores busy; never cut off
    parts = max(1, math.ceil(n_asked * dim * 8 / SEARCH_BLOCK_BYTES), min(math.ceil(n_asked / 256), math.ceil(2 * spark.sparkContext.defaultParallelism / blocks)))
    searched = base.filter(F.size(vec) == dim).select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.col(key).cast("long").alias("id"), doubles(F.col(vec)).alias("vec"))
    asked = queries.filter(F.size(vec) == dim).select(F.col(key).cast("long").alias("id"), doubles(F.col(vec)).alias("vec"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
    left = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = searched.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda x, y: _search(x, y, k), schema)
    return _best(near, k)


def _search(x: pa.Table, y: pa.Table, k: int) -> pa.Table:
    """The k best of a block for each query of a part."""
    if not x.num_rows or not y.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    q = np.array(x.column("vec").combine_chunks().flatten()).reshape(x.num_rows, -1)
    v = np.array(y.column("vec").combine_chunks().flatten()).reshape(y.num_rows, -1)
    ids, others = x.column("id").to_numpy(), y.column("id").to_numpy()
    order = np.argsort(others, kind="stable")
    v, others, most = v[order], others[order], min(k, len(others))
    out = []
    for at in range(0, len(q), 256):
        score = np.round(q[at : at + 256] @ v.T, 12)
        best = np.argsort(-score, axis=1, kind="stable")[:, :most]
        out.append((np.repeat(ids[at : at + 256], most), others[best].ravel(), np.take_along_axis(score, best, 1).ravel()))
    return pa.table({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("id", "other", "score"))})


def _best(near: DataFrame, k: int) -> DataFrame:
    own = W.partitionBy("id").orderBy(F.desc("score"), "other")
    return near.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


#: Vectors that an index is fitted on, at most; every vector is indexed.
FIT_VECTORS = 20_000


def fitted_lists(base: DataFrame, lists: int, vec: str = "vec", key: str = "id", rounds: int = 8, most: int = FIT_VECTORS) -> np.ndarray:
    """Unit centroids of `lists` lists, fitted by spherical k-means on the `most` vectors of least hash."""
    rows = base.filter(F.size(vec) > 0).select(doubles(F.col(vec)).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(most).toArrow()
    sample = np.array(rows.column("v").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = sample[: min(lists, len(sample))].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        for i in range(len(centres)):
            if len(own := sample[near == i]):
                total = own.sum(0)
                centres[i] = total / max(np.linalg.norm(total), 1e-12)
    return centres


def top_k_by_lists(queries: DataFrame, base: DataFrame, k: int, centres: np.ndarray, probes: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """As top_k, but a query visits only the `probes` lists whose centroids are nearest to it (an inverted file): work grows with
    queries * base * probes / lists. Approximate: a neighbour in a list that is not visited is missed. Every vector of the base is
    in one list; a list of more than a block's bytes is dealt over several tasks."""
    spark, dim = base.sparkSession, centres.shape[1]
    shared = spark.sparkContext.broadcast(centres)

    def lists_of(n: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    v = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                    near = np.argsort(-(v @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                    offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel()))], names=["id", "vec", "lists"])

        return run

    own = lambda df: df.filter(F.size(vec) == dim).select(F.col(key).cast("long").alias("id"), doubles(F.col(vec)).alias("vec"))
    kinds = "id long, vec array<double>, lists array<int>"
    searched = own(base).mapInArrow(lists_of(1), kinds).select("id", "vec", F.col("lists")[0].alias("list"))
    sizes = searched.groupBy("list").agg(F.ceil(F.count("*") * dim * 8 / SEARCH_BLOCK_BYTES).cast("int").alias("parts"))  # a row a list
    searched = searched.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = own(queries).mapInArrow(lists_of(probes), kinds).select("id", "vec", F.explode("lists").alias("list"))
    asked = asked.join(F.broadcast(sizes), "list").select("id", "vec", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = asked.groupBy("list", "part").cogroup(searched.groupBy("list", "part")).applyInArrow(lambda x, y: _search(x, y, k), "id long, other long, score double")
    return _best(near, k)


def window_owners(windows: DataFrame, k: int, key: str = "path", vec: str = "vec", asked: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b): owners of the k windows nearest to each window, other owners than itself. asked: the keys that a may be."""
    named = windows.withColumn("id", F.xxhash64(key, "w"))
    own = named if asked is None else named.join(asked.select(key).distinct(), key, "left_semi")
    owner = named.select(F.col("id").alias("other"), F.col(key).alias("b"))
    mine = own.select("id", F.col(key).alias("a"))
    return top_k(own, named, k, "id", vec).join(mine, "id").join(owner, "other").filter("a <> b").select("a", "b").distinct()


def cosine_gate(pairs: DataFrame, vectors: DataFrame, gate: float, key: str = "path", vec: str = "vec") -> DataFrame:
    """Pairs whose descriptors' product reaches the gate, and pairs with an end that has none; a gate of 0 or less is open."""
    if gate <= 0:
        return pairs
    own = vectors.select(F.col(key).alias("k"), F.col(vec).alias("v"))
    x, y = own.select(F.col("k").alias("a"), F.col("v").alias("va")), own.select(F.col("k").alias("b"), F.col("v").alias("vb"))
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.filter(F.col("va").isNull() | F.col("vb").isNull() | (dot(F.col("va"), F.col("vb")) >= gate)).select(*pairs.columns)


def candidates(*sources: DataFrame) -> DataFrame:
    """Union of candidate sources as canonical pairs."""
    out = sources[0].select("a", "b")
    for s in sources[1:]:
        out = out.union(s.select("a", "b"))
    return canonical(out)


def not_evaluated(pairs: DataFrame, ledger: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Pairs that are not in the ledger, or have an end that changed. ledger: (pair_hash); changed: (key)."""
    own = changed.select(F.col(key).alias("c")).distinct()
    pairs = pairs.withColumn("pair_hash", pair_digest(F.col("a"), F.col("b")))
    fresh = pairs.join(ledger.select("pair_hash").distinct(), "pair_hash", "left_anti").select("a", "b")
    touched = pairs.join(own, F.col("a") == F.col("c"), "left_semi").select("a", "b").union(pairs.join(own, F.col("b") == F.col("c"), "left_semi").select("a", "b"))
    return fresh.union(touched).distinct()


def without_pairs(pairs: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Pairs, in whatever order of ends, that are not vetoed."""
    no = canonical(vetoes).select(F.col("a").alias("va"), F.col("b").alias("vb"))
    return pairs.join(no, (F.least("a", "b") == F.col("va")) & (F.greatest("a", "b") == F.col("vb")), "left_anti")


def existing(pairs: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Pairs both of whose ends are still listed."""
    own = listing.select(F.col(path).alias("_p")).distinct()
    return pairs.join(own, F.col("a") == F.col("_p"), "left_semi").join(own, F.col("b") == F.col("_p"), "left_semi")


#: Buckets that the tolerance of label_candidates spans, items of a block there, and pairs that a task may look at.
LIKE_STEPS, LIKE_ITEMS, LIKE_PAIRS = 4, 700, 1 << 23

#: Decided pairs that are broadcast, at most; with more, both sides are shuffled.
DECIDED_ROWS = 200_000


def label_candidates(
    items: DataFrame, decided: DataFrame, key: str = "path", title: str = "title", duration: str = "duration", most: int = 4, tolerance: float = 0.02, reviewed: DataFrame | None = None
) -> DataFrame:
    """(a, b, kind) of undecided pairs worth a label: `recall` for equal titles of two to `most` items, `negative` for like
    durations (difference over the longer below the tolerance) with other titles. a is the smaller key.

    decided: (a, b) of single pairs that have a verdict. reviewed: (key) of items all of whose pairs with larger keys have one; it
    is asked of the items, before any pair is made. Pairs grow with the square of the library, so none is shuffled or sorted: they
    leave the join as they are made, unless more than DECIDED_ROWS pairs are decided.
    """
    own = items.select(F.col(key).alias("k"), F.col(title).alias("t"), F.col(duration).cast("double").alias("v"), F.lit(True).alias("open"))
    if reviewed is not None:
        done = reviewed.select(F.col(key).alias("k")).distinct().withColumn("done", F.lit(True))
        own = own.join(done, "k", "left").select("k", "t", "v", F.col("done").isNull().alias("open"))
    few = own.groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most)).select("t")
    named = own.join(few, "t")
    same = named.filter("open").select("t", F.col("k").alias("a")).join(named.select("t", F.col("k").alias("b")), "t").filter("a < b").select("a", "b", F.lit("recall").alias("kind"))
    near = _like_pairs(own.filter("t is not null"), tolerance).filter("tx <> ty and if(kx < ky, openx, openy)")
    near = near.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), F.lit("negative").alias("kind"))
    found = same.union(near)
    known = decided.limit(DECIDED_ROWS + 1).count()
    if known > DECIDED_ROWS:
        return without_pairs(found, decided)
    return without_pairs(found, F.broadcast(canonical(decided))) if known else found


def _like_pairs(items: DataFrame, tolerance: float) -> DataFrame:
    """Every pair of rows x, y of items (k, v, ...) with other keys whose v differ by less than y's times the tolerance, y's being
    the larger, once; columns with x and y at their end.

    Values are in logarithmic buckets, a few to the tolerance, and buckets in blocks of about LIKE_ITEMS rows. Blocks whose buckets
    are within the tolerance meet under one key of the join, so a hot bucket is many keys of bounded work and what is shuffled is the
    pairs' number over LIKE_ITEMS. The join has as many tasks as its pairs need, since its input tells little about its output.
    """
    place = F.log("v") / (-math.log(1 - tolerance) / LIKE_STEPS)
    reach = LIKE_STEPS + 0.01  # more than logarithms are rounded by
    base = items.filter("v > 0 and v < double('infinity') and k is not null").withColumns({"bucket": F.floor(place), "far": F.floor(place + reach), "low": F.floor(place - reach)})
    sizes = base.groupBy("bucket").agg(F.count("*").alias("n"))
    parts = sizes.select("bucket", F.ceil(F.col("n") / LIKE_ITEMS).cast("int").alias("parts"))
    above = sizes.select(F.explode(F.sequence(F.col("bucket") - LIKE_STEPS, F.col("bucket"))).alias("bucket"), F.col("n").alias("m"))
    pairs = sizes.join(above, "bucket").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    tasks = min(max(items.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / LIKE_PAIRS)), 20_000)

    dealt = base.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).drop("parts")
    own = lambda s: [F.col(c).alias(c + s) for c in items.columns]
    met = lambda s: parts.select(F.col("bucket").alias("b" + s), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p" + s))
    x = dealt.select(*own("x"), F.col("bucket").alias("bx"), F.col("part").alias("px"), F.explode(F.sequence("bucket", "far")).alias("by")).join(met("y"), "by")
    y = dealt.select(*own("y"), F.col("bucket").alias("by"), F.col("part").alias("py"), F.explode(F.sequence("low", "bucket")).alias("bx")).join(met("x"), "bx")
    keys = ["bx", "px", "by", "py"]
    joined = x.repartition(tasks, *keys).join(y.repartition(tasks, *keys), keys)
    return joined.filter(f"vy - vx < vy * {tolerance!r}D and (vx < vy and kx <> ky or vx = vy and kx < ky)")


def strided(items: DataFrame, prefix: str, step: int, key: str = "path") -> DataFrame:
    """Every step-th path below a prefix, in order of the path. A sample for profiling."""
    own = items.filter(F.col(key).startswith(prefix))
    return own.withColumn("_r", F.row_number().over(W.orderBy(key))).filter((F.col("_r") - 1) % step == 0).drop("_r")


def longest(items: DataFrame, prefix: str, n: int, key: str = "path", duration: str = "duration") -> DataFrame:
    """The n longest items below a prefix, ties by key: the worst case of a profile."""
    return items.filter(F.col(key).startswith(prefix)).orderBy(F.desc_nulls_last(duration), key).limit(n)
