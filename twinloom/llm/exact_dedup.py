"""Exact dedup by a log-structured merge index of text digests (native: DataFrame functions only).

Flush: a batch's entries (digest, identifier, code points) fall into MEMTABLES memtables by the hash of the identifier. Each is
reduced to one entry per digest (the winner: most code points, then smallest identifier; and the number of members), sorted by
digest and flushed as a run: Parquet whose row groups carry min/max and a Bloom filter on the digest, and beside it the run's
own filter, a bitmap of fixed size (4 MB).

Compaction: every entry of a run is looked up in the filters of the other runs. Most digests miss, as they stand in one run only;
those entries are final and take no part in a merge. Only entries that may be elsewhere are brought together by digest, sorted,
and merged: the winner of the winners stays, members add up.

A digest with more than one member is a hit, and only the texts of hits are read again and compared byte by byte: they are
grouped by digest *and* normalised text, so two texts share a group only if their bytes agree. To keep texts that are no hits out
of the shuffle, hits set bits in a filter (4 MB), which alone is broadcast.

Point lookups (`lookup`) go to the runs' row groups by min/max and Bloom filters, as a pushed-down filter.

Skew: entries are keyed by (digest, salt), so a digest that holds a third of all rows is spread over SALTS tasks, reduced
before it is shuffled, and the winner is joined back per (digest, salt). Beyond 33 million digests a run the filters fill up and let more
pass: merges grow, results stay.

Edge cases: null text counts as empty; rows with equal identifiers are separate members that share `kept`; a null identifier
wins only against other nulls; a very long text is hashed and compared whole; ties in code points go to the smallest identifier;
an empty table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, bits_of, in_bits, materialise, maybe_in, salt_mask, salt_of, salts_in, without_blanks

#: Runs that a batch is flushed to.
MEMTABLES = 4
#: Filters (4 MB each) that are broadcast at most; the runs of more batches are joined to theirs by a shuffle.
SENT_FILTERS = 8


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _order(points: Column, key: Column) -> Column:
    """Largest struct wins: most code points, then a non-null and small identifier."""
    return F.struct(points.alias("p"), key.isNotNull().alias("known"), (-key).alias("neg"), key.alias("id"))


class MergeIndex:
    """Runs of (digest, best, n, mask); `append` flushes a batch, `compact` merges all runs."""

    def __init__(self, spark: SparkSession, key: str = "doc_id", text: str = "text") -> None:
        self.spark, self.key, self.text = spark, key, text
        self.logs: list[DataFrame] = []  # the entries as they came: id, digest, points, salt
        self.runs: list[DataFrame] = []  # one table per batch: run, digest, best, n, mask
        self.filters: list[DataFrame] = []  # of the batch's runs: run, bucket, bits

    def append(self, docs: DataFrame) -> DataFrame:
        """Flushes a batch as sorted runs with filters and returns them."""
        norm, bloom = without_blanks(F.col(self.text)), {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes#digest": "1048576"}
        log = docs.select(F.col(self.key).cast("long").alias("id"), digest_of(norm).alias("digest"), F.coalesce(F.length(self.text), F.lit(0)).cast("long").alias("points"))
        self.logs.append(log := materialise(log.withColumn("salt", salt_of("id")), "log"))
        first = len(self.runs) * MEMTABLES
        run = (F.pmod(F.xxhash64("id", F.lit("memtable")), F.lit(MEMTABLES)) + first).cast("int").alias("run")
        part = log.groupBy("digest", "salt", run).agg(F.max(_order(F.col("points"), F.col("id"))).alias("best"), F.count("*").alias("n"))
        flushed = part.groupBy("digest", "run").agg(F.max("best").alias("best"), F.sum("n").alias("n"), salt_mask().alias("mask"))
        self.runs.append(flushed := materialise(flushed.sortWithinPartitions("run", "digest"), "runs", **bloom))
        self.filters.append(materialise(bits_of(flushed, "digest", "run"), "filters"))
        return flushed

    def entries(self) -> DataFrame:
        return _union(self.logs)

    def compact(self) -> DataFrame:
        """Per digest: winner, members, and the salts under which its members stand."""
        runs, filters = _union(self.runs), _union(self.filters)
        # the filters of all other runs, for each run: 4 MB each
        names = filters.select(F.col("run").alias("for")).distinct()
        others = filters.join(F.broadcast(names), F.col("run") != F.col("for")).groupBy("for", "_f_bucket").agg(F.bitmap_or_agg("_f_bits").alias("_f_bits")).withColumnRenamed("for", "run")
        probed = in_bits(runs, "digest", others, "run", send=len(self.runs) * MEMTABLES <= SENT_FILTERS)
        single = probed.filter("not _found").select("digest", "best", "n", "mask")
        merged = probed.filter("_found").groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))
        return single.union(merged).select("digest", "best", "n", salts_in("mask").alias("salts"))

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """The runs' entries of some digests."""
        return _union(self.runs).filter(F.col("digest").isin([bytearray(x) for x in digests])).select("digest", "best", "n")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def verified(docs: DataFrame, hits: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of hits, grouped by digest and whole normalised text; one row per group. Equal bytes are the grouping itself."""
    norm = without_blanks(F.col(text))
    rows = docs.select(F.col(key).cast("long").alias("id"), norm.alias("norm"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"))
    rows = rows.withColumn("digest", digest_of(F.col("norm")))
    rows = maybe_in(rows, "digest", hits, "digest")
    return rows.groupBy("digest", "norm").agg(F.max(_order(F.col("points"), F.col("id"))).alias("best"), F.count("*").alias("n"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256. See the module for the method and the edge cases."""
    spark = docs.sparkSession
    index = MergeIndex(spark, key, text)
    index.append(docs)
    merged = materialise(index.compact().filter("n > 1"), "compacted")
    classes = materialise(verified(docs, merged.select("digest"), key, text).select("digest", "best", "n", F.xxhash64("norm").alias("form"), "norm"), "verified")
    split = classes.groupBy("digest").agg(F.count("*").alias("forms")).filter("forms > 1")
    entries = index.entries()
    out_columns = ["id", "digest", F.coalesce("best.id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size")]
    if split.isEmpty():
        sizes = classes.select("digest", "best", "n").join(merged.select("digest", F.explode("salts").alias("salt")), "digest")
        out = entries.join(sizes, ["digest", "salt"], "left").select(*out_columns)
    else:  # different texts with one digest: the text itself decides
        norm = without_blanks(F.col(text))
        texts = docs.select(F.col(key).cast("long").alias("id"), norm.alias("norm"), digest_of(norm).alias("digest"))
        out = texts.join(classes.select("digest", "norm", "best", "n"), ["digest", "norm"], "left").select(*out_columns)
    kept = (F.col("id") == F.col("keep_id")) | (F.col("id").isNull() & F.col("keep_id").isNull())
    return out.select(F.col("id").alias(key), "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
