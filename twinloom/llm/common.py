"""Shared pieces: scratch tables in the cluster's shared folder, text normal forms, blocks of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise

__all__ = ["discard", "materialise"]

#: White space of the contracts, as a list of characters.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def without_blanks(text: Column) -> Column:
    """The text without any white space character; null counts as empty. Plain replacements are the cheapest JVM form."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows and bytes of an Arrow batch at most; a text longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Inputs of less than so many bytes on disk are dealt over the cores before Python reads them.
SMALL_INPUT = 24 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of Arrow batches, so that a batch of long texts fits in a Python worker. Plans are lazy and read
    the settings when they run, so these are lowered for the session, never raised."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, most)


def spread(docs: DataFrame) -> DataFrame:
    """The rows, dealt over the cores if the input is small: a small file is often one row group, which one task would read."""
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_INPUT:
        return docs.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    return docs


def row_keys(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """docs with a column that tells all rows apart, and its name: `key` itself if it does. Else a row whose identifier is null or
    stands in several rows gets a number above all identifiers, in a new column; the table is written, so that the numbers stay."""
    ids = docs.groupBy(F.col(key).cast("long").alias("_id")).agg(F.count("*").alias("_n"))
    again = materialise(ids.filter("_n > 1 or _id is null").select("_id"), "repeated")
    if again.isEmpty():
        return docs, key
    name = "_node"
    while name in docs.columns:
        name += "_"
    top = ids.agg(F.greatest(F.coalesce(F.max("_id"), F.lit(0)), F.lit(0)).alias("top")).first()["top"]
    again = again.select(F.col("_id").alias(f"{name}_id"), F.lit(True).alias(f"{name}_again"))
    rows = docs.join(again, docs[key].cast("long").eqNullSafe(F.col(f"{name}_id")), "left")
    node = F.when(F.col(f"{name}_again"), F.monotonically_increasing_id() + (top + 1)).otherwise(docs[key].cast("long"))
    return materialise(rows.select(*[docs[c] for c in docs.columns], node.alias(name)), "rows"), name


def block_count(total_bytes: int, least: int, most: int) -> int:
    """Number of parts of a corpus. Parts of `least` bytes, growing with the root of the corpus up to `most`, so that what each of n
    blocks sends to each of m buckets stays more than a row's overhead: 2 MB blocks up to 100 GB, 64 MB at 100 TB."""
    size = min(most, max(least, int(least * (total_bytes / 100e9) ** 0.5)))
    return max(8, -(-int(total_bytes) // size))


def part_count(spark: SparkSession, total_bytes: int) -> int:
    """Shuffle partitions for a corpus of so many bytes: 16 MB each up to 1 GB of texts, growing with the root of the corpus up to
    1 GB each (100,000 parts at 100 TB), and enough of them to keep every core busy."""
    size = min(1 << 30, max(16 << 20, int((16 << 20) * (total_bytes / 1e9) ** 0.5)))
    return max(2 * spark.sparkContext.defaultParallelism if total_bytes > (4 << 20) else 4, -(-int(total_bytes) // size))


def spark_hash(values: np.ndarray) -> np.ndarray:
    """What Spark's hash partitioning takes of 64-bit integers: 32-bit Murmur3 with seed 42."""
    u = np.uint32
    h = np.full(len(values), 42, u)
    with np.errstate(over="ignore"):
        for word in (values.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF), values.astype(np.int64).view(np.uint64) >> np.uint64(32)):
            k = word.astype(u) * u(0xCC9E2D51)
            k = (k << u(15) | k >> u(17)) * u(0x1B873593)
            h ^= k
            h = (h << u(13) | h >> u(19)) * u(5) + u(0xE6546B64)
        h ^= u(8)
        h = (h ^ h >> u(16)) * u(0x85EBCA6B)
        h = (h ^ h >> u(13)) * u(0xC2B2AE35)
        return (h ^ h >> u(16)).view(np.int32)


#: Groups that are dealt evenly at most, as their keys stand in the plan; more, at some ten a partition, even out by chance.
EVEN_GROUPS = 100_000


def even_keys(groups: int, parts: int) -> list[int]:
    """A key for each of the groups 0, 1, ... such that hash partitioning into `parts` deals the groups in turn: numbers whose hash falls
    into partition 0, 1, ..., 0, 1, ... Numbers as they are would leave some partitions with several times the mean."""
    if groups > EVEN_GROUPS:
        return list(range(groups))
    found: list[list[int]] = [[] for _ in range(parts)]
    need, at = -(-groups // parts), 0
    while any(len(x) < need for x in found):
        tried = np.arange(at, at + 8 * parts * need + 1000, dtype=np.int64)
        at += len(tried)
        for p, own in zip((spark_hash(tried) % np.int32(parts)).tolist(), tried.tolist(), strict=True):
            if len(found[p]) < need:
                found[p].append(own)
    return [found[g % parts][g // parts] for g in range(groups)]


def dealt(group: Column, keys: list[int]) -> Column:
    """The key of a group, to partition by; the table of keys is one literal."""
    return F.element_at(F.split(F.lit(",".join(map(str, keys))), ",").cast("array<bigint>"), (group + 1).cast("int"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one pass over the column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first()["b"] or 0)


#: A filter has at most 1024 buckets of 32768 bits: 4 MB, however many keys go in.
FILTER_BUCKETS = 1024
BUCKET_BITS = 32768


def _slot(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(FILTER_BUCKETS)).cast("int"), F.pmod(F.shiftright(h, 20), F.lit(BUCKET_BITS)).cast("long")


def bits_of(wanted: DataFrame, key: str, *by: str) -> DataFrame:
    """The filter of some keys (one for each value of `by`): by, bucket, bits; 4 MB at most each."""
    bucket, bit = _slot(F.col(key))
    return wanted.select(*by, bucket.alias("_f_bucket"), bit.alias("_f_bit")).groupBy(*by, "_f_bucket").agg(F.bitmap_construct_agg("_f_bit").alias("_f_bits"))


def in_bits(rows: DataFrame, key: str, bits: DataFrame, *by: str, send: bool = True) -> DataFrame:
    """Rows with `_found`: whether their key may be in the filter. Only the filter is broadcast; send: whether it is, which is for
    the caller to say where there is one for each of many values of `by`."""
    bucket, bit = _slot(F.col(key))
    found = rows.withColumn("_f_bucket", bucket).withColumn("_f_bit", bit).join(F.broadcast(bits) if send else bits, [*by, "_f_bucket"], "left")
    byte = F.conv(F.hex(F.substring(F.col("_f_bits"), F.expr("cast(_f_bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_f_bit") % 8).cast("int")) == 1, F.lit(False))
    return found.select(*[rows[c] for c in rows.columns], hit.alias("_found"))


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key may be among the wanted keys: all that are, and few others as long as the wanted keys are well below 33
    million (beyond that the filter lets more pass, and results stay whole). Only the filter, 4 MB at most, is broadcast."""
    return in_bits(rows, key, bits_of(wanted, wanted_key)).filter("_found").select(*rows.columns)


#: Parts of a key that may be hot; at most 63, as a part is a bit of a mask.
SALTS = 60


def salt_of(key: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"), F.lit(0))


def salt_mask(salt: str = "salt") -> Column:
    """Aggregate: the salts under which a key's rows stand, as a bit mask."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(salt)))


def salts_in(mask: str) -> Column:
    """The salts of a mask, as an array to explode: what is joined back per (key, salt) is repeated as often as needed only."""
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col(mask), i) == 1)
