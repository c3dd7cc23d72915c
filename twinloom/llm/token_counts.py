"""Token counts without ids: pieces are counted once per distinct pre-token, and documents add up pieces times frequencies.

A byte-level BPE splits a text by a fixed pattern and encodes each pre-token by itself, so a document's count is the sum over
its distinct pre-tokens of frequency times pieces.

1. Texts are split once. A block of documents (BLOCK_BYTES of text, as they come, without a shuffle) becomes a row: each document's
   frequencies by the place of the pre-token among the block's distinct ones, and those themselves, packed for the buckets that
   they belong to by their hash. Blocks are written to the shared folder.
2. A bucket holds all occurrences of its pre-tokens in blocks; the tokenizer counts the pieces of each distinct one once.
3. That table is joined back: a bucket answers each block with the pieces of its pre-tokens, in the order sent, and the block's
   documents sum frequency times pieces.

Scale: what is shuffled is a packed list per block and bucket, not (document, pre-token), and the packed frequencies once, about a
third of the texts' bytes on disk in all. A pre-token stands once in a block however often its documents hold it, so no key is hotter than the
number of blocks. The number of buckets follows from the bytes. No table is broadcast unless Spark
measures it as small. A lost executor costs its own tasks, as blocks are numbered by partition and written before they are read.

Files for the other libraries (sentencepiece models; tokenizers files with another pre-tokenizer) are counted text by text,
as their pieces cross word borders.

Edge cases: null and empty texts count 0; special strings inside a text are one token, as the library does by default; rows
with equal identifiers are counted each by itself, and rows without identifier too; a very long text is a block of its own and
read whole; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, materialise, small_batches, spread, text_bytes

BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20, 1 << 30
#: Between packed pre-tokens; no byte of UTF-8.
BETWEEN = b"\xff"
#: Documents of a block at most, so that a table of empty texts is cut as well.
BLOCK_ROWS = 50_000
LIMIT = 512
#: Fixed value: the public pattern of byte-level BPE pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PreTokens:
    """Splits texts into pre-tokens, and counts the pieces of pre-tokens."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.path = path
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(PATTERN).findall

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often a text holds each pre-token, and how many special strings."""
        if self.cut and any(x in text for x in self.special):
            parts = self.cut.split(text)
            return Counter(x for part in parts for x in self.find(part)), len(parts) - 1
        return Counter(self.find(text)), 0

    def pieces(self, tokens: list[str]) -> list[int]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not hasattr(self, "tokenizer"):
            self.tokenizer = Tokenizer.from_file(self.path)
        return [len(e) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


def by_pre_tokens(path: str) -> bool:
    """Whether a file's tokenizer encodes pre-tokens of PATTERN each by itself."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])


def text_counter(path: str) -> Callable[[str], int]:
    """Counts whole texts by the library."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False))


BLOCK = "blk long, ids array<long>, n_bytes array<long>, special array<long>, wide binary, places binary, times binary, sent array<struct<bucket:int,tokens:binary>>"


class Block:
    """Frequencies of the documents that were read since the last block."""

    def __init__(self) -> None:
        self.ids, self.n_bytes, self.special, self.wide, self.size = [], [], [], [], 0
        self.known: dict[str, int] = {}
        self.places: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, key: int | None, size: int, found: Counter, special: int) -> None:
        known = self.known
        self.places.append(np.fromiter((known.setdefault(x, len(known)) for x in found), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.uint32, len(found)))
        self.ids.append(key), self.n_bytes.append(size), self.special.append(special), self.wide.append(len(found))
        self.size += size

    def row(self, number: int, buckets: int) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        coded = [x.encode() for x in self.known]
        owner = np.array([zlib.crc32(x) % buckets for x in coded], np.int64)
        order = sorted(range(len(coded)), key=lambda i: (owner[i], coded[i]))  # places count in the order of what is sent
        rank = np.empty(len(coded), np.int64)
        rank[order] = np.arange(len(coded))
        wide = np.array(self.wide, np.int64)
        places, times = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((self.places, np.int64), (self.times, np.uint32)))
        keys = np.repeat(np.arange(len(wide)) * (len(coded) + 1), wide) + rank[places]
        by = np.argsort(keys)
        steps = rank[places[by]]
        first = (np.cumsum(wide) - wide)[wide > 0]
        heads = steps[first]
        steps[1:] = np.diff(steps)  # steps are small numbers, which pack well
        steps[first] = heads
        sent, ranked = [], owner[order]
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1])))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=False):
            sent.append({"bucket": int(ranked[a]), "tokens": pack(BETWEEN.join(coded[i] for i in order[a:b]))})
        longs = [pa.array([x], pa.list_(pa.int64())) for x in (self.ids, self.n_bytes, self.special)]
        packed = [pa.array([pack(x.astype(np.uint32).tobytes())], pa.binary()) for x in (wide, steps, times[by])]
        messages = pa.array([sent], pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary())])))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *longs, *packed, messages], names=["blk", "ids", "n_bytes", "special", "wide", "places", "times", "sent"])


def _answers(table: pa.Table, pre: PreTokens) -> pa.Table:
    """A bucket's side: the pieces of each block's pre-tokens, in the order sent; every distinct one is counted once."""
    pack, unpack, known, out = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress, {}, []
    for value in table.column("tokens"):
        tokens = unpack(value.as_py()).split(BETWEEN)
        new = [x for x in tokens if x not in known]
        known.update(zip(new, pre.pieces([x.decode() for x in new]) if new else (), strict=True))
        out.append(pack(np.array([known[x] for x in tokens], np.uint32).tobytes()))
    return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"), "pieces": pa.array(out, pa.binary())})


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The documents of blocks: (id, n_bytes, n_tokens). The last column of a block holds the buckets' answers, in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids, sizes, totals = [], [], []
    for i in range(batch.num_rows):
        wide, places, times = (np.frombuffer(unpack(batch.column(k)[i].as_py()), np.uint32).astype(np.int64) for k in (3, 4, 5))
        total = np.array(batch.column(2)[i].as_py(), np.int64)
        if len(places):
            begin = (np.cumsum(wide) - wide)[wide > 0]
            steps = np.cumsum(places)
            at = steps - np.repeat(steps[begin] - places[begin], wide[wide > 0])
            pieces = np.frombuffer(b"".join(unpack(x["pieces"].as_py()) for x in batch.column(6)[i]), np.uint32).astype(np.int64)
            total[wide > 0] += np.add.reduceat(pieces[at] * times, begin)
        ids.append(batch.column(0)[i].values), sizes.append(batch.column(1)[i].values), totals.append(pa.array(total, pa.int64()))
    joined = [pa.concat_arrays([pa.array([], pa.int64()), *x]) for x in (ids, sizes, totals)]
    return pa.RecordBatch.from_arrays(joined, names=["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit. path: the tokenizer's file, on every executor."""
    small_batches(docs.sparkSession)
    rows = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")))
    out = _by_pre_tokens(rows, path) if by_pre_tokens(path) else _by_texts(rows, path)
    return out.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _by_texts(rows: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = text_counter(path)
        for batch in batches:
            tokens = pa.array([number(x) if x else 0 for x in (v.as_py() for v in batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")


def _by_pre_tokens(rows: DataFrame, path: str) -> DataFrame:
    buckets = block_count(text_bytes(rows), *BUCKET_BYTES)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pre, block, number = PreTokens(path), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for key, text, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if block.ids and (block.size + size > BLOCK_BYTES or len(block.ids) >= BLOCK_ROWS):
                    yield block.row(number, buckets)
                    block, number = Block(), number + 1
                text = text.as_py()
                block.add(key, size, *(pre.frequencies(text) if text else (Counter(), 0)))
        if block.ids:
            yield block.row(number, buckets)

    def count(table: pa.Table) -> pa.Table:
        return _answers(table, PreTokens(path))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(_summed, batches)

    blocks = materialise(rows.mapInArrow(split, BLOCK), "frequencies")
    sent = blocks.select("blk", F.explode("sent").alias("m")).select("blk", "m.bucket", "m.tokens").repartition(buckets, "bucket")
    pieces = sent.groupBy("bucket").applyInArrow(count, "blk long, bucket int, pieces binary")
    answers = pieces.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("bucket", "pieces"))).alias("found"))
    joined = blocks.join(answers, "blk", "left").select("ids", "n_bytes", "special", "wide", "places", "times", F.coalesce("found", F.array().cast("array<struct<bucket:int,pieces:binary>>")).alias("found"))
    return joined.mapInArrow(total, "id long, n_bytes long, n_tokens long")
