"""Substring dedup by sliding spans of sentences.

Texts are cut into sentences (after . ! ? and their closing marks before white space, and at line ends). From every sentence
on, the shortest run of at least `min_sentences` consecutive sentences with at least `min_words` words is a span; with `both_ends`
the shortest such run up to every sentence is one as well, so every sentence of a repeated run that meets both minima is covered
by a span within that run (without, a copy's last short sentences may stay). Spans are
hashed (128 bits of their words, lower-cased, white space apart), joined over all documents, and each sentence that a span
covers which is not the first of its kind (smallest identifier, then position) is removed.

A span depends only on the sentences it holds, so a passage that repeats gives the same spans in all its copies. Short spans
at a text's end that don't reach `min_words` are no spans, so chance repeats of a few words are left alone.

Scale: texts are shuffled once, into blocks by the hash of the identifier, and every pass reads that one exchange. A first pass
(see passes.py) sends packed fingerprints and leaves only spans that occur again, a small part, to be joined as rows (hash,
identifier, position). They are reduced and joined per (hash, salt), so a passage that a third of all documents share is dealt
over SALTS tasks.

Blocks grow with the root of the corpus and partitions with the blocks, so no task's share grows with the corpus alone. A block's
rows are put in one order, and a hit names its row by its place there, never by its identifier.

Edge cases: a null text counts as empty, and its kept text is ''; rows with equal identifiers are occurrences at the same place
if they hold a span at the same sentence, and all of these stay; where their texts differ each row loses its own spans only;
rows without identifier come last in the order and lose nothing; a text without sentence ends is one sentence; a very long text
is read whole, in the memory of one task; an empty table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, dealt, even_keys, part_count, text_bytes
from .passes import ANSWER, SENT, answer, flags, in_order, send, width_for

MIN_SENTENCES = 2
MIN_WORDS = 8
SALTS = 512
BLOCK_BYTES = 2 << 20, 64 << 20
BUCKET_BYTES = 32 << 20, 256 << 20
SENTENCE = re.compile(r"[^\n.!?]*+(?:[.!?](?![.!?\"'»”’)\]]*+(?:\s|$))[^\n.!?]*+)*+(?:[.!?]++[\"'»”’)\]]*+[^\S\n]*+|\n[^\S\n]*+|$)")


def sentences(text: str) -> list[str]:
    """The text cut into sentences; joined they are the text."""
    return [x for x in SENTENCE.findall(text) if x]


def spans(parts: list[str], min_sentences: int, min_words: int, both_ends: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(first sentence, number of sentences, two halves of the hash) of every span."""
    words = [x.lower().split() for x in parts]
    full = [i for i, x in enumerate(words) if x]  # blank sentences are part of no span
    forms = [" ".join(words[i]).encode() for i in full]
    sizes = [len(words[i]) for i in full]
    found, end, total = set(), 0, 0
    for at in range(len(full)):
        while end < len(full) and (end - at < min_sentences or total < min_words):
            total += sizes[end]
            end += 1
        if end - at < min_sentences or total < min_words:
            break
        found.add((at, end))
        total -= sizes[at]
    at = total = 0
    for end in range(1, len(full) + 1) if both_ends else ():
        total += sizes[end - 1]
        while end - at > min_sentences and total - sizes[at] >= min_words:
            total -= sizes[at]
            at += 1
        if end - at >= min_sentences and total >= min_words:
            found.add((at, end))
    for at, end in sorted(found):
        digest = hashlib.blake2b(b"\n".join(forms[at:end]), digest_size=16).digest()
        yield full[at], full[end - 1] - full[at] + 1, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _hashed(text: str | None, *how: int) -> list[tuple[int, int, int, int]]:
    return list(spans(sentences(text), *how)) if text else []


def _keys(halves: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block, sorted; the place of each span's key; how often each key stands (up to 255)."""
    keys, place, counts = np.unique(np.array(halves, np.int64).view(np.uint64), return_inverse=True, return_counts=True)
    return keys, place, np.minimum(counts, 255).astype(np.uint8)


def _prints(table: pa.Table, buckets: int, width: int, how: tuple[int, int, bool]) -> pa.Table:
    """A block's side of the filter pass."""
    keys, _, counts = _keys([x[2] for key, text in zip(table.column("id"), table.column("text"), strict=True) if key.is_valid for x in _hashed(text.as_py(), *how)])
    return send(table.column("blk")[0].as_py(), keys, counts, buckets, width)


SPANS = "blk long not null, row int not null, id long not null, at int not null, n int not null, h1 long not null, h2 long not null"


def _repeated(left: pa.Table, right: pa.Table, buckets: int, how: tuple[int, int, bool]) -> pa.Table:
    """The spans of a block that may occur again; `row` is the place of the text in the block. Rows without identifier come last
    and lose nothing, so their spans decide nothing."""
    rows, number = [], left.column("blk")[0].as_py() if left.num_rows else 0
    if left.num_rows and right.num_rows:
        left = in_order(left, "text")
        found = [(number, row, key, *x) for row, (key, text) in enumerate(zip(left.column("id").to_pylist(), left.column("text"), strict=True)) if key is not None for x in _hashed(text.as_py(), *how)]
        keys, place, _ = _keys([x[5] for x in found])
        stay = flags(keys, right, buckets)[0][place]
        rows = [x for x, s in zip(found, stay, strict=True) if s]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = (("blk", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()))
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(types, columns, strict=True)})


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents without the sentences that its hits (row, at, n) cover."""
    left, hits = in_order(left, "text"), {}
    for row, at, n in zip(*(right.column(c).to_pylist() for c in ("row", "at", "n")), strict=True):
        hits.setdefault(row, set()).update(range(at, at + n))
    kept, total, gone, words, runs = [], [], [], [], []
    for row, body in enumerate(left.column("text")):
        body = body.as_py() or ""
        parts = sentences(body)
        covered = sorted(hits.get(row, ()))
        hidden, own = set(covered), []
        for i in covered:
            if own and own[-1]["first"] + own[-1]["n"] == i:
                own[-1]["n"] += 1
            else:
                own.append({"first": i, "n": 1})
        kept.append("".join(x for i, x in enumerate(parts) if i not in hidden) if hidden else body)
        total.append(len(parts)), gone.append(len(hidden)), words.append(sum(len(parts[i].split()) for i in covered)), runs.append(own)
    return pa.table({"id": left.column("id"), "text": pa.array(kept, pa.string()), "n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed_words": pa.array(words, pa.int64()), "removed_spans": pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])))})


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, both_ends: bool = False) -> DataFrame:
    """One row per document: key, text (what is kept), n_sentences, n_removed, removed_words, removed_spans (first sentence and
    number of sentences of every maximal removed run)."""
    total, how = text_bytes(docs, text), (min_sentences, min_words, both_ends)
    blocks, buckets, width = block_count(total, *BLOCK_BYTES), block_count(total, *BUCKET_BYTES), width_for(total // 64)
    parts = part_count(docs.sparkSession, total)
    n, m = min(parts, blocks), min(parts, buckets)
    of_block, of_bucket = even_keys(blocks, n), even_keys(buckets, m)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    base = base.select(dealt(F.when(F.col("id").isNull(), place("text")).otherwise(place("id")), of_block).alias("blk"), "id", "text").repartition(n, "blk")
    sent = base.groupBy("blk").applyInArrow(lambda t: _prints(t, buckets, width, how), SENT).withColumn("slot", dealt(F.col("bucket"), of_bucket)).repartition(m, "slot")
    again = sent.groupBy("slot").applyInArrow(lambda t: answer(t, width, 255), ANSWER).repartition(n, "blk")
    rows = base.groupBy("blk").cogroup(again.groupBy("blk")).applyInArrow(lambda x, y: _repeated(x, y, buckets, how), SPANS)
    # read twice, dealt once: both readers ask for the same columns, and none puts a filter for nulls below the exchange
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), F.lit(0))).repartition(parts, "h1", "h2", "salt")
    first = F.min(F.struct("id", "at", "n", "blk", "row")).alias("first")
    part = rows.groupBy("h1", "h2", "salt").agg(first, F.count("*").alias("members"))
    firsts = part.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.sum("members").alias("members"), F.collect_list("salt").alias("salts")).filter("members > 1")
    firsts = firsts.select("h1", "h2", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), F.explode("salts").alias("salt"))
    later = rows.join(firsts, ["h1", "h2", "salt"]).filter((F.col("id") != F.col("first_id")) | (F.col("at") != F.col("first_at")))
    hits = later.select("blk", "row", "at", "n").repartition(n, "blk")
    out = base.groupBy("blk").cogroup(hits.groupBy("blk")).applyInArrow(_cut, "id long, text string, n_sentences long, n_removed long, removed_words long, removed_spans array<struct<first:int,n:int>>")
    return out.withColumnRenamed("id", key)
