"""A filter pass over keys that are spread over blocks of documents: which of a block's keys occur again anywhere.

A block sends the fingerprints of its distinct keys, sorted and packed, to buckets; a bucket adds up the counts and answers each
block with one bit a key, in the order sent. A fingerprint of `width` bytes may collide by chance; that only lets a key pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SENT = "bucket long, blk long, keys binary, counts binary"
ANSWER = "blk long, bucket long, again binary, hot binary"

_K1, _K2 = np.uint64(0x165667B19E3779F9), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _K1
    x ^= x >> np.uint64(29)
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def in_order(table: pa.Table, body: str) -> pa.Table:
    """A block's rows by identifier (nulls last) and text. A shuffle brings rows in any order, and a block is read by several
    stages, so a row's place in the block means the same in all of them only after this; rows that are equal are alike."""
    ids = table.column("id").combine_chunks()
    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, null))
    ranked, last = ids[order], null[order]
    if ((ranked[1:] == ranked[:-1]) & (last[1:] == last[:-1])).any():
        texts = table.column(body)
        order = sorted(order.tolist(), key=lambda i: (null[i], ids[i], texts[i].is_valid, texts[i].as_py()) if texts[i].is_valid else (null[i], ids[i], False))
    return table.take(pa.array(order, pa.int64()))


def width_for(n: int) -> int:
    """Bytes of a fingerprint so that few of n keys collide by chance."""
    return min(8, max(4, -(-(max(1, n).bit_length() + 8) // 8)))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def send(number: int, keys: np.ndarray, counts: np.ndarray, buckets: int, width: int) -> pa.Table:
    """A block's distinct keys (sorted) and counts (up to 255), by bucket."""
    own = bucket_of(keys, buckets)
    owners, lows = np.unique(own, return_index=True)
    packed = np.ascontiguousarray(mix(keys).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    rows = [(int(o), packed[a:b].tobytes(), counts[a:b].tobytes()) for o, a, b in zip(owners, lows, [*lows[1:], len(keys)][: len(lows)], strict=True)]
    return pa.table({"bucket": pa.array([x[0] for x in rows], pa.int64()), "blk": pa.array([number] * len(rows), pa.int64()), "keys": binary([x[1] for x in rows]), "counts": binary([x[2] for x in rows])})


def answer(table: pa.Table, width: int, hot_above: int) -> pa.Table:
    """A bucket's side: for each block's keys, in the order sent, a bit for `occurs again` and a bit for `occurs very often`."""
    sent = [x.as_py() for x in table.column("keys")]
    sizes = np.array([len(x) // width for x in sent])
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :width] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, width)
    keys = wide.view("<u8").ravel()
    counts = np.frombuffer(b"".join(x.as_py() for x in table.column("counts")), np.uint8)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    totals = np.add.reduceat(counts[order].astype(np.int64), begin)
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(totals, np.diff(np.append(begin, len(keys))))
    ends = np.cumsum(sizes)
    parts = list(zip(ends - sizes, ends, strict=True))
    return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"), "again": binary([np.packbits(total[a:b] > 1).tobytes() for a, b in parts]), "hot": binary([np.packbits(total[a:b] > hot_above).tobytes() for a, b in parts])})


def flags(keys: np.ndarray, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of a block's keys (sorted and distinct, as sent)."""
    own = bucket_of(keys, buckets)
    again, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for bucket, a, h in zip(answers.column("bucket").to_pylist(), answers.column("again"), answers.column("hot"), strict=True):
        low, high = np.searchsorted(own, [bucket, bucket + 1])
        again[low:high] = np.unpackbits(np.frombuffer(a.as_py(), np.uint8), count=high - low).astype(bool)
        hot[low:high] = np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=high - low).astype(bool)
    return again, hot
