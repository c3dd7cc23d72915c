"""Suffix-array dedup: a depth-limited radix sort of all suffixes, by most significant digits, over the whole corpus.

Only the first `depth` bytes of a suffix count, so suffixes that are equal to that depth form a group, and the groups are
exactly the repeated windows. The sort runs in passes; each pass splits groups by their next digit and drops what is alone:

1. The first digit is an anchor: the 16-byte gram of least hash in the window, which equal windows share wherever they stand.
   Neighbouring suffixes mostly share their anchor and travel as one run (about 18 suffixes). Each block of documents sends the
   distinct anchors' fingerprints, packed, to buckets; a bucket answers which anchors occur again. A fingerprint that collides
   by chance only lets a run pass that the next pass drops.
2. Runs whose anchor recurs are sent, as bytes, to the bucket of their anchor. Runs that are equal as a whole collapse there;
   the suffixes of the rest are radix-sorted, eight bytes a pass, down to the full depth, on the text itself. Each group's
   smallest identifier is its first; the windows of other documents are marked.
3. Marked windows go back to their block, where a document's marked bytes are united and cut out.

Scale: texts are shuffled once, into blocks of a few MB by the hash of the identifier; all passes read that one exchange, and put
a block's rows in one order, as they name rows by their place. The number of partitions of every exchange follows from the bytes. Passes move packed arrays. Equal runs of a block are sent once. An anchor with over HOT runs is not sent to one
bucket: its suffixes are dealt out one by one, by the hash of all their bytes. No list of anchors reaches the driver.

Edge cases: a null text counts as empty; a text shorter than `depth` loses nothing; a null identifier is larger than all
others; rows with equal identifiers are one place in the order and never remove each other's bytes, whatever their texts; matches never cross
documents; very long texts are handled whole, in pieces of CHUNK positions; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, dealt, even_keys, part_count, text_bytes
from .passes import ANSWER, SENT, answer, binary, bucket_of, flags, in_order, mix, send, width_for

DEPTH = 50
GRAM = 16
BLOCK_BYTES = 2 << 20, 64 << 20
BUCKET_BYTES = 8 << 20, 256 << 20
CHUNK = 1 << 20
HOT = 4096
#: Bytes of a removed run that make it a passage (some 50 words) rather than a phrase that repeats by chance.
PASSAGE = 250
NAMELESS = np.iinfo(np.int64).max

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """n overlapping 8-byte words of data, from each position on."""
    return np.ndarray((n,), "<u8", data, at, (1,))


class Block:
    """The documents of a block in one buffer, and the runs of suffixes that share an anchor."""

    def __init__(self, table: pa.Table, depth: int) -> None:
        self.depth = depth
        table = in_order(table, "body")
        ids = table.column("id").combine_chunks()
        self.ids = ids.fill_null(int(NAMELESS)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        parts = [x.as_py() or b"" for x in table.column("body")]
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(parts) + bytes(16), np.uint8)
        self.at, self.n, keys = self._runs()  # first window, number of windows, anchor
        self.keys, self.place, counts = np.unique(mix(keys), return_inverse=True, return_counts=True)
        self.counts = np.minimum(counts, 255).astype(np.uint8)
        self.doc = np.searchsorted(self.starts, self.at, "right") - 1

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        depth, width, total = self.depth, self.depth - GRAM + 1, int(self.sizes.sum())
        at, n, keys = [], [], []
        last = np.ones(total, bool)  # a window may not start in the last depth-1 bytes of a document
        for a, k in zip(self.starts, self.sizes, strict=True):
            if k >= depth:
                last[a : a + k - depth + 1] = False
        opening = np.zeros(total, bool)
        opening[self.starts[self.sizes > 0]] = True
        for a in range(0, max(0, total - depth + 1), CHUNK):
            windows = min(CHUNK, total - depth + 1 - a)
            grams = windows + width - 1
            h = _words(self.data, a, grams) * _K1
            h ^= h >> np.uint64(32)
            h += _words(self.data, a + 8, grams) * _K2
            h ^= h >> np.uint64(29)
            h *= _K3
            h ^= h >> np.uint64(32)
            step = 1
            while 2 * step <= width:
                h = np.minimum(h[:-step], h[step:])
                step *= 2
            if width > step:
                h = np.minimum(h[: windows], h[width - step : width - step + windows])
            valid = ~last[a : a + windows]
            change = np.empty(windows, bool)
            change[0] = True
            np.not_equal(h[1:windows], h[: windows - 1], out=change[1:])
            change |= opening[a : a + windows]
            change[1:] |= ~valid[:-1]
            begin = np.flatnonzero(change & valid)
            if not len(begin):
                continue
            stops = np.flatnonzero(change | ~valid)  # a run ends where another begins or no window may start
            following = np.searchsorted(stops, begin, "right")
            ends = np.where(following < len(stops), stops[np.minimum(following, len(stops) - 1)], windows)
            at.append(begin + a), n.append(ends - begin), keys.append(h[begin])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate(n), np.concatenate(keys)


def _packed(values: np.ndarray | bytes, codec: zstandard.ZstdCompressor) -> bytes:
    return codec.compress(values if isinstance(values, bytes) else values.tobytes())


def _anchor_rows(table: pa.Table, depth: int, buckets: int, width: int) -> pa.Table:
    """Pass 1, a block's side: packed fingerprints and counts of its distinct anchors, by bucket."""
    block = Block(table, depth)
    return send(table.column("blk")[0].as_py(), block.keys, block.counts, buckets, width)


RUN_SCHEMA = "bucket long, blk long, ids binary, at binary, n binary, keys binary, body binary, own binary"


def _run_rows(key: tuple, left: pa.Table, right: pa.Table, depth: int, buckets: int) -> pa.Table:
    """Pass 2, a block's side: runs whose anchor occurs again. `own` holds what the block marks by itself: (row, from, to)."""
    out: list[tuple] = []
    number = key[0].as_py()
    if left.num_rows and right.num_rows:
        block = Block(left, depth)
        again, hot = flags(block.keys, right, buckets)
        raw, first, marked, sends = block.data.tobytes(), {}, [], []
        picked = np.flatnonzero(again[block.place])
        picked = picked[np.lexsort((block.at[picked], block.ids[block.doc[picked]]))]  # smallest identifier first
        docs, ats, ns, places = block.doc[picked].tolist(), block.at[picked].tolist(), block.n[picked].tolist(), block.place[picked].tolist()
        ids, starts = block.ids.tolist(), block.starts.tolist()
        for doc, at, n, place in zip(docs, ats, ns, places, strict=True):
            if not hot[place]:
                body = raw[at : at + n + depth - 1]
                if first.setdefault(body, ids[doc]) != ids[doc]:
                    marked.append((doc, at - starts[doc], at - starts[doc] + n + depth - 1))
                else:
                    sends.append((int(block.keys[place]), ids[doc], doc, at - starts[doc], n, body))
                continue
            for x in range(at, at + n):  # a hot anchor's suffixes go one by one, by all their bytes
                body = raw[x : x + depth]
                if first.setdefault(body, ids[doc]) != ids[doc]:
                    marked.append((doc, x - starts[doc], x - starts[doc] + depth))
                else:
                    sends.append((int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little"), ids[doc], doc, x - starts[doc], 1, body))
        by: dict[int, list] = {}
        if sends:
            for b, x in zip(bucket_of(np.array([s[0] for s in sends], np.uint64), buckets).tolist(), sends, strict=True):
                by.setdefault(b, []).append(x)
        codec = zstandard.ZstdCompressor(level=1)
        for b, xs in by.items():
            places = np.array([x[1:5] for x in xs], np.int64).T  # identifiers, documents, first windows, numbers of windows
            out.append((b, _packed(places[:2], codec), _packed(places[2], codec), _packed(places[3], codec), np.array([x[0] for x in xs], np.uint64).tobytes(), _packed(b"".join(x[5] for x in xs), codec), b""))
        if marked:
            out.append((number % buckets, b"", b"", b"", b"", b"", _packed(_united(np.array(marked, np.int64)), codec)))
    columns = list(zip(*out, strict=True)) or [()] * 7
    return pa.table({"bucket": pa.array(columns[0], pa.int64()), "blk": pa.array([number] * len(out), pa.int64()), **{n: binary(list(c)) for n, c in zip(("ids", "at", "n", "keys", "body", "own"), columns[1:], strict=True)}})


def _united(spans: np.ndarray) -> np.ndarray:
    """(document, from, to) with touching and overlapping spans of a document united."""
    if not len(spans):
        return spans.reshape(0, 3)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    doc, begin, end = spans.T
    wide = doc * (int(end.max()) + 2)  # keeps documents apart in one running maximum
    reach = np.maximum.accumulate(wide + end)
    new = np.concatenate(([True], (wide + begin)[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return np.stack([doc[at], begin[at], np.maximum.reduceat(end, at)], 1)


def _sorted_windows(data: np.ndarray, pos: np.ndarray, ids: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Radix passes over suffixes at pos (within their group of equal anchors), eight bytes each: whether each suffix also has
    a smaller identifier in its group of equal windows."""
    marked = np.zeros(len(pos), bool)
    live = np.arange(len(pos))
    for digit in sorted({*range(0, depth - 7, 8), depth - 8}):
        value = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[pos[live] + digit]
        order = np.lexsort((value, group))
        live, value, group = live[order], value[order], group[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])))
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(live)))
        own = ids[live]
        several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)  # a group of one document is done
        group = np.repeat(np.arange(len(at)), sizes)
        stay = np.repeat(several, sizes)
        live, group = live[stay], group[stay]
        if not len(live):
            return marked
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(ids[live], at), np.diff(np.append(at, len(live))))
    marked[live[ids[live] > least]] = True
    return marked


def _marks(table: pa.Table, depth: int) -> pa.Table:
    """Pass 2, a bucket's side: the marked spans of each block's rows."""
    spans: dict[int, list[np.ndarray]] = {}
    blks, ids, docs, ats, ns, keys, bodies = [], [], [], [], [], [], []
    opened = zstandard.ZstdDecompressor().decompress
    for blk, row_ids, at, n, key, body, own in zip(table.column("blk").to_pylist(), *(table.column(c) for c in ("ids", "at", "n", "keys", "body", "own")), strict=True):
        if len(o := own.as_py()):
            spans.setdefault(blk, []).append(np.frombuffer(opened(o), np.int64).reshape(-1, 3))
            continue
        pairs = np.frombuffer(opened(row_ids.as_py()), np.int64).reshape(2, -1)
        ids.append(pairs[0]), docs.append(pairs[1]), ats.append(np.frombuffer(opened(at.as_py()), np.int64)), ns.append(np.frombuffer(opened(n.as_py()), np.int64)), keys.append(np.frombuffer(key.as_py(), np.uint64)), bodies.append(opened(body.as_py()))
        blks.append(np.full(pairs.shape[1], blk, np.int64))
    if ids:
        blk, ids, doc, at, n, key = (np.concatenate(x) for x in (blks, ids, docs, ats, ns, keys))
        raw = b"".join(bodies) + bytes(8)
        del bodies
        offset = np.concatenate(([0], np.cumsum(n + depth - 1)[:-1]))
        order = np.argsort(ids, kind="stable")
        first: dict[bytes, int] = {}
        whole, one = [], []
        lengths, offsets, listed = (n + depth - 1).tolist(), offset.tolist(), ids.tolist()
        for i in order.tolist():  # equal runs: the first stands for all, later documents are marked whole
            body = raw[offsets[i] : offsets[i] + lengths[i]]
            j = first.setdefault(body, i)
            if j == i:
                one.append(i)
            elif listed[i] != listed[j]:
                whole.append(i)
            else:
                one.append(i)
        del first
        whole, one = np.array(whole, np.int64), np.array(one, np.int64)
        found = [np.stack([blk[whole], doc[whole], at[whole], at[whole] + n[whole] + depth - 1], 1)] if len(whole) else []
        # suffixes of the runs that are left, if an anchor has several of them
        _, place, times = np.unique(key[one], return_inverse=True, return_counts=True)
        several = times[place] > 1
        one, place = one[several], place[several]
        if len(one):
            # whole anchors at a time, so that a pass holds a bounded number of suffixes
            order = np.argsort(place, kind="stable")
            one, place = one[order], place[order]
            data = np.frombuffer(raw, np.uint8)
            sizes = np.cumsum(n[one])
            edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            cuts, base = [0], 0
            for a, b in zip(edge, np.append(edge[1:], len(one)), strict=True):
                if sizes[b - 1] - base > CHUNK and a > cuts[-1]:
                    cuts.append(int(a))
                    base = sizes[a - 1]
            for a, b in zip(cuts, [*cuts[1:], len(one)], strict=True):
                runs = one[a:b]
                rows = np.repeat(np.arange(a, b), n[runs])
                inner = np.arange(len(rows)) - np.repeat(np.cumsum(n[runs]) - n[runs], n[runs])
                marked = _sorted_windows(data, offset[one[rows]] + inner, ids[one[rows]], place[rows], depth)
                if marked.any():
                    r, begin = one[rows[marked]], inner[marked]
                    found.append(np.stack([blk[r], doc[r], at[r] + begin, at[r] + begin + depth], 1))
        if found:
            found = np.concatenate(found)
            found = found[np.argsort(found[:, 0], kind="stable")]
            for b, part in zip(*_split(found[:, 0], found[:, 1:]), strict=True):
                spans.setdefault(b, []).append(part)
    out = [(b, _united(np.concatenate(x)).tobytes()) for b, x in spans.items()]
    return pa.table({"blk": pa.array([x[0] for x in out], pa.int64()), "spans": binary([x[1] for x in out])})


def _split(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at].tolist(), np.split(rows, at[1:])


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pass 3: a block's documents without their marked bytes."""
    left = in_order(left, "body")
    parts = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 3) for x in right.column("spans")]
    spans = _united(np.concatenate(parts)) if parts else np.zeros((0, 3), np.int64)
    begin = np.searchsorted(spans[:, 0], np.arange(left.num_rows + 1))
    sizes, removed, runs, longest, passages, kept = [], [], [], [], [], []
    for i, value in enumerate(left.column("body")):
        body = value.as_py() or b""
        own = spans[begin[i] : begin[i + 1], 1:].tolist()
        lengths = [b - a for a, b in own]
        sizes.append(len(body)), runs.append(len(own)), removed.append(sum(lengths)), longest.append(max(lengths, default=0)), passages.append(sum(x >= PASSAGE for x in lengths))
        edges = [0, *(x for pair in own for x in pair), len(body)]
        kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if own else body)
    counts = {n: pa.array(x, pa.int64()) for n, x in (("n_bytes", sizes), ("n_removed", removed), ("n_spans", runs), ("longest_removed", longest), ("n_passages", passages))}
    return pa.table({"id": left.column("id"), **counts, "kept": binary(kept)})


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, kept_bytes: bool = True) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, longest_removed (bytes of the longest removed run), n_passages
    (removed runs of at least PASSAGE bytes), kept_sha256, kept_text (the bytes that stay, without characters that a cut broke)
    and, if kept_bytes, kept (the bytes themselves).

    depth: bytes of a window, at least 24.
    """
    total = text_bytes(docs, text)
    blocks, buckets = block_count(total, *BLOCK_BYTES), block_count(total, *BUCKET_BYTES)
    parts, width = part_count(docs.sparkSession, total), width_for(total // 16)
    n, m = min(parts, blocks), min(parts, buckets)
    of_block, of_bucket = even_keys(blocks, n), even_keys(buckets, m)
    place = F.pmod(F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(text)), F.lit(blocks))
    rows = docs.select(dealt(place, of_block).alias("blk"), F.col(key).cast("long").alias("id"), F.encode(text, "UTF-8").alias("body")).repartition(n, "blk")
    by_bucket = lambda t: t.withColumn("slot", dealt(F.col("bucket"), of_bucket)).repartition(m, "slot").groupBy("slot")
    sent = rows.groupBy("blk").applyInArrow(lambda t: _anchor_rows(t, depth, buckets, width), SENT)
    again = by_bucket(sent).applyInArrow(lambda t: answer(t, width, HOT), ANSWER).repartition(n, "blk")
    runs = rows.groupBy("blk").cogroup(again.groupBy("blk")).applyInArrow(lambda k, x, y: _run_rows(k, x, y, depth, buckets), RUN_SCHEMA)
    marks = by_bucket(runs).applyInArrow(lambda t: _marks(t, depth), "blk long, spans binary").repartition(n, "blk")
    schema = "id long, n_bytes long, n_removed long, n_spans long, longest_removed long, n_passages long, kept_sha256 string, kept_text string" + ", kept binary" * kept_bytes
    out = rows.groupBy("blk").cogroup(marks.groupBy("blk")).applyInArrow(lambda x, y: _with_digest(_cut(x, y), kept_bytes), schema)
    return out.withColumnRenamed("id", key)


def _with_digest(table: pa.Table, kept_bytes: bool) -> pa.Table:
    kept = [x.as_py() for x in table.column("kept")]
    digests = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
    texts = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
    columns = [*table.columns[:6], digests, texts] + ([table.column("kept")] if kept_bytes else [])
    return pa.table(columns, names=[*table.column_names[:6], "kept_sha256", "kept_text"] + ["kept"] * kept_bytes)
