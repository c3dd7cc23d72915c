"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts and items are sequences of words (letters and digits, lower-cased). Item-sized windows of the documents and the items are
embedded by CGK random walks: a walk writes the word that it stands on and moves on or stays by a random bit of (step, word),
so that a small edit distance becomes a small Hamming distance. The Hamming space is searched by bit-sampling LSH: a key is
what an embedding holds at SAMPLED random steps; REPEATS independent walks and samples give the target recall. Window and item
that agree in a key are verified by the exact edit distance (with free ends around the window, so a shift costs nothing).
Items of more than EMBEDDED_WORDS words are not embedded, as the share of agreeing steps falls with the length: all their windows
go to the exact check, which first counts the words that window and item share.

Windows: of all item-sized windows only those are embedded that share `q` consecutive words with the item at the place where
the item has them. No passage within the distance is lost by that: k edits leave one of k + 1 pieces of n words untouched, and
the longest has at least ceil((n - k) / (k + 1)) words, which is q.

The items are read in blocks of at most BLOCK_ITEMS and BLOCK_WORDS words, and each block, whose size is so bounded, is sent to
the executors; more items are more passes over the documents, not more memory. Documents are not shuffled.

Edge cases: items with fewer than MIN_WORDS words allow no edits: they match where a document holds exactly these words in a row;
those with fewer than MIN_INSIDE words, which any text may hold, match only a document that consists of them; items and texts that are null or hold no word match nothing; equal items each match; equal rows each give their
matches; rows that share an identifier match each by its own text; very long texts are searched whole; empty tables give an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, small_batches, spread

MAX_EDITS = 0.25
MIN_WORDS = 6
MIN_INSIDE = 3
LONGEST_SEED = 3
SAMPLED = 2
TARGET_RECALL = 0.999
#: Share of steps at which the embeddings of two sequences at the largest distance still agree, at least.
AGREEMENT = 0.4
#: Longer items are not embedded: walks that are out of step meet late, so AGREEMENT does not hold; all their windows are verified.
EMBEDDED_WORDS = 16
REPEATS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - AGREEMENT**SAMPLED))
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000
BITS = 4096
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Walks:
    """CGK walks and sampled steps for sequences of up to `longest` words."""

    def __init__(self, longest: int, seed: int = 7) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        self.steps = 3 * longest
        self.moves = random.integers(0, 2, (REPEATS, self.steps, BITS), np.uint8) if longest <= 400 else None
        self.mix = random.integers(0, 2**63, (REPEATS, self.steps), np.uint64) | np.uint64(1)
        self.at = random.random((REPEATS, SAMPLED))

    def bit(self, repeat: int, step: int, word: np.ndarray) -> np.ndarray:
        """The random bit of (step, word): whether the walk moves on."""
        if self.moves is not None:
            return self.moves[repeat, step][word & (BITS - 1)]
        x = (word.astype(np.uint64) + np.uint64(1)) * self.mix[repeat, step]
        return ((x ^ (x >> np.uint64(31))) * self.mix[repeat, step] >> np.uint64(63)).astype(np.uint8)

    def keys(self, rows: np.ndarray, sizes: np.ndarray, repeat: int) -> np.ndarray:
        """What rows of words (padded by zeros, sizes[i] long) hold at the sampled steps: an array (rows, SAMPLED).

        The steps are taken in proportion to a row's own length, so windows and items of one length are comparable."""
        at = np.zeros(len(rows), np.int64)
        index = np.arange(len(rows))
        sampled = np.minimum((self.at[repeat][None, :] * 2 * sizes[:, None]).astype(np.int64), self.steps - 1)
        out = np.zeros((len(rows), SAMPLED), np.int64)
        padded = np.concatenate([rows, np.zeros((len(rows), 1), rows.dtype)], 1)
        for step in range(int(sampled.max()) + 1 if len(rows) else 0):
            word = padded[index, at]
            for j in range(SAMPLED):
                np.copyto(out[:, j], word, where=sampled[:, j] == step)
            at = np.minimum(at + self.bit(repeat, step, word), sizes)
        return out


class Items:
    """A block of benchmark items, with the seeds that find their windows."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float) -> None:
        kept = [(key, w) for key, w in ((key, words_of(text)) for key, text in items) if w]
        self.keys = [k for k, _ in kept]
        self.known: dict[str, int] = {}
        for _, w in kept:
            for x in w:
                self.known.setdefault(x, len(self.known) + 1)
        self.words = [np.array([self.known[x] for x in w], np.int64) for _, w in kept]
        self.edits = [int(len(w) * max_edits) if len(w) >= MIN_WORDS else 0 for w in self.words]
        self.short: dict[bytes, list[int]] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, w in enumerate(self.words):
            if len(w) < MIN_INSIDE:
                self.short.setdefault(w.tobytes(), []).append(i)
                continue
            q = min(LONGEST_SEED, -(-(len(w) - self.edits[i]) // (self.edits[i] + 1)))
            for a in range(len(w) - q + 1):
                places.setdefault(tuple(w[a : a + q]), []).append((i, a))
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.base = len(self.known) + 2
        self.seeds: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for q in {len(x) for x in places}:
            own = sorted((self.code(x), np.array(at, np.int64)) for x, at in places.items() if len(x) == q)
            self.seeds[q] = np.array([c for c, _ in own], np.int64), [at for _, at in own]
        self.longest = max([len(w) for w in self.words if MIN_WORDS <= len(w) <= EMBEDDED_WORDS], default=0)  # so the tables are narrow
        self.walks = Walks(self.longest) if self.longest else None
        self.table = np.zeros((len(self.words), self.longest), np.int64)
        for i, w in enumerate(self.words):
            if MIN_WORDS <= len(w) <= EMBEDDED_WORDS:
                self.table[i, : len(w)] = w
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.exact = (self.sizes > EMBEDDED_WORDS) | (self.sizes < MIN_WORDS)
        embedded = np.where(self.exact, 0, self.sizes)
        self.item_keys = [self.walks.keys(self.table, embedded, r) for r in range(REPEATS)] if self.walks else []

    def code(self, words: tuple[int, ...]) -> int:
        out = 0
        for x in words:
            out = out * self.base + int(x)
        return out

    def windows(self, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(text, item, start) of the windows that hold a seed at its place. flat: the texts one after the other; begins: where
        each begins."""
        found = []
        for q, (codes, places) in self.seeds.items():
            if len(flat) < q:
                continue
            own = flat[: len(flat) - q + 1].copy()
            for i in range(1, q):
                own *= self.base
                own += flat[i : len(flat) - q + 1 + i]
            near = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hits = np.flatnonzero(codes[near] == own)
            texts = np.searchsorted(begins, hits, "right") - 1
            inside = texts == np.searchsorted(begins, hits + q - 1, "right") - 1  # no seed across two texts
            for at, text, begin in zip(hits[inside].tolist(), texts[inside].tolist(), begins[texts[inside]].tolist(), strict=True):
                for item, a in places[near[at]].tolist():
                    found.append((text, item, at - begin - a))
        return np.unique(np.array(found, np.int64).reshape(-1, 3), axis=0)

    def candidates(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which of the rows (text, item, start) agree with their item in a key of any repeat, or have an item that is not embedded."""
        live = self.exact[rows[:, 1]].copy()
        short = np.flatnonzero(~live)
        if len(short):
            live[short] = self.agreeing(flat, begins, lengths, rows[short])
        return live

    def agreeing(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which of the rows (text, item, start), all of embedded items, agree with their item in a key of any repeat."""
        live = np.zeros(len(rows), bool)
        size = self.sizes[rows[:, 1]]
        place = rows[:, 2][:, None] + np.arange(self.longest)
        inside = (place >= 0) & (place < lengths[rows[:, 0]][:, None]) & (np.arange(self.longest) < size[:, None])
        table = np.where(inside, flat[np.where(inside, place + begins[rows[:, 0]][:, None], 0)], 0)
        for repeat in range(REPEATS):
            open_ = np.flatnonzero(~live)
            if not len(open_):
                break
            keys = self.walks.keys(table[open_], size[open_], repeat)
            # two unknown words (0) are not known to be equal, so they agree with nothing
            live[open_] = ((keys == self.item_keys[repeat][rows[open_, 1]]) & (keys > 0)).all(1)
        return live

    def distance(self, item: int, text: np.ndarray, start: int) -> tuple[int, int, int]:
        """Least edit distance of an item to a part of the text around a window; where that part begins and ends."""
        k, w = self.edits[item], self.words[item]
        low, high = max(0, start - k), min(len(text), start + len(w) + k)
        part = text[low:high]
        own, times = self.bags[item]
        there, often = np.unique(part, return_counts=True)
        at = np.minimum(np.searchsorted(there, own), len(there) - 1)
        if int(np.minimum(np.where(there[at] == own, often[at], 0), times).sum()) < len(w) - k:  # too few of its words
            return k + 1, low, low
        row, origin = np.zeros(len(part) + 1, np.int64), np.arange(len(part) + 1)
        step = np.arange(len(part) + 1)
        for i, x in enumerate(w, 1):
            best = np.empty_like(row)
            begin = np.empty_like(origin)
            best[0], begin[0] = i, 0
            change = row[:-1] + (part != x)
            drop = row[1:] + 1
            best[1:] = np.minimum(change, drop)
            begin[1:] = np.where(change <= drop, origin[:-1], origin[1:])
            # words of the text beyond the item's, taken from the left
            level = best - step
            lowest = np.minimum.accumulate(level)
            source = np.maximum.accumulate(np.where(level == lowest, step, 0))
            row, origin = lowest + step, begin[source]
        end = int(np.argmin(row))
        return int(row[end]), low + int(origin[end]), low + end


#: The items that this worker built last, by the broadcast they come from: tasks of one worker share them.
_built: dict[str, Items] = {}


def _items(name: str, block: list[tuple[int, str]], max_edits: float) -> Items:
    if name not in _built:
        _built.clear()
        _built[name] = Items(block, max_edits)
    return _built[name]


def _matches(items: Items, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, first word, word after the last, edits): per row and item the closest passage, the first of equals."""
    known, texts = items.known.get, []
    for i, value in enumerate(batch.column(1)):
        own = words_of(value.as_py())
        text = np.array(list(map(known, own, repeat(0))), np.int64)
        texts.append(text)
        if 0 < len(text) < MIN_INSIDE:
            for item in items.short.get(text.tobytes(), ()):
                yield i, item, 0, len(text), 0
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    rows = items.windows(flat, begins)
    if not len(rows):
        return
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, item, start in rows[items.candidates(flat, begins, lengths, rows)].tolist():
        edits, first, end = items.distance(item, texts[i], start)
        if edits <= items.edits[item]:
            best[i, item] = min(best.get((i, item), (edits, first, end)), (edits, first, end))
    for (i, item), (edits, first, end) in best.items():
        yield i, item, first, end, edits


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size; one partition at a time is on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t is not null").toLocalIterator():
        n = len(row["t"].split()) + 1
        if block and (len(block) >= BLOCK_ITEMS or size + n > BLOCK_WORDS):
            yield block
            block, size = [], 0
        block.append((row["k"], row["t"]))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """One row per document and item that it holds: key, item_key, first_word, n_words, edits, item_words."""
    spark = docs.sparkSession
    small_batches(spark)
    base = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")))
    schema = "id long, item long, first_word long, n_words long, edits long, item_words long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_key, item_text):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            items = _items(name, shared.value, max_edits)
            for batch in batches:
                found = list(_matches(items, batch))
                ids = batch.column(0).to_pylist()
                columns = [[ids[x[0]] for x in found], [items.keys[x[1]] for x in found], [x[2] for x in found], [x[3] - x[2] for x in found], [x[4] for x in found], [len(items.words[x[1]]) for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "item", "first_word", "n_words", "edits", "item_words"])

        out = out.union(base.mapInArrow(run, schema))
    return out.select(F.col("id").alias(key), F.col("item").alias(item_key), "first_word", "n_words", "edits", "item_words")


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item; decided row by row, with or without identifier."""
    rows, node = row_keys(docs, key)
    found = leaks(rows, benchmark, node, text, **how).select(F.col(node).alias(f"_leak_{node}")).distinct()
    return rows.join(found, rows[node] == F.col(f"_leak_{node}"), "left_anti").select(*docs.columns)
