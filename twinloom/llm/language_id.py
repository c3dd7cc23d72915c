"""Language identification, word first: known words score by their log frequency in each language; an unseen word falls back to
character n-grams, the longest order of which any is known, down to single letters.

Training uses a bounded sample of labelled documents: about `max_train_docs` per language, picked by the hash of the identifier,
and fewer per language if there are so many languages that `max_train_rows` would be exceeded. That is the only bound: every language,
word and n-gram of the sample is kept. Words are counted by Spark, n-grams once per distinct word of a language, times its count.
The model that is broadcast holds each token's counts in the languages that have it only, so it grows with the sample, not with the
corpus. Prediction reads whole texts.

A word is a run of letters (Unicode category L), lower-cased. Each token gives a vector of log posteriors over the languages (uniform prior); n-gram vectors weigh BACKOFF per order lost.
A document's vector is the sum over its tokens; the prediction is its maximum (ties: the language that sorts first) and the
score is that language's posterior, computed from the mean vector times at most EVIDENCE tokens so that it stays informative.

Edge cases: a null text, a text without letters (numerals such as ½ are none) and a model without languages give ('und', 0.0); rows
without language or text, and rows without identifier, are not learned from; rows that share an identifier are learned from and
predicted each by its own text; a very long text is counted and predicted whole; of tied languages the one that sorts first is
predicted; an empty table gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, spread

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
BACKOFF = 0.6
SMOOTHING = 0.5
EVIDENCE = 30
MAX_TRAIN_DOCS = 2_000
MAX_TRAIN_ROWS = 100_000
#: Words whose vectors a task keeps at most; fewer if there are many languages (CACHE_FLOATS numbers in all).
CACHE, CACHE_FLOATS = 200_000, 16_000_000
LETTERS = re.compile(r"[^\W\d_]+")
EXACT_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. The class of `re` holds numerals too; only where it found any is the slower one asked."""
    found = LETTERS.findall(text.lower())
    return found if "".join(found).isalpha() or not found else EXACT_LETTERS.findall(text.lower())


def held_out(key: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the identifier as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _hashes(tokens: list[str], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in tokens), np.uint64, len(tokens))


class Model:
    """Vectors of words and n-grams over the languages, in sorted order.

    A token's log posterior is the same for all languages without it but for their sizes, so a row holds what its own languages
    have above that, and the sum that makes it a distribution. Tokens are kept as sorted 64-bit hashes, under a seed that gives each of an
    order its own; a word that the model does not know is taken for a known one once in 10^13 words or so."""

    def __init__(self, languages: list[str], counts: dict[int, tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """counts: order (0: whole words) -> distinct tokens, and occurrences as (place of the token, place of the language, number)."""
        self.languages = sorted(languages)
        self.seed, hashed = 0, {k: _hashes(x[0], 0) for k, x in counts.items()}
        while any(len(np.unique(h)) < len(h) for h in hashed.values()):
            self.seed += 1
            hashed = {k: _hashes(x[0], self.seed) for k, x in counts.items()}
        self.keys: dict[int, tuple[np.ndarray, int]] = {}
        self.base: dict[int, np.ndarray] = {}
        starts, langs, gains, norms, at, filled = [], [], [], [], 0, 0
        for order, (tokens, rows, own, n) in counts.items():
            totals = np.bincount(own, n, len(self.languages))
            whole = totals + SMOOTHING * (len(tokens) + 1)
            base = np.log(SMOOTHING / whole) if len(self.languages) else np.zeros(0)
            by_hash = np.argsort(hashed[order])
            place = np.empty(len(tokens), np.int64)
            place[by_hash] = np.arange(len(tokens))
            rows = place[rows]
            ranked = np.lexsort((own, rows))
            rows, own, n = rows[ranked], own[ranked], n[ranked]
            # log of the sum over all languages: what all have anyway, and what the token's own have beyond that
            more = np.bincount(rows, n / whole[own] if len(own) else n, len(tokens))
            norms.append(np.log(np.exp(base).sum() + more) if len(tokens) else np.zeros(0))
            self.keys[order] = hashed[order][by_hash], at
            self.base[order] = base
            starts.append(np.searchsorted(rows, np.arange(len(tokens))) + filled)
            langs.append(own.astype(np.int32)), gains.append(np.log((n + SMOOTHING) / SMOOTHING).astype(np.float32))
            at += len(tokens)
            filled += len(rows)
        joined = lambda parts, kind: np.concatenate([np.asarray(p, kind) for p in parts]) if parts else np.zeros(0, kind)
        self.starts = np.append(joined(starts, np.int64), filled)
        self.langs, self.gains, self.norms = joined(langs, np.int32), joined(gains, np.float32), joined(norms, np.float64)

    def rows(self, order: int, tokens: list[str]) -> np.ndarray:
        """The rows of tokens of an order, -1 for those that are not known."""
        keys, first = self.keys[order]
        hashes = _hashes(tokens, self.seed)
        if not len(keys):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at + first, -1)

    def vectors(self, words: list[str]) -> np.ndarray:
        """One row per word: the weighted mean of the rows that stand for it, zeros if there are none. A known word stands for itself;
        another one goes by its known n-grams of the longest order with any."""
        n, k = len(words), len(self.languages)
        found = self.rows(0, words)
        rest = np.flatnonzero(found < 0)
        flat, owner = [found[found >= 0]], [np.flatnonzero(found >= 0)]
        weight, orders, own_weight = (found >= 0).astype(np.float64), np.zeros(n, np.int64), BACKOFF
        for order in ORDERS:
            if not len(rest):
                break
            parts = [grams(words[i], order) for i in rest.tolist()]
            held = np.repeat(rest, [len(x) for x in parts])
            found = self.rows(order, [g for x in parts for g in x])
            flat.append(found[found >= 0]), owner.append(held[found >= 0])
            got = np.unique(owner[-1])
            weight[got], orders[got] = own_weight, order
            rest = np.setdiff1d(rest, got, assume_unique=True)
            own_weight *= BACKOFF
        flat, owner = np.concatenate(flat), np.concatenate(owner)
        if not len(flat):
            return np.zeros((n, k), np.float32)
        share = (weight / np.maximum(1, np.bincount(owner, minlength=n)))[owner]
        begin, wide = self.starts[flat], self.starts[flat + 1] - self.starts[flat]
        place = np.repeat(begin - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        out = np.bincount(np.repeat(owner * k, wide) + self.langs[place], np.repeat(share, wide) * self.gains[place], n * k).reshape(n, k)
        for order in set(orders.tolist()):
            own = orders == order
            out[own] += weight[own, None] * self.base[order]
        out -= np.bincount(owner, share * self.norms[flat], n)[:, None]
        return out.astype(np.float32)


class Predictor:
    """Predicts texts with a model; keeps the vectors of up to CACHE words."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}
        self.places = max(1, min(CACHE, CACHE_FLOATS // max(1, len(model.languages))))
        self.kept = np.zeros((self.places, len(model.languages)), np.float32)

    def _total(self, words: Counter) -> np.ndarray:
        """Sum of the vectors of a text's words."""
        if len(self.cache) + len(words) > self.places:
            self.cache.clear()
        at = list(map(self.cache.get, words))
        n = np.fromiter(words.values(), np.float64, len(words))
        if None in at:
            new = [w for w, i in zip(words, at, strict=True) if i is None]
            found = self.model.vectors(new)
            if len(words) > self.places:  # more words than the cache has places: nothing of this text is kept
                return n @ found.astype(np.float64)
            first = len(self.cache)
            self.kept[first : first + len(new)] = found
            self.cache.update(zip(new, range(first, first + len(new)), strict=True))
            at = list(map(self.cache.get, words))
        return n @ self.kept[at].astype(np.float64)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else None
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = self._total(words)
        best = int(np.argmax(np.round(total, 9)))
        scaled = total * (min(EVIDENCE, words.total()) / words.total())
        return self.model.languages[best], float(min(1.0, math.exp(scaled[best] - np.logaddexp.reduce(scaled))))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learns from a sample of the labelled documents that are not held out. Only counts of the sample reach the driver."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    found = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = sorted(r["lang"] for r in found.collect())
    if not languages:
        return Model([], {k: ([], *[np.zeros(0, np.int64)] * 3) for k in (0, *ORDERS)})
    most = max(1, min(max_train_docs, max_train_rows // len(languages)))
    share = F.broadcast(found.select(F.col("lang").alias("_lang"), (F.lit(float(most)) / F.col("n")).alias("_share")))
    picked = rows.join(share, F.col("lang") == F.col("_lang")).filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < F.col("_share") * 1_000_000)
    cut = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    words = spread(picked.select("lang", "text")).select("lang", F.explode(cut).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    words = materialise(words, "words")
    counts = {order: _columns((_grams_of(words, order) if order else words).select("lang", "token", "n").toArrow(), languages) for order in (0, *ORDERS)}
    model = Model(languages, counts)
    del counts
    pa.default_memory_pool().release_unused()
    return model


def _grams_of(words: DataFrame, order: int) -> DataFrame:
    """Counts of the n-grams of counted words; the same as `grams` gives."""
    marked = words.select("lang", (F.col("token") if order == 1 else F.concat(F.lit("<"), "token", F.lit(">"))).alias("word"), "n").filter(F.length("word") >= order)
    parts = F.transform(F.sequence(F.lit(1), F.length("word") - order + 1), lambda i: F.substring(F.col("word"), i, F.lit(order)))
    return marked.select("lang", F.explode(parts).alias("token"), "n").groupBy("lang", "token").agg(F.sum("n").alias("n"))


def _columns(table: pa.Table, languages: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, and the rows as (place of the token, place of the language, number)."""
    import pyarrow.compute as pc

    tokens = pc.unique(table.column("token"))
    rows = pc.index_in(table.column("token"), tokens).to_numpy()
    own = pc.index_in(table.column("lang"), pa.array(languages, pa.string())).to_numpy()
    return tokens.to_pylist(), rows.astype(np.int64), own.astype(np.int64), table.column("n").to_numpy().astype(np.float64)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Predictor(shared.value)
        for batch in batches:
            found = [guess(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))).mapInArrow(run, "id long, lang_pred string, score double")
    return rows.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    return predict(docs, train(docs, key, text, lang, **how), key, text)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.0, **how) -> DataFrame:
    """The documents, with all their columns, whose language is recognised with at least min_score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, lang, **how))
    place = docs.columns.index(text)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Predictor(model.value)
        for batch in batches:
            found = (guess(x.as_py()) for x in batch.column(place))
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= min_score for x in found], pa.bool_()))

    small_batches(docs.sparkSession)
    return spread(docs).mapInArrow(known, docs.schema)
