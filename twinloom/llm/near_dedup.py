"""MinHash near-dedup with odd sketches: documents whose sets of word shingles have a Jaccard similarity of 0.75 or more.

1. Each text's set of 64-bit shingle hashes gives SAMPLES MinHash values. They are banded for candidate search (BANDS bands of
   ROWS rows: a pair at the threshold is missed with a probability below 1e-5), and folded into an odd sketch: every sample
   flips one of 1024 bits, and the population count of two sketches' XOR estimates how many samples differ.
2. Equal sets collapse to one representative (smallest identifier); only representatives go on.
3. Candidates that agree in a band are screened by their sizes and sketches, and confirmed on the full sets of shingles,
   computed anew from their texts. Nothing is linked by an estimate.
4. Links are found in rounds, so that a large group costs one confirmed link a document and not all its pairs: first each
   document with the most popular one of its bands (that whose bands hold the most documents, which is the likely origin of
   copies); then one document of each component with the most popular one of another component; at last every remaining pair
   of different components in a band. Pairs within a component change nothing. A band that many components share (a passage
   that countless documents hold, copies that were changed too much) is not expanded into pairs: its documents are joined
   exactly by prefix filtering, where two sets can only be similar if they share a shingle among their rarest, early enough in
   both for what follows to suffice. How early bounds the size of the partner, and only entries whose sizes fit meet, so countless
   documents of a template that are not similar enough don't meet at the template's shingles.

Skew: hot bands and hot sets are joined per (key, salt) after a combine; only a 4 MB filter of identifiers is broadcast, to keep
texts that are in no pair out of the shuffle; iterations are written to the shared folder. No pairs or components are collected.

Edge cases: null texts and texts without words have size 0, are their own component and are kept; with fewer than five words
the whole sequence is one shingle; rows with equal identifiers are linked each by its own text (a row each is returned, so equal
rows get the same result, and a row is kept if its component has no smaller identifier); rows without identifier are linked with
nothing, and are kept; very long texts are hashed in pieces; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import discard, materialise, maybe_in, row_keys, small_batches, spread

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 60, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: XOR bits of two sketches beyond which a pair at the threshold does not come by six standard deviations: about 90 of 360
#: samples differ there, at most 140, and 2 * 140 flips set 216 bits of 1024, give or take 11.
SKETCH_MOST = 275
SALTS = 32
#: A band with more components, or more pairs of a component and a member, is joined by prefix filtering.
HOT_COMPONENTS, HOT_PAIRS = 30, 2_000
PIECE = 2048
#: Places in the table of counts: 2^19.
COUNT_BITS = 19

_random = np.random.Generator(np.random.PCG64(20240229))
_ADD = _random.integers(0, 2**32, SAMPLES, np.uint32)
_MULTIPLY = _random.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)
_BAND = _random.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _random.integers(0, 2**32, SAMPLES, np.uint32)
_PLACE = _random.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # bytes split at \x20 and \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    if n < 1:
        return _mix((hashes * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    total = hashes[:n] * _PLACE[0]
    for i in range(1, SHINGLE):
        total += hashes[i : i + n] * _PLACE[i]
    return np.unique(_mix(total))


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for a in range(0, len(x), PIECE):
        table = np.bitwise_xor.outer(_ADD, x[a : a + PIECE])
        table *= _MULTIPLY[:, None]
        np.minimum(least, table.min(1), out=least)
    return least


def sketches(mins: np.ndarray) -> np.ndarray:
    """Odd sketches of rows of samples, as 64-bit words."""
    h = _mix(mins.astype(np.uint64) ^ (_FLIP.astype(np.uint64) << np.uint64(32)))
    bits = (h % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(mins))[:, None] * SKETCH_BITS
    odd = np.bincount(bits.ravel(), minlength=len(mins) * SKETCH_BITS).reshape(len(mins), SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view("<i8")


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    return _mix((_mix(rows + np.uint64(1)) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_SIGNATURE = "id long, n int, f1 long, f2 long, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        sizes, marks, mins = [], [], []
        for value in batch.column(1):
            found = shingles(value.as_py(), known)
            sizes.append(len(found))
            digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            marks.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
            mins.append(samples(found) if len(found) else np.zeros(SAMPLES, np.uint32))
        mins = np.array(mins, np.uint32).reshape(-1, SAMPLES)
        keys, odd = band_keys(mins), sketches(mins)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), bands, *(pa.array(odd[:, i]) for i in range(len(_SKETCH)))], names=["id", "n", "f1", "f2", "bands", *_SKETCH])


def _salt(key: str = "id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _salts(mask: str) -> Column:
    """The salts whose bit is set in a mask."""
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col(mask), i) == 1)


def _mask() -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("salts")


def _differ(a: str, b: str) -> Column:
    total = F.lit(0)
    for s in _SKETCH:
        total = total + F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")))
    return total


def _may_be_similar(a: str, b: str) -> Column:
    """What sizes and sketches leave over."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(x, y).cast("long") * 100 >= F.greatest(x, y).cast("long") * PERCENT) & (_differ(a, b) <= SKETCH_MOST)


class _Search:
    """Candidate tables of one run."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, members: DataFrame) -> None:
        self.docs = docs
        reps = members.filter("id = rep").select("id").distinct()
        self.own = own = materialise(sigs.join(reps, "id"), "representatives")
        self.heads = own.select("id", "n", *_SKETCH)
        keyed = own.select("id", F.explode("bands").alias("key")).withColumn("salt", _salt())
        groups = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("members"), _mask()).filter("low < high")
        shared = keyed.join(groups.select("key", "members", F.explode(_salts("salts")).alias("salt")), ["key", "salt"]).select("key", "id", "salt", "members")
        self.shared = materialise(shared, "bands")
        self.popular = materialise(self.shared.groupBy("id").agg(F.sum("members").alias("pop")), "popular")
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.used: list[DataFrame] = []  # tables that the pairs to be confirmed next are made from

    def first_pairs(self) -> DataFrame:
        """Each document with the most popular one that shares a band with it."""
        rows = self.shared.join(self.popular, "id").select("key", "id", "salt", "pop")
        best = rows.groupBy("key").agg(F.max(F.struct("pop", (-F.col("id")).alias("id"))).alias("best"), _mask()).select("key", "best", F.explode(_salts("salts")).alias("salt"))
        top = rows.join(best, ["key", "salt"]).groupBy("id").agg(F.max("best").alias("best"))
        return top.select((-F.col("best.id")).alias("a"), F.col("id").alias("b"))

    def component_pairs(self) -> DataFrame:
        """One document of each component with the most popular one of another component in its bands."""
        rows = self.labelled().join(self.popular, "id")
        own = rows.groupBy("key", "component").agg(F.max(F.struct("pop", (-F.col("id")).alias("id"))).alias("own"))
        best = own.groupBy("key").agg(F.max(F.struct("own", "component")).alias("best"))
        pairs = own.join(best, "key").filter(F.col("component") != F.col("best.component"))
        pairs = pairs.groupBy("component").agg(F.max(F.struct("best.own", F.col("own").alias("mine"))).alias("p"))
        return pairs.select((-F.col("p.own.id")).alias("a"), (-F.col("p.mine.id")).alias("b"))

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) that were not tested before and pass sizes and sketches."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        x, y = self.heads.withColumnRenamed("id", "a").alias("x"), self.heads.withColumnRenamed("id", "b").alias("y")
        return pairs.join(x, "a").join(y, "b").filter(_may_be_similar("x", "y")).select("a", "b")

    def confirm(self, pairs: DataFrame) -> bool:
        """Tests candidate pairs on their full sets; whether there were any new ones."""
        pairs = materialise(pairs, "pairs")
        while self.used:
            discard(self.used.pop())
        if pairs.isEmpty():
            return False
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        texts = maybe_in(self.docs, "id", wanted, "id")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Words()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), known).tobytes() for x in batch.column(1)], pa.binary())], names=["id", "found"])

        own = materialise(texts.mapInArrow(sets, "id long, found binary"), "sets")
        salted = pairs.withColumn("salt", _salt("b"))
        left = salted.select("a", "salt").distinct().join(own, F.col("a") == F.col("id")).select("a", "salt", F.col("found").alias("x"))
        right = salted.join(own, F.col("b") == F.col("id")).select("a", "salt", "b", F.col("found").alias("y"))

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= PERCENT * (len(x) + len(y) - common):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

        found = materialise(left.join(right, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "links")
        discard(own)
        self.links = found if self.links is None else self.links.union(found)
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        return True

    def free(self) -> None:
        """Deletes the tables that no result reads."""
        for table in (self.own, self.shared, self.popular):
            discard(table)

    def labelled(self) -> DataFrame:
        """Members of bands that still hold several components: key, id, component, n_components, n_members."""
        if self.links is None:
            rows = self.shared.select("key", "id", "salt", F.col("id").alias("component"))
        else:
            found = materialise(components(self.links), "components")
            rows = self.shared.join(found, "id", "left").select("key", "id", "salt", F.coalesce("component", "id").alias("component"))
        part = rows.groupBy("key", "component").agg(F.count("*").alias("members"), _mask())
        bands = part.groupBy("key").agg(F.count("*").alias("n_components"), F.sum("members").alias("n_members"), F.bit_or("salts").alias("salts")).filter("n_components > 1")
        bands = bands.select("key", "n_components", "n_members", F.explode(_salts("salts")).alias("salt"))
        return materialise(rows.join(bands, ["key", "salt"]).select("key", "id", "component", "n_components", "n_members"), "open")


def _places(found: np.ndarray) -> np.ndarray:
    """Where shingles stand in the table of counts."""
    return (found >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many documents hold a shingle, at least: counts of hashed shingles in a table of fixed size (2 MB)."""
    share = 1 << (COUNT_BITS - 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Words(), np.zeros(1 << COUNT_BITS, np.int32)
        for batch in batches:
            for text in batch.column(1):
                np.add.at(total, _places(shingles(text.as_py(), known)), 1)
        held = np.flatnonzero(total)
        for part in np.split(held, np.searchsorted(held, np.arange(1, 16) * share)):
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[0]) // share], pa.int32()), pa.array([part.astype(np.int32).tobytes()], pa.binary()), pa.array([total[part].tobytes()], pa.binary())], names=["part", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(share, np.int64)
        part = table.column("part")[0].as_py()
        for at, n in zip(table.column("at"), table.column("n"), strict=True):
            total[np.frombuffer(at.as_py(), np.int32) - part * share] += np.frombuffer(n.as_py(), np.int32)
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    out = np.zeros(1 << COUNT_BITS, np.int32)
    counted = texts.select("id", "text").mapInArrow(count, "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, n binary")
    for row in counted.collect():  # 16 rows at most
        out[row["part"] * share : (row["part"] + 1) * share] = np.frombuffer(row["n"], np.int32)
    return out


def _prefix_pairs(search: _Search, members: DataFrame) -> DataFrame:
    """Candidate pairs of different components among members (id, component), by shared rare shingles: exact for the threshold.

    Shingles are put in one order for all, about by how many members hold them. A similar pair's first common shingle in that
    order is followed, in both sets, by as many as the pair still needs, so shingles too far back open no pair. The order is by
    counts in a table of fixed size, which alone is broadcast; it need not be exact, only the same everywhere, and a shingle
    that is counted once is indeed held by one member."""
    texts = materialise(maybe_in(search.docs, "id", members, "id").join(members, "id").select("id", "text"), "hot-texts")
    rarity = texts.sparkSession.sparkContext.broadcast(_rarity(texts))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Words(), rarity.value
        for batch in batches:
            ids, sizes, tokens, after = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), known)
                n = len(found)
                often = counts[_places(found)]
                order = np.lexsort((found, often))
                behind = np.arange(n - 1, -1, -1)
                # a set of n shingles needs ceil(0.75 n) common ones at least, whatever its partner
                own = ((behind + 1) * 100 >= n * PERCENT) & (often[order] > 1)
                tokens.append(found[order[own]].view(np.int64)), after.append(behind[own])
                ids.append(np.full(len(after[-1]), key)), sizes.append(np.full(len(after[-1]), n))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(tokens), pa.int64()), pa.array(np.concatenate(after), pa.int32())], names=["id", "n", "shingle", "after"])

    # 100 * common >= 75 * union: with so many shingles left at the first common one, the partner has at most `reach`
    reach = F.floor((F.col("after") + 1) * (100 + PERCENT) / PERCENT).cast("long") - F.col("n")
    tokens = materialise(texts.mapInArrow(prefixes, "id long, n int, shingle long, after int").join(members, "id").withColumn("reach", reach), "prefixes")
    search.used += [texts, tokens]
    # the larger set looks for its partners' sizes, in at most three classes of 15%; the smaller one stands under its own
    size_class = lambda n: F.floor(F.log(n.cast("double")) * 7).cast("int")
    least = F.ceil(F.col("n") * PERCENT / 100)
    larger = tokens.filter(F.col("reach") >= least).withColumn("size", F.explode(F.sequence(size_class(least), size_class(F.least("n", "reach")))))
    smaller = tokens.filter("reach >= n").withColumn("size", size_class(F.col("n")))
    x, y = larger.alias("x"), smaller.hint("merge").alias("y")  # entries grow with the input, so they are never broadcast
    fits = (F.col("y.n") <= F.least("x.n", "x.reach")) & (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") * 100 >= F.col("x.n") * PERCENT)
    once = (F.col("y.n") < F.col("x.n")) | (F.col("y.id") < F.col("x.id"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.component") != F.col("y.component")) & fits & once)
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    nodes, node = row_keys(base.filter("id is not null"), "id")
    if node == "id":
        return _grouped(base).select(F.col("id").alias(key), "n_shingles", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
    found = _grouped(nodes.select(F.col(node).alias("id"), "text")).join(nodes.select(F.col(node).alias("id"), F.col("id").alias("own")), "id")
    found = materialise(found.select("own", "n_shingles", "component_id"), "rows-found")
    names = found.groupBy("component_id").agg(F.min("own").alias("least"))  # components of one identifier each, mostly: no key is hot after the combine
    out = found.join(names, "component_id").select(F.col("own").alias(key), "n_shingles", F.col("least").alias("component_id"), (F.col("own") == F.col("least")).alias("kept"))
    rest = _grouped(base.filter("id is null"))
    return out.union(rest.select("id", "n_shingles", "component_id", F.lit(True)))


def _grouped(base: DataFrame) -> DataFrame:
    """base: (id, text), no identifier twice. (id, n_shingles, component_id)."""
    sigs = materialise(spread(base).mapInArrow(_signatures, _SIGNATURE), "signatures")
    filled = sigs.filter("n > 0 and id is not null").select("id", "f1", "f2").withColumn("salt", _salt())
    same = filled.groupBy("f1", "f2").agg(F.min("id").alias("rep"), _mask()).select("f1", "f2", "rep", F.explode(_salts("salts")).alias("salt"))
    members = materialise(filled.join(same, ["f1", "f2", "salt"]).select("id", "rep"), "members")
    search = _Search(base.filter("id is not null"), sigs, members)
    search.confirm(search.screened(search.first_pairs()))
    search.confirm(search.screened(search.component_pairs()))
    opened = search.labelled().withColumn("hot", (F.col("n_components") > HOT_COMPONENTS) | (F.col("n_components") * F.col("n_members") > HOT_PAIRS))
    hot = materialise(opened.filter("hot").select("id", "component").distinct(), "hot")
    # pairs of two documents that are in some hot band are all left to the prefix filter
    some = opened.filter("not hot").select("key", "id", "component").join(search.heads, "id").join(hot.select("id", F.lit(True).alias("in_hot")), "id", "left")
    some = materialise(some.withColumn("in_hot", F.coalesce("in_hot", F.lit(False))), "remaining")
    x, y = some.alias("x"), some.alias("y")
    cold = ~(F.col("x.in_hot") & F.col("y.in_hot"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & cold & _may_be_similar("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if not hot.isEmpty():
        rest = rest.union(_prefix_pairs(search, hot))
    search.used.append(some)
    search.confirm(search.screened(rest))
    whole = members.select(F.col("rep").alias("a"), F.col("id").alias("b")).filter("a < b")
    edges = whole if search.links is None else whole.union(search.links)
    found = materialise(components(edges), "components")
    search.free()
    return sigs.select("id", "n").join(found, "id", "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
