"""The pipeline against a plain version of all its stages, and texts of many MB through every text operator."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from test_dedup_operators import plain_groups
from test_exact_mixing import BLANK, WORD, water_fill
from test_text_operators import ITEM, edited, plain_distance
from twinloom.llm import decontaminate, exact_dedup, html_text, language_id, near_dedup, sentence_spans, suffix_dedup, token_counts


def plain_mix(rows):
    """(doc_id, copies) by the contract: sizes, targets, rates, and the step of the draws that comes nearest to the target."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    totals = {}
    for i, _, s in rows:
        totals[s] = totals.get(s, 0) + size[i]
    targets, out = water_fill(totals), {}
    for s, total in totals.items():
        own, rate = [i for i, _, x in rows if x == s], targets[s] / total if total else 0.0
        draws = {i: int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in own}
        copies = [{i: math.floor(rate) + ((d + k / 64) % 1 < rate - math.floor(rate)) for i, d in draws.items()} for k in range(64)]
        out |= min(copies, key=lambda c: abs(sum(size[i] * n for i, n in c.items()) - targets[s]))
    return {i: n for i, n in out.items() if n}


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(400)]
    rows = []

    def put(text, source=None):
        rows.append((len(rows), text, r.choice(["en", "de"]), source or r.choice(["a", "b", "c", None]), len(text or "")))

    for _ in range(60):
        put(" ".join(r.choices(vocabulary, k=r.randint(20, 90))))
    for i in range(0, 30, 3):
        put("  ".join(rows[i][1].split()))  # an exact copy with more blanks
        words = rows[i + 1][1].split()
        words[len(words) // 2] = "changed"
        put(" ".join(words))  # a near copy, or not, as its length says
        put(" ".join(rows[i + 2][1].split()[:12] + edited(ITEM, i % 8, i) + rows[i + 2][1].split()[12:]))
    for text in (None, "", "123 ½", "..."):
        put(text, "a")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: t for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    groups = {}
    for i, t in kept.items():
        groups.setdefault(BLANK.sub("", t), []).append((-len(t), i))
    kept = {min(g)[1]: kept[min(g)[1]] for g in groups.values()}
    kept = {i: kept[i] for i, (_, _, stays) in plain_groups(sorted(kept.items())).items() if stays}
    before = len(kept)
    kept = {i: t for i, t in kept.items() if plain_distance(ITEM, decontaminate.words_of(t)) > int(len(ITEM) * decontaminate.MAX_EDITS)}
    assert 0 < before - len(kept) < 12
    want = plain_mix([(i, t, s) for i, t, _, s, _ in rows if i in kept])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "copy"]
    found = {}
    for row in got.collect():
        assert row.text == rows[row.doc_id][1] and row.copy == found.get(row.doc_id, 0) or row.copy < want[row.doc_id]
        found[row.doc_id] = found.get(row.doc_id, 0) + 1
    assert found == want


@pytest.fixture(scope="module")
def long_docs(spark):
    """One text of 8 MB, twice, beside short ones."""
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(5000)]
    words = r.choices(vocabulary, k=1_200_000)
    for i in range(0, len(words), 12):
        words[i] += "."
    words[700_000:700_000] = ITEM
    long = " ".join(words)
    assert len(long) > 7 << 20
    rows = [(1, long, "en"), (2, "short text of its own, with nothing in it", "en"), (3, long + " end", "en")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()


def test_long_texts_language_and_tokens(spark, long_docs):
    rows, docs = long_docs
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()} == {1: "en", 2: "en", 3: "en"}
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False)) for i, t, _ in rows}


def test_long_texts_dedup(spark, long_docs):
    rows, docs = long_docs
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(docs).collect()} == {1: (1, 1), 2: (2, 1), 3: (3, 1)}
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 1}
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in suffix_dedup.dedup_substrings(docs, kept_bytes=False).collect()}
    assert got[2] == (0, rows[1][1]) and got[3] == (len(rows[0][1]), " end") and got[1][0] == 0
    spans = {r.doc_id: r.text for r in sentence_spans.dedup_spans(docs, both_ends=True).collect()}
    assert spans[1] == rows[0][1] and spans[2] == rows[1][1] and len(spans[3]) < 200


def test_long_texts_leaks_and_pages(spark, long_docs):
    rows, docs = long_docs
    items = spark.createDataFrame([(9, " ".join(ITEM))], "item_id long, text string")
    assert sorted((r.doc_id, r.first_word, r.edits) for r in decontaminate.leaks(docs, items).collect()) == [(1, 700_000, 0), (3, 700_000, 0)]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<body><nav><a href=x>menu</a></nav><article><p>"), F.replace("text", F.lit(". "), F.lit(".</p><p>")), F.lit("</article>")).alias("html"))
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == {i: t.replace(". ", ".\n") for i, t, _ in rows}
