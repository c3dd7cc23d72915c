"""Language ID, token counts, HTML extraction, URL filter, decontamination."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import duck_rows
from twinloom.llm import decontaminate, html_text, language_id, queries, token_counts, url_filter

TEXTS = [None, "", " ", "Hello world, it's 3.5% of <|endoftext|> naïve\n\n  café", "<|endoftext|><|endoftext|>", "a" * 5000, "1234567 \t x\r\n", "日本語 テスト 🙂🙂", "  leading", "'s 're'LL don't", "\x00\x01", "\u2028 x", "x" + "\u0301" * 40]


# --- language ---------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out and r.lang is not None]
    assert len(rows) == docs.count() and len(out) > 100
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = [(i, "the cat and the dog" if i % 2 else "el gato y el perro", "en" if i % 2 else "es") for i in range(40)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 ...", "es"), (103, "GATO", None), (104, "cats", None), (105, "的", None), (None, "the dog", "en"), (106, "dog " * 50_000, None), (106, "dog " * 50_000, None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "es" and got[104][0] == "en" and got[106][0] == "en" and got[None][0] == "en"
    assert got[105][0] in ("en", "es")  # nothing known: the first language
    kept = {r.doc_id for r in language_id.keep_identified(docs).collect()}
    assert kept == set(range(40)) | {103, 104, 105, 106, None} and language_id.keep_identified(docs).columns == docs.columns
    none = docs.filter("false")
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def model_of(languages, tables):
    """tables: order -> {token: occurrences in each language}."""
    counts = {}
    for order in (0, *language_id.ORDERS):
        own = tables.get(order, {})
        places = [(i, j, n) for i, x in enumerate(own.values()) for j, n in enumerate(x) if n]
        counts[order] = list(own), *(np.array([p[k] for p in places], np.int64) for k in range(3))
    return language_id.Model(languages, counts)


def test_backoff_goes_from_words_to_shorter_grams():
    m = model_of(["en", "es"], {0: {"cat": (5, 0)}, 3: {"<ca": (9, 0), "gat": (0, 9)}, 1: {"z": (0, 3)}})
    cat, gato, zz, none = m.vectors(["cat", "gato", "zz", "qq"])
    assert cat[0] > cat[1] and gato[1] > gato[0] and zz[1] > zz[0] and list(none) == [0, 0]
    assert abs(cat).max() > abs(gato).max() > 0 and m.vectors([]).shape == (0, 2)


def test_small_cache_changes_nothing(monkeypatch):
    m = model_of(["en", "es"], {2: {"<a": (9, 1), "<b": (2, 5), "xx": (3, 3)}})
    texts = ["ab ac ad bx by", "axx bxx cxx", "b", "ab " * 50 + "by bz", "a b c d e f g h i j k"]
    want = [language_id.Predictor(m)(t) for t in texts]
    monkeypatch.setattr(language_id, "CACHE", 4)
    small = language_id.Predictor(m)
    assert [(a, round(x, 9)) for a, x in map(small, texts)] == [(a, round(x, 9)) for a, x in want]


def plain_language(train, texts):
    """The scores by their formulas, word by word: counts of all tokens, log posteriors, backoff, mean."""
    import math
    from collections import Counter

    languages = sorted({g for _, g in train})
    counts = {o: {g: Counter() for g in languages} for o in (0, *language_id.ORDERS)}
    cut = lambda t: ["".join(x) for x in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in t.lower()))]
    for t, g in train:
        for w in cut(t):
            counts[0][g][w] += 1
            for o in language_id.ORDERS:
                m = f"<{w}>" if o > 1 else w
                for i in range(len(m) - o + 1):
                    counts[o][g][m[i : i + o]] += 1
    kinds = {o: set().union(*counts[o].values()) for o in counts}

    def posterior(o, token):
        logs = [math.log((counts[o][g][token] + 0.5) / (sum(counts[o][g].values()) + 0.5 * (len(kinds[o]) + 1))) for g in languages]
        whole = math.log(sum(map(math.exp, logs)))
        return [x - whole for x in logs]

    def vector(w):
        if w in kinds[0]:
            return posterior(0, w)
        for lost, o in enumerate(language_id.ORDERS, 1):
            m = f"<{w}>" if o > 1 else w
            known = [g for i in range(len(m) - o + 1) if (g := m[i : i + o]) in kinds[o]]
            if known:
                rows = [posterior(o, g) for g in known]
                return [0.6**lost * sum(x) / len(rows) for x in zip(*rows)]
        return [0.0] * len(languages)

    out = []
    for t in texts:
        words = cut(t or "")
        if not words:
            out.append(("und", 0.0))
            continue
        total = [sum(x) for x in zip(*map(vector, words))]
        scaled = [x * min(30, len(words)) / len(words) for x in total]
        best = max(range(len(languages)), key=lambda i: (round(total[i], 6), -i))
        out.append((languages[best], math.exp(scaled[best] - math.log(sum(map(math.exp, scaled))))))
    return out


def test_predictions_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_001, "½ ² ③", "de"), (10_002, "naïve½straße x²y", "fr"), (10_003, "ΑΒΓ абв", None), (10_004, "zz " * 4000, "en"), (None, "le chat", "fr"), (1, "der Hund", "de"), (1, "der Hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("token", F.lit("clash"))
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.identify(docs, max_train_docs=10**9, max_train_rows=10**12).collect()]
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    train = [(t, g) for i, t, g in rows if i is not None and g is not None and t is not None and not held(i)]
    want = [(i, held(i), *p) for (i, t, _), p in zip(rows, plain_language(train, [t for _, t, _ in rows]), strict=True)]
    assert (10_001, False, "und", 0.0) in got or (10_001, True, "und", 0.0) in got
    order = lambda r: (str(r[0]), r[2], round(r[3], 4))
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-4)


def test_sample_is_bounded_with_many_languages(spark):
    docs = spark.createDataFrame([(i, f"wort{i % 50} von sprache{i % 50}", f"l{i % 50:02d}") for i in range(2000)], "doc_id long, text string, lang string")
    model = language_id.train(docs, max_train_rows=400)
    assert len(model.languages) == 50 and (model.rows(0, ["von"]) >= 0).all() and len(model.keys[0][0]) <= 3
    assert language_id.train(docs).rows(0, ["wort", "von", "sprache", "none"]).tolist()[3] == -1


# --- tokens -----------------------------------------------------------------


def reference_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts_equal_library(spark):
    path, tokenizer = reference_tokenizer()
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])] + [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, path).collect())
    want = sorted((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert got == want
    assert token_counts.token_counts(df.filter("false"), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_the_library(text):
    path, tokenizer = reference_tokenizer()
    global _pre
    if "_pre" not in globals():
        _pre = token_counts.PreTokens(path)
    found, special = _pre.frequencies(text)
    assert special + sum(n * k for n, k in zip(found.values(), _pre.pieces(list(found)), strict=True)) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_pieces_are_counted_once_for_all_blocks(spark, monkeypatch):
    path, tokenizer = reference_tokenizer()
    monkeypatch.setattr(token_counts, "BLOCK_ROWS", 3)
    texts = [None, "", "a b c d e f g h", "a b c", "x y z w v u t s r q " * 3, "word " * 200_000, "<|endoftext|>", *(f"own{i} shared " * (i % 4) for i in range(40))]
    rows = spark.createDataFrame([(i // 2 if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows, path).collect()))
    assert got == sorted((str(i // 2 if i else None), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_files(spark, name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(name)
    count = token_counts.text_counter(path)
    assert count("Hello big world") > 2 and not (name.endswith(".model") and token_counts.by_pre_tokens(path))
    rows = spark.createDataFrame([(1, "Hello big world"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(rows, path).collect()) == [(1, count("Hello big world")), (2, 0), (3, 0)]


# --- html -------------------------------------------------------------------

PAGES = [
    ("<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>One  <b>bold</b>\n text.<p>Two &amp; &lt;three&gt;</article><aside>side</aside><footer>foot</footer></body></html>", "Head\nOne bold text.\nTwo & <three>"),
    ("<body><div class='top-menu'><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div><div id=content><p>" + "Long text here. " * 20 + "</p><p>" + "More of the text. " * 20 + "</p></div><div class='sidebar'><p>" + "noise " * 30 + "</p></div><section id='comments'><p>" + "reader says " * 60 + "</p></section></body>", " ".join(["Long text here."] * 20) + "\n" + " ".join(["More of the text."] * 20)),
    ("<body><script>var a='<p>x</p>';</script><style>p{}</style><!-- <p>no</p> --><article><p>kept<br>line</p><form>Name <input></form><div class='cookie-notice'>cookies</div><div class='ad'>buy</div><p>end", "kept line\nend"),
    ("plain text only", "plain text only"),
    ("<p>a<p>b<li>c<td>d", "a\nb\nc\nd"),
    ("<article class='post has-sidebar'><header><h1>Title</h1></header><p>Body &#233;&eacute;</p></article>", "Title\nBody éé"),
    ("<main><section><h2>A</h2><p>" + "x y " * 40 + "</p></section><section><h2>B</h2><p>" + "z w " * 40 + "</p></section></main>", "A\n" + " ".join(["x y"] * 40) + "\nB\n" + " ".join(["z w"] * 40)),
    ("<article><p>one</p><article class='comment'><p>" + "me too " * 50 + "</p></article></article>", "one"),
    ("<article><p>5 < 6 and <3</p></article", "5 < 6 and <3"),
    (None, ""), ("", ""), ("<html></html>", ""), ("<nav>only menu</nav>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_extract(page, text):
    assert html_text.extract(page) == text


def test_text_beside_the_core_stays():
    line = "Plain words of the article stand here without any paragraph around them, all along the page's way. "
    quote = "<blockquote><p>" + "quoted words " * 13 + "</p><p>" + "cited words " * 14 + "</p></blockquote>"
    own = [line.strip()] * 20
    cited = [" ".join(["quoted words"] * 13), " ".join(["cited words"] * 14)]
    page = f"<body><div>{'<br>'.join(own[:10])}{quote}{'<br>'.join(own[10:])}</div></body>"
    assert html_text.extract(page) == "\n".join([" ".join(own[:10]), *cited, " ".join(own[10:])])
    page = f"<body>Direct <i>text</i> in the body.<div>{quote}</div><a href=x>link</a>&nbsp;| <a href=y>link</a></body>"
    assert html_text.extract(page) == "\n".join(["Direct text in the body.", *cited])


SENTENCE = "This is a sentence of the article that goes on for a while and says things."
PARA = f"<p>{' '.join([SENTENCE] * 3)}</p>"
THREE = " ".join([SENTENCE] * 3)
LINKS = "<a href=x>one</a> <a href=y>two</a>"


@pytest.mark.parametrize("page,text", [
    ("<body>Bare opening<div><p>one two three</p><p>four five</p></div>closing</body>", ["Bare opening", "one two three", "four five", "closing"]),
    (f"<body><article>{PARA}<section class=legal>{PARA}</section><p class=share>{SENTENCE} {SENTENCE}</p><div class=share>{LINKS}</div>{PARA}</article></body>", [THREE, THREE, f"{SENTENCE} {SENTENCE}", THREE]),
    (f"<body><h1>Title</h1><div>{PARA}{PARA}</div><div class=share>Share it</div><div class=copyright>(c) 2020</div></body>", ["Title", THREE, THREE]),
    (f"<body><div class=legal>{PARA}{PARA}{PARA}</div><div class=related>{PARA}</div></body>", [THREE] * 3),
    (f"<body><div class=post><h2 class=section-header>Head</h2>{PARA}<h3>sub</h3>{PARA}</div><div class=comments>{PARA}{PARA}{PARA}{PARA}</div></body>", ["Head", THREE, "sub", THREE]),
    (f"<body><main><article>{PARA}{PARA}</article><ul class=menu><li>{LINKS}</ul></main><div class=cookie-bar>{PARA}</div></body>", [THREE, THREE]),
])
def test_names_need_density(page, text):
    assert html_text.extract(page) == "\n".join(text)


def plain_density(body):
    """The composite density by its formula, every element counted by itself; the core, and the least density on its path."""
    import math

    def walk(node, parents=()):
        yield node, parents
        for x in node.children:
            if not isinstance(x, str):
                yield from walk(x, (*parents, node))

    def counts(node):
        chars = linked = tags = link_tags = 0

        def go(x, in_link):
            nonlocal chars, linked, tags, link_tags
            for y in x.children:
                if isinstance(y, str):
                    k = len(y.replace(" ", "").replace("\n", ""))
                    chars += k
                    linked += k * in_link
                else:
                    tags += 1
                    link_tags += y.tag == "a"
                    go(y, in_link or y.tag == "a")

        go(node, node.tag == "a")
        return chars, linked, tags, link_tags + (node.tag == "a")

    c, lc, _, _ = counts(body)
    share = lc / max(1, c)
    density = {}
    for node, _ in walk(body):
        c, lc, t, lt = counts(node)
        if c == 0:
            density[id(node)] = 0
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        density[id(node)] = c / max(1, t) * max(0, math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))))
    sums = [(sum(density[id(x)] for x in n.children if not isinstance(x, str) and x.tag not in html_text.INLINE), n, up) for n, up in walk(body) if n.tag not in html_text.INLINE and counts(n)[0]]
    if not sums:
        return None, density
    best = max(s for s, _, _ in sums)
    return {id(n): min(density[id(x)] for x in (n, *up)) for s, n, up in sums if abs(s - best) < 1e-9 * (1 + best)}, density


@settings(max_examples=120, deadline=None)
@given(st.recursive(st.text("ab .", min_size=1, max_size=40), lambda inner: st.tuples(st.sampled_from(["div", "p", "section", "a", "b", "ul", "li"]), st.lists(inner, max_size=4)), max_leaves=25))
def test_core_and_threshold_equal_plain_density(tree):
    def page(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(page, x[1]))}</{x[0]}>"

    root = html_text.parse(f"<body>{page(tree)}</body>")
    order = html_text._pruned(root)
    body = next(x for x in order if x.tag == "body")
    order = html_text._below(body)
    html_text._measure(order, body)
    core, path = html_text._core(order, body)
    want, density = plain_density(body)
    assert all(x.density == pytest.approx(density[id(x)]) for x in order)
    if core is None:
        assert want is None
    else:
        assert min(x.density for x in path) == pytest.approx(want[id(core)])


def test_deep_and_broken_markup_is_linear():
    assert "x" in html_text.extract("<div>" * 5000 + "x")
    assert html_text.extract("<div class=share>" * 20_000 + "x") in ("", "x")
    assert html_text.extract("<p>" + "<b " * 20000) is not None
    assert html_text.extract("<" * 50000 + "a" * 10) is not None
    assert html_text.extract("<p a='" + "x" * 100000) is not None


def test_pages_equal_their_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.page_id: r for r in queries.op5_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    found = 0
    for p in pages:
        i = int(re.search(r"/(\d+)", p.url.split("://", 1)[1])[1])
        if i in docs and "&" not in docs[i]:
            want = [x for x in (" ".join(x.split()) for x in docs[i].split("\n")) if x]
            assert got[p.page_id].text.split("\n")[1:] == want and got[p.page_id].n_chars == len(got[p.page_id].text)
            found += 1
    assert found > 10


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (None, "u", "<p>" + "w " * 200_000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.main_text(df).collect()
    assert len(got) == 4 and {r.text for r in got if r.page_id == 2} == {"x"} and [r.n_chars for r in got if r.page_id is None] == [399_999]
    assert html_text.main_text(df.filter("false")).count() == 0


# --- urls -------------------------------------------------------------------

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "bare.io": "block"}


def plain_rule(host, path):
    best = None
    for rule in RULES:
        name, slash, rest = rule.partition("/")
        if host and (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or (len(rule), rule) > (len(best), best)):
            best = rule
    return best


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [None, "", "x.net/en/", "http://a.NET/x", "http://anet/x", "https://www.Example.net/en/1?q=/de/#f", "https://example.net/EN/1", "http://example.com/de/", "http://sub.example.com/de", "ftp://a.org/fr/x", "http://a.net", "http://a.net?x=/y", "http://É.net/é", "a://b://c.net/d", "http://bare.io", "http://x.bare.io?q", "http://" + "a." * 300 + "net/" + "x" * 5000, "http:///path", "http://a.net/\nnew"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    labels = spark.createDataFrame([], "url_id long, bad boolean")
    got = url_filter.judge(pages, labels, RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = plain_parts(URLS[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, RULES.get(rule, "allow"))
    assert url_filter.judge(pages.filter("false"), labels, RULES).count() == 0


def test_mined_rules(spark):
    urls = [(i, f"http://{'bad-win' if i % 3 == 0 else 'good'}.example.io/{'x' if i % 2 else 'y'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)] + [(None, True), (5, None)], "url_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, labels, {}).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i in range(300) if i % 3 == 0}
    rows = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"), F.col("page_id").alias("i"))
    rows = rows.select(url_filter.tokens_of(F.col("host"), F.col("path")).alias("tokens"), (F.col("i") % 3 == 0).alias("bad"))
    rules, members = (x.collect() for x in url_filter.mine(rows))
    baskets = [(set(r.tokens), r.bad) for r in rows.collect()]
    tokens = {}
    for r in members:
        tokens.setdefault(r.item, set()).add(r.token)
    assert rules
    for r in rules:  # counted by hand; any token of an item stands for it
        hit = [bad for own, bad in baskets if all(tokens[i] & own for i in r["items"])]
        assert all(tokens[i] <= own or not tokens[i] & own for i in r["items"] for own, _ in baskets)
        assert r.support == sum(hit) and r.confidence == pytest.approx(sum(hit) / len(hit)) and r.confidence >= 0.5
    assert all(not (set(a["items"]) < set(b["items"]) and a.confidence >= b.confidence) for a in rules for b in rules)


def plain_verdicts(urls, labels, rules, min_support=url_filter.MIN_SUPPORT):
    """Every set of up to three tokens of a bad url, counted by hand."""
    from itertools import combinations

    parts = {i: plain_parts(u) for i, u in urls}
    tokens = {}
    for i, (host, path) in parts.items():
        words = re.split(r"[^\w#]+|_", re.sub(r"[0-9]+", "#", "".join(c.lower() if "A" <= c <= "Z" else c for c in path)))
        tokens[i] = {f"h:{x}" for x in re.split(r"[.\-]", host) if x} | {f"p:{x}" for x in words if x} | ({f"host:{host}"} if host else set())
    owner = {i: int(m[0]) if (m := re.search(r"[0-9]+", parts[i][1])) and int(m[0]) < 2**63 else None for i in parts}
    baskets = [(tokens[i], labels[owner[i]]) for i in parts if owner[i] in labels and tokens[i]]
    least = max(url_filter.MIN_URLS, -(-len(baskets) * min_support // 1))
    n, hits = {}, {}
    for own, bad in baskets:
        for k in (1, 2, 3):
            for c in combinations(sorted(own), k):
                n[c] = n.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + bad
    fire = {c for c in n if hits[c] >= least and hits[c] >= 0.5 * n[c]}
    out = {}
    for i, (host, path) in parts.items():
        mined = any(c in fire for k in (1, 2, 3) for c in combinations(sorted(tokens[i]), k))
        rule = plain_rule(host, path) if rules else None
        out[i] = RULES[rule] if rule else "block" if mined else "allow"
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 50, 400])
def test_few_labels_and_long_urls(spark, n):
    """Labels on few urls of up to 40 tokens: neither a crash nor a rule lost."""
    import random

    r = random.Random(n)
    words = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    urls = [(i, f"http://{r.choice(['a', 'b', 'win'])}.s{r.randrange(3)}.io/{i}/" + "/".join(r.sample(words, r.choice([2, 6, 20, 40]) if i % 40 < 2 else r.choice([1, 2, 3])))) for i in range(n + 40)]
    urls += [(i + 1000, urls[0][1] + "/more") for i in range(8)]
    labels = {i: i % 3 == 0 or "win" in u for i, u in urls[:n]}
    pages = spark.createDataFrame(urls, "page_id long, url string")
    facts = spark.createDataFrame(list(labels.items()), "url_id long, bad boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, facts, {}).collect()}
    assert got == plain_verdicts(urls, labels, {})
    assert n < 50 or "block" in got.values()


def test_verdicts_on_pages_equal_brute_force(spark, sf):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    labels = {r.doc_id: r.toxic == 1 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.page_id: r.verdict for r in queries.op1_url_filter(spark, sf).collect()}
    want = {i: v for i, v in plain_verdicts(pages, labels, {}).items()}
    rules = queries.URL_RULES

    def verdict(url, mined):
        host, path = plain_parts(url)
        fits = [x for x in rules if host and (host == x.partition("/")[0] or host.endswith("." + x.partition("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        return rules[max(fits, key=len)] if fits else mined

    assert got == {i: verdict(u, want[i]) for i, u in pages}


def test_host_and_path_on_pages(spark, sf):
    got = queries.op1_url_filter(spark, sf).select("page_id", "host", "path", "rule").collect()
    sql = r"""select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), '') as path from pages"""
    _, want = duck_rows(sql, sf)
    assert sorted((r.host, r.page_id, r.path) for r in got) == sorted(want)


# --- decontamination --------------------------------------------------------

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew potent magic tea in an old stone tower by night".split()


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(words, edits, seed):
    import random

    r, out = random.Random(seed), list(words)
    for _ in range(edits):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = f"zz{r.randrange(99)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"yy{r.randrange(99)}")
    return out


def test_leaks_equal_brute_force(spark):
    pad = [f"w{i}" for i in range(300)]
    items = [(1, " ".join(ITEM)), (2, "alpha beta gamma"), (3, None), (4, "..."), (5, " ".join(pad[:40][::-1])), (6, " ".join(ITEM))]
    rows = [(i, " ".join(pad[: i % 50] + edited(ITEM, i % 8, i) + pad[50 : 50 + i % 30])) for i in range(160)]
    rows += [(1000, "Alpha, beta... GAMMA!"), (1001, "alpha beta gamma delta"), (1002, None), (1003, ""), (1004, "the quick brown fox " * 30), (1005, " ".join(pad * 60 + ITEM)), (1005, "x"), (None, " ".join(ITEM)), (1006, "before alpha beta gamma"), (1007, "alpha beta delta gamma"), (1008, "Lone word!"), (1009, "a lone word")]
    items += [(7, "lone word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit("clash"))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, text in rows:
        words = decontaminate.words_of(text)
        for key, item in items:
            own = decontaminate.words_of(item)
            if len(own) >= decontaminate.MIN_WORDS:
                d = plain_distance(own, words)
                if d <= int(len(own) * decontaminate.MAX_EDITS):
                    want[i, key] = d
            elif own and (own == words or len(own) >= decontaminate.MIN_INSIDE and any(words[a : a + len(own)] == own for a in range(len(words)))):
                want[i, key] = 0
    assert got == want
    assert len([1 for i, k in want if k == 1]) > 100 and {(1000, 2), (1001, 2), (1006, 2), (1008, 7)} <= want.keys() and not {(1007, 2), (1009, 7)} & want.keys()


def test_passages_begin_and_end_where_they_say(spark):
    pad = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(pad + ITEM + pad))], "doc_id long, text string")
    r = decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")).first()
    assert (r.first_word, r.n_words, r.edits, r.item_words) == (30, len(ITEM), 0, len(ITEM))


def test_items_in_blocks_and_clean_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, " ".join(f"k{i}x{j}" for j in range(10))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"k{i}x{j}" for j in range(10)), i) for i in range(7)] + [(None, "a", 0)], "doc_id long, text string, _leak2 long")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(i, i) for i in range(5)]
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, None}
    own = spark.createDataFrame([(1, "clean"), (1, " ".join(f"k1x{j}" for j in range(10))), (None, " ".join(f"k2x{j}" for j in range(10))), (None, "clean")], "doc_id long, text string").withColumn("_node", F.lit("n"))
    assert sorted((str(r.doc_id), r.text, r._node) for r in decontaminate.keep_clean(own, items).collect()) == [("1", "clean", "n"), ("None", "clean", "n")]
    assert decontaminate.leaks(docs, items.filter("false")).count() == 0 and decontaminate.leaks(docs.filter("false"), items).count() == 0


@pytest.mark.parametrize("n", [30, 100, 200, 400])
def test_long_items_are_found_at_the_largest_distance(n):
    items = decontaminate.Items([(i, " ".join(f"i{i}x{j}" for j in range(n))) for i in range(20)], decontaminate.MAX_EDITS)
    import pyarrow as pa

    texts = [" ".join(["pad"] * i + [f"new{j}" if j % 4 == 3 else f"i{i}x{j}" for j in range(n)] + ["pad"] * 9) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], names=["id", "text"])
    assert sorted((i, item, edits) for i, item, _, _, edits in decontaminate._matches(items, batch)) == [(i, i, n // 4) for i in range(20)]
