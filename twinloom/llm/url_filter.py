"""URL filter: a list of host/path rules first, then association rules mined from labels by Spark's FP-growth.

List rules are strings host[/path]: a rule fits its host and all subdomains if the url's path starts with the rule's path; the
longest fitting rule gives the verdict. They are found by lookup, not by trying every rule: a url yields its host suffixes
and those are looked up in a map of the rules.

Mined rules: the distinct token sets of labelled urls are transactions. A rule {tokens} -> block has at most MAX_TOKENS tokens, and
at least MIN_URLS labelled bad urls, and `min_support` of all labelled ones, must hold it; its confidence is the share of bad ones among all that
hold it. Numbers in a url are one token, '#', so that they don't make every url unlike every other.

1. Tokens that stand in too few bad urls are in no rule. Tokens that stand in the very same urls are one item, and any of them stands for it.
2. FP-growth mines item sets among the bad urls. The sets of a url are exponential in its items, so a url of many items is dealt
   into baskets: its items are cut into groups of GROUP, and every MAX_TOKENS groups together are one basket, so that all sets of up
   to MAX_TOKENS items are in some basket, and no basket has more than GROUP * MAX_TOKENS items.
3. The sets found are candidates; their urls are counted anew over all labelled urls, which gives support and confidence exactly.
   A rule that holds more items than another without a higher confidence is dropped.
4. Matching goes through an inverted index: a rule stands under its rarest item, urls look up their items there, and a rule
   fires when the url holds all the others as well.

Bounds: nothing is cut off. Rules, items and transactions are tables; Spark broadcasts the index where its measured size is small and
shuffles it otherwise (hot items are split by adaptive execution). Urls share few token sets, so the sets are matched once each.

Edge cases: null urls and urls without '://' have empty host and path, match no rule and are allowed; host and path of very
long urls are whole; equal rows are each judged; rows that share an identifier are each judged by their own url; with fewer bad
urls than MIN_URLS no rule is mined; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, salt_mask, salt_of, salts_in

MIN_SUPPORT = 0.002
MIN_URLS = 5
MIN_CONFIDENCE = 0.5
MAX_TOKENS = 3
GROUP = 4


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives ''."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def listed(rows: DataFrame, rules: dict[str, str], host: str = "host", path: str = "path") -> DataFrame:
    """Adds `rule` (the longest fitting one, else null) and `listed` (its verdict). rules: 'host/path' -> verdict."""
    if not rules:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("listed", F.lit(None).cast("string"))
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((rule, slash + rest))
    labels = F.split(host, r"\.")
    suffixes = F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    entry = "array<struct<rule:string,path:string>>"
    index = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("path")) for r, p in own]).cast(entry))])
    known = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    found = F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(index, s)), lambda s: index[s]))
    fits = F.filter(found, lambda r: F.col(path).startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"))))["rule"]
    return rows.withColumn("rule", best).withColumn("listed", known[F.col("rule")])


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path (numbers as '#'), and the whole host."""
    labels = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace(lower_ascii(path), r"\d+", "#"), r"[^\p{L}\p{N}#]+"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(words, lambda x: F.concat(F.lit("p:"), x)), F.when(host != "", F.array(F.concat(F.lit("host:"), host))).otherwise(F.array().cast("array<string>"))))


def _set_id(tokens: str = "tokens") -> Column:
    return F.xxhash64(F.array_join(F.array_sort(tokens), "\x1f"))


def _baskets(owned: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """Transactions of the bad urls' items: each set of items as often as it is bad, up to `least` times, which is enough for its
    subsets to be frequent; sets of many items in parts (see the module)."""
    rows = owned.filter("n_bad > 0").select("items", F.explode(F.array_repeat(F.lit(0), F.least("n_bad", F.lit(least)).cast("int"))).alias("_"))
    groups = F.ceil(F.size("items") / GROUP).cast("int")
    small = rows.filter(groups <= max_tokens).select("items")
    wide = rows.filter(groups > max_tokens).withColumn("last", F.lit(-1)).withColumn("own", F.array().cast("array<string>"))
    for i in range(max_tokens):
        rest = max_tokens - 1 - i
        wide = wide.withColumn("g", F.explode(F.sequence(F.col("last") + 1, groups - 1 - rest)))
        wide = wide.select("items", F.col("g").alias("last"), F.concat("own", F.slice("items", F.col("g") * GROUP + 1, GROUP)).alias("own"))
    return small.unionByName(wide.select(F.col("own").alias("items")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS, max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """labelled: (tokens, bad), a row a url. Rules (items, first, confidence, support) and the items' tokens (token, item), both
    written. An item's name begins with the number of its urls, so that the first of a sorted set is the rarest."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    sets = labelled.filter(F.size("tokens") > 0).groupBy(_set_id().alias("set_id")).agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    sets = materialise(sets, "transactions")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("bad")).first()
    least = max(1, min_urls, math.ceil(min_support * total["n"]))
    if total["bad"] < least:
        return spark.createDataFrame([], "items array<string>, first string, confidence double, support long"), spark.createDataFrame([], "token string, item string")
    marks = [F.bit_xor(F.xxhash64("set_id", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    counted = sets.select("set_id", "n", "n_bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"), *marks).filter(F.col("n_bad") >= least)
    counted = materialise(counted, "tokens")
    same = ["n", "n_bad", "mark0", "mark1"]  # the same urls, by two fingerprints of the set of them
    names = counted.groupBy(*same).agg(F.min("token").alias("item")).withColumn("item", F.concat(F.lpad(F.col("n").cast("string"), 18, "0"), F.lit(":"), "item"))
    members = materialise(counted.join(names, same).select("token", "item"), "items")
    owned = materialise(_items_of(sets, members).join(sets.select("set_id", "n", "n_bad"), "set_id"), "owned")
    baskets = materialise(_baskets(owned, least, max_tokens), "baskets")
    n_baskets = baskets.count()
    if n_baskets < least:
        return spark.createDataFrame([], "items array<string>, first string, confidence double, support long"), members
    mined = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_baskets).fit(baskets).freqItemsets
    found = materialise(mined.select(F.array_sort("items").alias("rule")).filter(F.size("rule") <= max_tokens).withColumn("first", F.element_at("rule", 1)), "candidates")
    held = owned.select("n", "n_bad", "items", F.explode("items").alias("first")).join(found, "first").filter(F.size(F.array_except("rule", "items")) == 0)
    rules = held.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("hits")).filter((F.col("hits") >= least) & (F.col("hits") >= F.col("n") * min_confidence))
    rules = materialise(rules.select(F.col("rule").alias("items"), F.element_at("rule", 1).alias("first"), (F.col("hits") / F.col("n")).alias("confidence"), F.col("hits").alias("support")), "rules")
    # a rule goes if a proper subset of its items is a rule of no lower confidence
    sub = rules.select(F.col("items").alias("sub"), "first", F.col("confidence").alias("sub_confidence"))
    implied = (
        rules.select("items", "confidence", F.explode("items").alias("first")).join(sub, "first")
        .filter((F.size("sub") < F.size("items")) & (F.col("sub_confidence") >= F.col("confidence")) & (F.size(F.array_except("sub", "items")) == 0)).select("items").distinct()
    )
    return materialise(rules.join(implied, "items", "left_anti"), "pruned"), members


def _items_of(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(set_id, items) of the token sets that hold any item."""
    return sets.select("set_id", F.explode("tokens").alias("token")).join(members, "token").groupBy("set_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", **how) -> DataFrame:
    """One row per page: key, host, path, rule, verdict ('allow' or 'block'), confidence of the mined rule that fired (else null).

    labels: (url_id, bad), where url_id is the number in the path of the urls that the label belongs to.
    """
    rows = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url")).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = listed(rows.withColumn("tokens", tokens_of(F.col("host"), F.col("path"))), rules)
    number = F.expr(r"try_cast(regexp_extract(path, '(\\d+)', 1) as bigint)")
    facts = labels.select(F.col("url_id").cast("long").alias("url_id"), F.col("bad").cast("boolean").alias("bad")).filter("url_id is not null").groupBy("url_id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    mined, members = mine(rows.select("tokens", number.alias("url_id")).join(facts, "url_id").select("tokens", "bad"), **how)
    # a set of tokens that very many urls have is joined back in parts
    rows = rows.withColumn("set_id", _set_id()).withColumn("salt", salt_of("id"))
    sets = rows.groupBy("set_id").agg(F.first("tokens").alias("tokens"), salt_mask().alias("mask"))
    needed = members.join(mined.select(F.explode("items").alias("item")).distinct(), "item", "left_semi")
    held = _items_of(sets, needed)
    fired = held.select("set_id", "items", F.explode("items").alias("first")).join(mined.select(F.col("items").alias("needs"), "first", "confidence"), "first")
    fired = fired.filter(F.size(F.array_except("needs", "items")) == 0).groupBy("set_id").agg(F.max("confidence").alias("confidence"))
    fired = fired.join(sets.select("set_id", "mask"), "set_id").select("set_id", "confidence", F.explode(salts_in("mask")).alias("salt"))
    out = rows.join(fired, ["set_id", "salt"], "left")
    verdict = F.coalesce("listed", F.when(F.col("confidence").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), "confidence")
