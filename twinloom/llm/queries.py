"""Queries of the training-data operators: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, language_id, mixing, near_dedup, sentence_spans, suffix_dedup, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url_id"), (F.col("toxic") == 1).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query(
    r"""
    with sized as (
      select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
    ), sources as (
      select source, cast(sum(size) as double) as source_size,
             case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight
      from sized group by source
    ), ranked as (
      select *, source_size * 2.0 as cap, sum(source_size) over () * 1.5 as total,
             coalesce(sum(source_size * 2.0) over before, 0.0) as full_before, sum(weight) over () - coalesce(sum(weight) over before, 0.0) as open_weight
      from sources window before as (order by source_size * 2.0 / weight, source is null, source rows between unbounded preceding and 1 preceding)
    ), levels as (
      select *, max(case when (total - full_before) / open_weight <= cap / weight then (total - full_before) / open_weight end) over () as level from ranked
    ), targets as (
      select source, source_size, case when level is null then cap else least(cap, level * weight) end as target from levels
    ), drawn as (
      select s.doc_id, s.size, t.source, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
             ('0x' || substr(md5('mix-1:' || coalesce(cast(s.doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0::double as draw
      from sized s join targets t on s.source is not distinct from t.source
    ), misses as (
      select source, k, abs(floor(any_value(rate)) * any_value(source_size) + sum(case when (draw + k / 64.0::double) - floor(draw + k / 64.0::double) < rate - floor(rate) then size else 0 end) - any_value(target)) as miss
      from drawn, range(64) as r(k) group by source, k
    ), phases as (select source, first(k order by miss, k) as k from misses group by source)
    select d.doc_id, d.size, cast(d.source_size as bigint) as source_size, d.target,
           d.size * cast(floor(d.rate) + case when (draw + k / 64.0::double) - floor(draw + k / 64.0::double) < d.rate - floor(d.rate) then 1 else 0 end as bigint) as taken
    from drawn d join phases p on d.source is not distinct from p.source
    """
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup_spans(table(spark, sf_dir, "documents"), both_ends=True)


@query()
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query(
    r"""
    with rows as (
      select doc_id, cast(length(coalesce(text, '')) as bigint) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents
    ), ranked as (
      select *, first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id, count(*) over (partition by text_sha256) as group_size from rows
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
    """
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    r"""
    with docs as (select doc_id, strlen(coalesce(text, '')) as n, hex(encode(coalesce(text, ''))) as h from documents),
    windows as (select doc_id, i, substr(h, 2 * i + 1, 100) as w from docs, lateral unnest(range(0, greatest(0, n - 49))) as t(i)),
    firsts as (select w, min(doc_id) as low from windows group by w having min(doc_id) < max(doc_id)),
    hits as (select doc_id, i from windows join firsts using (w) where doc_id > low),
    marked as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as opens from hits),
    numbered as (select *, sum(opens) over (partition by doc_id order by i) as k from marked),
    spans as (select doc_id, k, min(i) as a, max(i) + 50 as b from numbered group by all),
    pieces as (select doc_id, k, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
    cut as (select p.doc_id, sum(b - a) as removed, count(*) as spans, max(b - a) as longest, count(*) filter (where b - a >= 250) as passages, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from pieces p join docs d on d.doc_id = p.doc_id group by p.doc_id)
    select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, coalesce(longest, 0) as longest_removed, coalesce(passages, 0) as n_passages, sha256(unhex(coalesce(kept, h))) as kept_sha256,
      decode(unhex(regexp_replace(coalesce(kept, h), '([0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]|ED[89][0-9A-F][89AB][0-9A-F]|E[1-9ABCEF](?:[89AB][0-9A-F]){2}|F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}|F[1-3](?:[89AB][0-9A-F]){3}|F48[0-9A-F](?:[89AB][0-9A-F]){2})|..', '\1', 'g'))) as kept_text
    from docs left join cut using (doc_id)
    """
)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), kept_bytes=False)


@query(
    r"""
    with recursive words as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
    ), sets as (
      select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s
      from words, lateral unnest(range(1, greatest(2, len(w) - 3))) as r(i) where len(w) > 0
    ), sizes as (select doc_id, count(*) as n from sets group by doc_id
    ), pairs as (
      select a.doc_id as a, b.doc_id as b, count(*) as common from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all
    ), links as (
      select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)
    ), edges as (select a, b from links union select b, a from links
    ), reach as (select a as doc_id, a as other from edges union select r.doc_id, e.b from reach r join edges e on e.a = r.other
    ), low as (select doc_id, min(other) as component_id from reach group by doc_id)
    select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id, coalesce(l.component_id, d.doc_id) = d.doc_id as kept
    from documents d left join sizes s using (doc_id) left join low l using (doc_id)
    """
)
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


@query()
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
