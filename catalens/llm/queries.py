"""The operators as registered queries over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import decontamination, document_fingerprints, filter_audit, language_id, mixing, pii, simhash_dedup, suffix_dedup, token_alignment, token_counts, token_output, topk_search, url_filter
from catalens.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

RULES = (
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
)
# Words of junk trades.  A page is on the list of blocked URLs if its site is
# named for one: a label of the host is several words with hyphens, one of them such a word.
JUNK_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    words = "|".join(JUNK_WORDS)
    named_for_junk = url_filter.host_of(url).rlike(rf"(^|[.-])({words})-|-({words})([.-]|$)")
    junk = pages.where(named_for_junk).select(url_filter.canonical(url).alias("canonical"))
    return url_filter.judge(pages, junk, RULES)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))

    def covered(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])

    return out.select(
        "doc_id",
        "n_bytes",
        covered("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # A cut within a character leaves bytes that are no text; they show as U+FFFD.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"),
        # Passages of over 50 words that another document has too; under 400 bytes they are kept.
        F.size("passages").cast("long").alias("n_passages"),
        covered("passages").alias("passage_bytes"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(spans) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = pii.joined(F.filter(spans, lambda s: s["base"]))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    held_out = F.coalesce(fold == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk_search.search(docs, docs.where("doc_id % 50 = 0"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints.compared(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        document_fingerprints.as_hex(F.col("print")).alias("fingerprint"),
        document_fingerprints.as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY)
    groups = F.col("groups")
    digest = F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256)).alias("groups_sha256")
    return token_alignment.aligned(table(spark, sf_dir, "documents"), *paths).select("doc_id", *token_alignment.COUNTS, digest)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_suffix_dedup,
        op3_source_mix,
        op4_decontamination,
        op5_pii,
        op6_simhash_groups,
        op7_token_counts,
        op8_language_id,
        op9_token_files,
        op10_topk_search,
        op11_filter_audit,
        op12_document_fingerprints,
        op13_token_alignment,
    )
}

ORACLE: dict[str, str] = {
    "op1_url_filter": r"""
with parts as (
    select page_id, url,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
        list_sort([p for p in string_split(regexp_replace(
            regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1),
            '(^|&)(utm_[^&=]*|ref)(=[^&]*)?', '', 'g'), '&') if p <> '']) as pairs
    from pages),
named as (
    select page_id, host, path, case when host <> '' then
        regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
        || case when len(pairs) > 0 then '?' || array_to_string(pairs, '&') else '' end end as canonical
    from parts),
flagged as (
    select *, canonical is not null and canonical in (
        select canonical from named
        where canonical is not null and len(list_filter(string_split(host, '.'), lambda label:
            contains(label, '-') and list_has_any(string_split(label, '-'),
                ['adult', 'ads', 'bets', 'casino', 'pills', 'spam']))) > 0
    ) as listed
    from named),
ruled as (
    select *, case
        when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
        when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
        when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
        when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
    from flagged)
select page_id, host, path, rule, canonical, listed, case
    when rule in ('example.net/en/', 'org/fr/') then 'allow'
    when rule in ('example.com/de/', 'net/') then 'block'
    when listed then 'block' else 'allow' end as verdict
from ruled""",
    "op3_source_mix": r"""
with measured as (
    select doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint
            / 4503599627370496.0::double as draw
    from documents),
sizes as (select source, sum(size)::bigint as source_size from measured group by source),
weighted as (
    select *, source_size * 2.0::double as cap,
        [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
    from sizes),
levels as (
    select *, (sum(source_size::double) over () * 1.5::double
            - coalesce(sum(cap) over (order by cap / weight, source nulls last
                rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, source nulls last
            rows between current row and unbounded following) as own
    from weighted),
targets as (select source, source_size, least(cap, max(own) over () * weight) as target from levels),
rates as (
    select m.doc_id, m.size, m.draw, t.source_size, t.target,
        case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
    from measured m join targets t on m.source is not distinct from t.source)
select doc_id, size, source_size, target,
    (size * (floor(rate)::bigint + (draw < rate - floor(rate))::bigint))::bigint as taken
from rates""",
    "op11_filter_audit": r"""
with measured as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
failing as (
    select doc_id, part,
        len(words) < 100 as a,
        100 * len(list_distinct(words)) < 80 * len(words) as b,
        100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) as c,
        regexp_matches(t, '[#$%&*|]') as d,
        coalesce(doc_id > min(doc_id) over (partition by t), false) as e
    from measured),
marked as (
    select f.part, [a, b, c, d, e] as fails, coalesce(l.good, false) as good, coalesce(l.bad, false) as bad
    from failing f left join (
        select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as bad from labels group by doc_id) l
    on f.doc_id = l.doc_id),
-- Documents that fail the same filters fare the same in every order.
alike as (select part, fails, good, bad, count(*) as n from marked group by all),
letters as (select unnest([1, 2, 3, 4, 5]) as i),
orders as (
    select [p.i, q.i, r.i, s.i, u.i] as o,
        chr((64 + p.i)::int) || chr((64 + q.i)::int) || chr((64 + r.i)::int) || chr((64 + s.i)::int) || chr((64 + u.i)::int) as filter_order
    from letters p, letters q, letters r, letters s, letters u
    where len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps as (select filter_order, o, i as step, o[i] as own, o[1:i - 1] as earlier from orders, letters),
run as (
    select part, filter_order, step, own, n, good, bad, fails[own] as fails_here,
        len(list_filter(earlier, lambda f: fails[f])) > 0 as gone,
        len(list_filter(fails, lambda f: f)) as failures
    from alike, steps),
done as (
    select part, filter_order, step, own,
        sum(case when not gone and not fails_here then n else 0 end)::bigint as kept,
        sum(case when not gone and fails_here then n else 0 end)::bigint as removed,
        sum(case when gone and fails_here then n else 0 end)::bigint as redundant,
        sum(case when fails_here and failures = 1 then n else 0 end)::bigint as unique_fails,
        sum(case when not gone and fails_here and good then n else 0 end)::bigint as good_lost,
        sum(case when not gone and fails_here and bad then n else 0 end)::bigint as toxic_lost
    from run group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, own))::bigint as shapley
from done""",
}
