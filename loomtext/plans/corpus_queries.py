"""Corpus statistics, text functions and sketches over the articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, sketches
from ..operators.stitch import normal_qid
from .tables import DOCS, LINKED, TOKENS, claims, docs, linked, read

WIDTH, DEPTH = 4096, 6


def token_counts_top50(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ranked(corpus.token_counts(docs(spark, d)), "token", "n", 50)


def zipf_series(spark: SparkSession, d: str) -> DataFrame:
    """Logarithms of rank and frequency of the 2 000 most frequent tokens, the series of the rank-frequency figure."""
    top = corpus.ranked(corpus.token_counts(docs(spark, d)), "token", "n", 2000)
    return top.select("rank", F.round(F.log10("rank"), 6).alias("log_rank"), F.round(F.log10("n"), 6).alias("log_n"))


def token_bars(spark: SparkSession, d: str) -> DataFrame:
    top = corpus.ranked(corpus.token_counts(docs(spark, d)), "token", "n", 30)
    return top.select("rank", "token", X.text_bar(F.col("n"), F.max("n").over(Window.partitionBy(F.lit(1)))).alias("bar"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_stats(docs(spark, d))


def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.label_stats(docs(spark, d))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("split", "label").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


def sentences_per_doc(spark: SparkSession, d: str) -> DataFrame:
    s = F.filter(X.sentences(X.ascii_only(F.col("text"))), lambda x: x != "")
    return docs(spark, d).select("id", F.size(s).alias("n_sentences"))


def capped_tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", X.joined(X.sentence_tokens(X.ascii_only(F.col("text")))).alias("tokens"))


def alnum_token_stats(spark: SparkSession, d: str) -> DataFrame:
    t, w = X.tokens(F.col("text"), X.ALNUM), X.tokens(F.col("text"), X.DASHED)
    return docs(spark, d).select("id", F.size(t).alias("n_alnum"), F.size(w).alias("n_dashed"), F.size(X.shingles(t)).alias("n_shingles"))


def collapsed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines for a supervised text learner: a label mark and the text on one line."""
    line = F.concat(F.lit("__label__"), F.when(F.col("label") == 1, "fake").otherwise("real"), F.lit(" "), X.collapsed(X.ascii_only(F.col("text"))))
    return docs(spark, d).where("label is not null").select("id", F.md5(line).alias("line_md5"), F.length(line).alias("n_chars"))


def unified_articles(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("id", "label", "split", F.length("title").alias("title_chars"), F.length("text").alias("text_chars"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stratified_split(docs(spark, d))


def _token_items(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_counts(docs(spark, d)).withColumnRenamed("token", "item")


def cms_cells(spark: SparkSession, d: str) -> DataFrame:
    return sketches.cms_cells(_token_items(spark, d), width=WIDTH, depth=DEPTH)


def cms_estimates(spark: SparkSession, d: str) -> DataFrame:
    counts = _token_items(spark, d)
    est = sketches.cms_estimates(sketches.cms_cells(counts, width=WIDTH, depth=DEPTH), counts, width=WIDTH, depth=DEPTH)
    return est.join(counts, "item").select("item", "n", "estimate")


def cms_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return corpus.ranked(cms_estimates(spark, d).select("item", "estimate"), "item", "estimate", 50)


def cms_error(spark: SparkSession, d: str) -> DataFrame:
    """Greatest relative error over the 50 most frequent, by token and, as positional zip of both rankings, by rank."""
    est = cms_estimates(spark, d)
    exact = corpus.ranked(est, "item", "n", 50).select("rank", "item", "n", "estimate")
    sketch = corpus.ranked(est, "item", "estimate", 50).select("rank", F.col("estimate").alias("ranked_estimate"))
    err = lambda e: F.round(F.greatest(F.lit(0.0), F.max((F.col(e) - F.col("n")) / F.greatest("n", F.lit(1)))), 9)
    return exact.join(sketch, "rank").agg(err("estimate").alias("by_token"), err("ranked_estimate").alias("by_rank"))


def token_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: exact and sketched counts of the 50 most frequent tokens."""
    return corpus.ranked(cms_estimates(spark, d), "item", "n", 50)


def native_token_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The engine's own sketches: distinct tokens and the most frequent ones, approximate."""
    t = docs(spark, d).select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.agg(F.hll_sketch_estimate(F.hll_sketch_agg("token")).alias("n_distinct"), F.expr("approx_top_k(token, 20)").alias("top"))


def _qids(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).where("qid is not null").select(F.col("qid").alias("item")).distinct()


def _bloom(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int, int, int]:
    members = _qids(spark, d)
    n = members.count()
    bits, hashes = sketches.bloom_size(n, 0.01)
    return members, sketches.bloom_bits(members, bits, hashes), n, bits, hashes


def bloom_bits(spark: SparkSession, d: str) -> DataFrame:
    return _bloom(spark, d)[1]


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Membership of every known entity of the search cache in the filter of the resolved ones."""
    _, filter_bits, _, bits, hashes = _bloom(spark, d)
    probe = read(spark, d, "kb_search").select(normal_qid(F.col("record.qid")).alias("item"))
    return sketches.bloom_contains(filter_bits, probe, bits, hashes)


def bloom_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size of the filter, its rates of true and false positives, the latter on 500 invented ids, and its kilobytes beside those of a plain set at 24 bytes an entry."""
    members, filter_bits, n, bits, hashes = _bloom(spark, d)
    negatives = spark.range(500).select(F.concat(F.lit("QNOTREAL"), F.col("id").cast("string")).alias("item"))
    probes = members.withColumn("member", F.lit(True)).union(negatives.withColumn("member", F.lit(False)))
    hits = sketches.bloom_contains(filter_bits, probes, bits, hashes).join(probes, "item")
    rate = lambda m: F.round(F.avg(F.when(F.col("member") == m, F.col("maybe").cast("int"))), 9)
    plain, own = n * 24 / 1024, bits / 8 / 1024
    sizes = [F.lit(round(x, 6)).alias(c) for c, x in (("filter_kb", own), ("set_kb", plain), ("compression", n * 24 / max(own * 1024, 1)))]
    return hits.agg(rate(True).alias("tpr"), rate(False).alias("fpr")).select(F.lit(n).cast("bigint").alias("n_items"), F.lit(bits).cast("bigint").alias("n_bits"), F.lit(hashes).cast("bigint").alias("n_hashes"), "tpr", "fpr", *sizes)


def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The 30 most frequent resolved entities by label, else qid."""
    rows = linked(spark, d).where("qid is not null").groupBy(F.coalesce("label", "qid").alias("entity")).agg(F.count("*").alias("n"))
    return corpus.ranked(rows, "entity", "n", 30)


def link_counters(spark: SparkSession, d: str) -> DataFrame:
    """Resolved and unresolved rows, the share resolved, and the different entities."""
    s = linked(spark, d).agg(F.count("qid").alias("resolved"), F.count(F.when(F.col("qid").isNull(), 1)).alias("unresolved"), F.countDistinct("qid").alias("n_entities"))
    return s.withColumn("share", F.round(F.col("resolved") / F.greatest(F.col("resolved") + F.col("unresolved"), F.lit(1)), 9))


def mention_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned mentions by frequency, noise left out, at most 8 000."""
    m = read(spark, d, "mentions").select(X.clean_mention(F.col("text")).alias("mention"))
    return corpus.ranked(m.where(~X.is_noise(F.col("mention"))).groupBy("mention").agg(F.count("*").alias("n")), "mention", "n", 8000)


def clean_mentions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "mentions").select("mention_id", X.clean_mention(F.col("text")).alias("clean"), X.is_noise(X.clean_mention(F.col("text"))).alias("noise"))


KEEP_LABELS = ("PERSON", "ORG", "GPE", "LOC", "EVENT", "WORK_OF_ART", "PRODUCT", "NORP", "FAC", "LAW")


def article_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the wanted labels, first of each lower-cased text per article, at most 25 an article by position."""
    m = read(spark, d, "mentions").where(F.col("label").isin(*KEEP_LABELS) & F.col("text").isNotNull())
    order = F.struct("start_pos", "mention_id")
    first = m.groupBy("article_no", F.lower("text").alias("key")).agg(F.min(F.struct(order.alias("o"), "mention_id", "text", "label")).alias("f"))
    w = Window.partitionBy("article_no").orderBy("f.o")
    return first.withColumn("pos", F.row_number().over(w)).where("pos <= 25").select("article_no", "pos", "f.mention_id", "f.text", "f.label")


def regex_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names found in the texts by capitals alone, with their number per article."""
    rows = docs(spark, d).select("id", F.explode(X.capitalised_names(F.col("text"))).alias("mention"))
    return rows.groupBy("id", "mention").agg(F.count("*").alias("n"))


def regex_mention_offsets(spark: SparkSession, d: str) -> DataFrame:
    return X.name_mentions(docs(spark, d), "id", "text")


_CLEAN = r"""
clean as (
  select mention_id, c as c0, coalesce(
    case when starts_with(lower(c), 'the ') then substr(c, 5) when starts_with(lower(c), 'a ') then substr(c, 3) when starts_with(lower(c), 'an ') then substr(c, 4)
         when starts_with(lower(c), 'mr. ') then substr(c, 5) when starts_with(lower(c), 'mrs. ') then substr(c, 6) when starts_with(lower(c), 'ms. ') then substr(c, 5)
         when starts_with(lower(c), 'dr. ') then substr(c, 5) when starts_with(lower(c), 'prof. ') then substr(c, 7) when starts_with(lower(c), 'sir ') then substr(c, 5)
         when starts_with(lower(c), 'lady ') then substr(c, 6) end, c) as clean
  from (select mention_id, trim(trim(coalesce(text, '')), '"''`(){}[]<>,.;:!?@#$%^&*+=|/\~ ' || chr(9) || chr(13) || chr(10)) as c from mentions)
)
"""
_SENT = r"""
sent as (
  select id, list_filter(list_transform(str_split(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '([.!?])\s+([A-Z0-9"])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, e' \t\r\n')), lambda x: x <> '') as s
  from docs
)
"""
_CELLS = f"""
{DOCS.strip()}, {TOKENS}, cnt as (select token as item, count(*) as n from tok group by token),
cell as (
  select d, k, cast(sum(n) as bigint) as s from (
    select item, n, d, cast('0x' || substr(md5(d || '|' || item), 1, 15) as bigint) % {WIDTH} as k from cnt, range({DEPTH}) t(d)) group by d, k
), est as (
  select c.item, any_value(c.n) as n, min(s) as estimate
  from cnt c, range({DEPTH}) t(d) join cell on cell.d = t.d and cell.k = cast('0x' || substr(md5(t.d || '|' || c.item), 1, 15) as bigint) % {WIDTH} group by c.item
)
"""
_BLOOM = f"""
{LINKED.strip()}, item as (select distinct qid as item from linked where qid is not null),
size as (select n, greatest(8, cast(ceil(-n * ln(0.01) / (ln(2) * ln(2))) as bigint)) as bits, greatest(1, cast(round(-ln(0.01) / ln(2)) as bigint)) as hashes from (select count(*) as n from item)),
bit as (select distinct cast('0x' || substr(md5(i || '|' || item), 1, 15) as bigint) % bits as bit from item, size, range(20) r(i) where i < hashes)
"""

_MENTIONS = f"""with f as (select *, row_number() over (partition by article_no, lower(text) order by start_pos nulls first, mention_id) as k from mentions where text is not null and label in {KEEP_LABELS}),
        p as (select *, row_number() over (partition by article_no order by start_pos nulls first, mention_id) as pos from f where k = 1) select article_no, pos, mention_id, text, label from p where pos <= 25"""

_CAPITALS = r"\b[A-Z][a-zA-Z''\-]+(?:\s+[A-Z][a-zA-Z''\-]+){0,3}\b"

QUERIES = {
    f.__name__: f
    for f in (
        token_heavy_hitters, token_counts_top50, zipf_series, token_bars, corpus_stats, label_stats, label_counts, sentences_per_doc, capped_tokens, alnum_token_stats,
        collapsed_lines, unified_articles, stratified_split, cms_cells, cms_estimates, cms_heavy_hitters, cms_error, native_token_sketches, bloom_bits,
        bloom_probe, bloom_stats, entity_frequency, link_counters, mention_frequency, clean_mentions, article_mentions, regex_mentions, regex_mention_offsets,
    )
}

ORACLE = {
    "token_heavy_hitters": f"with {_CELLS} select item, n, estimate, row_number() over (order by n desc, item) as rank from est order by n desc, item limit 50",
    "token_counts_top50": f"with {DOCS}, {TOKENS} select token, count(*) as n, row_number() over (order by count(*) desc, token) as rank from tok group by token order by n desc, token limit 50",
    "zipf_series": f"with {DOCS}, {TOKENS}, t as (select token, count(*) as n, row_number() over (order by count(*) desc, token) as rank from tok group by token order by n desc, token limit 2000) select rank, round(log10(rank), 6) as log_rank, round(log10(n), 6) as log_n from t",
    "token_bars": f"with {DOCS}, {TOKENS}, t as (select token, count(*) as n, row_number() over (order by count(*) desc, token) as rank from tok group by token order by n desc, token limit 30) select rank, token, repeat('█', cast(round(30.0 * n / max(n) over ()) as int)) as bar from t",
    "corpus_stats": f"""with {DOCS}, l as (select len(regexp_extract_all(text, '[A-Za-z]+')) as len from docs), {TOKENS}
        select count(*) as n_docs, cast(sum(len) as bigint) as n_tokens, min(len) as min_len, max(len) as max_len, round(avg(len), 6) as mean_len,
               list_sort(list(len))[count(*) // 2 + 1] as median, (select count(distinct token) from tok) as n_unique from l""",
    "label_stats": f"with {DOCS} select count(*) filter (label = 0) as n_real, count(*) filter (label = 1) as n_fake, round(count(*) filter (label = 1) / greatest(count(*) filter (label = 0), 1), 6) as fake_to_real from docs",
    "label_counts": f"with {DOCS} select split, label, count(*) as n, round(avg(length(text)), 6) as mean_chars from docs group by split, label",
    "sentences_per_doc": f"with {DOCS}, {_SENT} select id, len(s) as n_sentences from sent",
    "capped_tokens": f"""with {DOCS}, {_SENT} select id, array_to_string(flatten(list_transform(s[1:40],
        lambda x: list_transform(regexp_extract_all(x, '[A-Za-z][A-Za-z\\-'']+'), lambda y: lower(y))[1:64])), ' ') as tokens from sent""",
    "alnum_token_stats": f"""with {DOCS}, w as (select id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as a, len(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']+')) as n_dashed from docs)
        select id, len(a) as n_alnum, n_dashed, case when len(a) = 0 then 0 when len(a) < 5 then 1 else
          len(list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')))) end as n_shingles from w""",
    "collapsed_lines": f"""with {DOCS}, l as (select id, '__label__' || case when label = 1 then 'fake' else 'real' end || ' ' || trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '\\s+', ' ', 'g')) as line from docs where label is not null)
        select id, md5(line) as line_md5, length(line) as n_chars from l""",
    "unified_articles": f"with {DOCS} select id, label, split, length(title) as title_chars, length(text) as text_chars from docs",
    "stratified_split": f"""with {DOCS}, h as (select id, label, row_number() over (partition by label order by cast('0x' || substr(md5('42|' || id), 1, 15) as bigint), id) as pos, count(*) over (partition by label) as n from docs),
        k as (select *, round(n * 0.1) as t from h) select id, label, case when pos <= t then 'test' when pos <= t + round((n - t) * (0.1 / 0.9)) then 'val' else 'train' end as part from k""",
    "cms_cells": f"with {_CELLS} select d, k, s from cell",
    "cms_estimates": f"with {_CELLS} select item, n, estimate from est",
    "cms_heavy_hitters": f"with {_CELLS} select item, estimate, row_number() over (order by estimate desc, item) as rank from est order by estimate desc, item limit 50",
    "cms_error": f"""with {_CELLS}, x as (select n, estimate, row_number() over (order by n desc, item) as r from est), y as (select estimate as e2, row_number() over (order by estimate desc, item) as r from est)
        select round(greatest(0, max((estimate - n) / greatest(n, 1))), 9) as by_token, round(greatest(0, max((e2 - n) / greatest(n, 1))), 9) as by_rank from x join y using (r) where r <= 50""",
    "bloom_bits": f"with {_BLOOM} select bit from bit",
    "bloom_probe": f"""with {_BLOOM}, p as (select distinct nullif(regexp_replace(upper(trim(record.qid, e' \\t\\r\\n')), '^WD:', ''), '') as item from kb_search where record.qid is not null)
        select item, bool_and(cast('0x' || substr(md5(i || '|' || item), 1, 15) as bigint) % bits in (select bit from bit)) as maybe from p, size, range(20) r(i) where i < hashes group by item""",
    "bloom_stats": f"""with {_BLOOM}, p as (select item, true as member from item union all select 'QNOTREAL' || i, false from range(500) r(i)),
        m as (select member, item, bool_and(cast('0x' || substr(md5(i || '|' || item), 1, 15) as bigint) % bits in (select bit from bit)) as maybe from p, size, range(20) r(i) where i < hashes group by all)
        select any_value(n) as n_items, any_value(bits) as n_bits, any_value(hashes) as n_hashes, round(avg(cast(maybe as int)) filter (member), 9) as tpr, round(avg(cast(maybe as int)) filter (not member), 9) as fpr,
          round(any_value(bits) / 8 / 1024, 6) as filter_kb, round(any_value(n) * 24 / 1024, 6) as set_kb, round(any_value(n) * 24 / greatest(any_value(bits) / 8, 1), 6) as compression from m, size""",
    "entity_frequency": f"with {LINKED} select coalesce(label, qid) as entity, count(*) as n, row_number() over (order by count(*) desc, coalesce(label, qid)) as rank from linked where qid is not null group by 1 order by n desc, entity limit 30",
    "link_counters": f"with {LINKED} select count(qid) as resolved, count(*) - count(qid) as unresolved, count(distinct qid) as n_entities, round(count(qid) / greatest(count(*), 1), 9) as share from linked",
    "mention_frequency": f"with {_CLEAN} select clean as mention, count(*) as n, row_number() over (order by count(*) desc, clean) as rank from clean where length(clean) >= 2 and not regexp_full_match(clean, '[0-9]+') group by clean order by n desc, clean limit 8000",
    "clean_mentions": f"with {_CLEAN} select mention_id, clean, length(clean) < 2 or regexp_full_match(clean, '[0-9]+') as noise from clean",
    "article_mentions": _MENTIONS,
    "regex_mention_offsets": rf"""with {DOCS}, t as (select id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') as t from docs),
        m as (select id, regexp_extract_all(t, '{_CAPITALS}') as ms, str_split_regex(t, '{_CAPITALS}') as ps from t), u as (select id, ms, ps, unnest(range(1, len(ms) + 1)) as k from m),
        o as (select id, k, ms[k] as text, list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) as start from u)
        select id, row_number() over (partition by id order by k) - 1 as pos, text, 'MISC' as label, start, start + length(text) as "end"
        from o where regexp_extract(text, '^\S+') not in ('The', 'A', 'An', 'On', 'In', 'Of', 'At', 'And', 'To')""",
    "regex_mentions": rf"""with {DOCS}, m as (select id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\b([A-Z][a-zA-Z''\-]+(?:\s+[A-Z][a-zA-Z''\-]+){{0,3}})\b', 1)) as mention from docs)
        select id, mention, count(*) as n from m where regexp_extract(mention, '^\S+') not in ('The', 'A', 'An', 'On', 'In', 'Of', 'At', 'And', 'To') group by all""",
}
