"""Knowledge-base cache, linking, article graphs and entity vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import kb, kg, transe
from ..operators.ordinals import with_ordinal
from .corpus_queries import _CLEAN, _MENTIONS, article_mentions
from .tables import LINKED, claims, linked, read

DIM = 64
#: Labels of mentions that are linked.
LINK_LABELS = ("PERSON", "ORG", "GPE", "LOC", "EVENT", "PRODUCT", "NORP", "FAC", "WORK_OF_ART", "LAW")


def _record() -> list:
    return [F.col("record.qid").alias("qid"), F.col("record.label").alias("label"), F.col("record.description").alias("description"), F.round("record.score", 6).alias("score")]


def kb_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return kb.last_writes(read(spark, d, "kb_search")).select("key", "mention", *_record(), kb.is_no_match(F.col("record")).alias("no_match"))


def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return kb.cache_stats(read(spark, d, "kb_search"))


def kb_purged(spark: SparkSession, d: str) -> DataFrame:
    return kb.valid_entries(read(spark, d, "kb_search")).select("key", F.col("record.qid").alias("qid"))


def link_mentions(spark: SparkSession, d: str) -> DataFrame:
    out = kb.link(read(spark, d, "mentions").select("mention_id", "text"), read(spark, d, "kb_search"))
    return out.select("mention_id", "cache_hit", "qid", "entity_label", "description", F.round("score", 6).alias("score"))


def link_prioritised(spark: SparkSession, d: str) -> DataFrame:
    out = kb.link_prioritised(read(spark, d, "mentions").select("mention_id", "text", "label"), read(spark, d, "kb_search"))
    return out.select("mention_id", "cache_hit", "qid", "trusted")


def offline_link_counters(spark: SparkSession, d: str) -> DataFrame:
    out = kb.link(read(spark, d, "mentions").select("text"), read(spark, d, "kb_search"))
    return out.agg(F.count(F.when(F.col("cache_hit"), 1)).alias("hits"), F.count(F.when(~F.col("cache_hit"), 1)).alias("misses"), F.count("qid").alias("resolved"))


def description_checks(spark: SparkSession, d: str) -> DataFrame:
    """For every cache entry and label the mentions carry, whether the description fits and the classes clash."""
    rows = read(spark, d, "mentions").where("text is not null and label is not null").select(F.lower(X.clean_mention(F.col("text"))).alias("key"), "label").distinct()
    rows = rows.join(kb.last_writes(read(spark, d, "kb_search")), "key")
    rows = rows.join(claims(spark, d).select(F.col("qid").alias("cq"), F.col("claims")["P31"].alias("classes")), F.col("record.qid") == F.col("cq"), "left")
    return rows.select("key", "label", kb.description_fits(F.col("record"), F.col("label")).alias("fits"), F.coalesce(kb.class_mismatch(F.col("record"), F.col("classes"), F.col("label")), F.lit(False)).alias("clash"))


def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Per cached mention and label of the mentions, of all its lines in file order, the first whose description fits the label, else the first."""
    lines = read(spark, d, "kb_search").where("mention is not null").groupBy(F.lower("mention").alias("key")).agg(F.array_sort(F.collect_list(F.struct("line_no", "record"))).alias("xs"))
    labels = F.explode(F.array(*[F.lit(x) for x in LINK_LABELS]))
    rows = lines.select("key", F.col("xs.record").alias("cands"), labels.alias("label"))
    best = rows.select("key", "label", kb.best_candidate(F.col("cands"), F.col("label")).alias("record"))
    return best.select("key", "label", "record.qid", "record.description")


def entity_triples(spark: SparkSession, d: str) -> DataFrame:
    """Index of the triple store: per entity its relations, values and class."""
    rows = kb.claim_rows(claims(spark, d)).groupBy("qid").agg(F.countDistinct("property").alias("n_relations"), F.count("*").alias("n_values"))
    return rows.join(read(spark, d, "crossview"), "qid", "left").select("qid", "n_relations", "n_values", "class_path")


def claims_filtered(spark: SparkSession, d: str) -> DataFrame:
    return kb.claim_rows(claims(spark, d), kb.TOP_RELATIONS)


def claims_all(spark: SparkSession, d: str) -> DataFrame:
    return kb.claim_rows(claims(spark, d))


def cache_wanted(spark: SparkSession, d: str) -> DataFrame:
    """Resolved entities without cached claims."""
    return linked(spark, d).where("qid is not null").select("qid").distinct().join(claims(spark, d).select("qid"), "qid", "left_anti")


def qid_batches(spark: SparkSession, d: str) -> DataFrame:
    """Wanted entities in sorted batches of 50."""
    return with_ordinal(cache_wanted(spark, d), "qid").select("qid", F.floor(F.col("ordinal") / 50).alias("batch"))


def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    return kg.article_triples(linked(spark, d), kb.claim_rows(claims(spark, d), kb.TOP_RELATIONS), read(spark, d, "crossview"))


def kg_member_of(spark: SparkSession, d: str) -> DataFrame:
    return kg_triples(spark, d).where(F.col("r") == kg.MEMBER_OF).select("h", "t").distinct()


def kg_relations(spark: SparkSession, d: str) -> DataFrame:
    """Triples, different heads and tails of each relation."""
    return kg_triples(spark, d).groupBy("r").agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_heads"), F.countDistinct("t").alias("n_tails"))


def kg_article_entities(spark: SparkSession, d: str) -> DataFrame:
    return kg.article_entities(linked(spark, d))


def kg_entity_index(spark: SparkSession, d: str) -> DataFrame:
    """Dense numbers of all heads and tails in sorted order."""
    t = kg_triples(spark, d)
    return with_ordinal(t.select(F.col("h").alias("entity")).union(t.select("t")).distinct(), "entity")


def class_chain(spark: SparkSession, d: str) -> DataFrame:
    return kg.class_chains(claims(spark, d))


def ontology_paths(spark: SparkSession, d: str) -> DataFrame:
    return kg.ontology_nodes(kg.class_chains(claims(spark, d)), claims(spark, d))


def crossview_built(spark: SparkSession, d: str) -> DataFrame:
    return kg.crossview_of(kg.class_chains(claims(spark, d)))


def entities_by_class(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "crossview").groupBy("class_path").agg(F.count("*").alias("n"), F.min("qid").alias("first_qid"))


def kg_neighbours_2hop(spark: SparkSession, d: str) -> DataFrame:
    rows = kb.claim_rows(claims(spark, d)).where(F.col("value").rlike("^Q[0-9]+$"))
    return kg.neighbour_counts(rows.select(F.col("qid").alias("a"), F.col("value").alias("b")))


def article_star_edges(spark: SparkSession, d: str) -> DataFrame:
    """Star graph of each article: ARTICLE to its entities with how often they are mentioned."""
    rows = linked(spark, d).where("qid is not null").groupBy("article_no", "qid").agg(F.count("*").alias("weight"))
    return rows.select(F.concat(F.lit("ARTICLE:"), F.col("article_no").cast("string")).alias("src"), F.col("qid").alias("dst"), "weight")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings")


def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    return kg.centroids(_vectors(spark, d), DIM).select("label", "n", F.posexplode("c").alias("dim", "value")).withColumn("value", F.round("value", 6))


def membership_refined(spark: SparkSession, d: str) -> DataFrame:
    out = kg.refine(_vectors(spark, d), DIM)
    return out.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 5))


def membership_loss(spark: SparkSession, d: str) -> DataFrame:
    return kg.membership_loss(_vectors(spark, d), DIM).select(F.round("loss", 6).alias("loss"))


def _entity_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))


def kg_weighted(spark: SparkSession, d: str) -> DataFrame:
    """As kg_encoded, but every mention counts, and entities with cached claims count twice."""
    rows = linked(spark, d).where("qid rlike '^Q[0-9]+$'").groupBy(F.col("article_no").alias("id"), "qid").agg(F.count("*").alias("count"))
    known = claims(spark, d).select("qid", F.lit(2.0).alias("given"))
    rows = rows.join(known, "qid", "left").select("id", (F.substring("qid", 2, 18).cast("bigint") % 1000).alias("key"), "count", F.coalesce("given", F.lit(1.0)).alias("given"))
    return kg.weighted_mean_vectors(rows, _entity_vectors(spark, d), DIM).withColumn("value", F.round("value", 5))


def ontology_classes(spark: SparkSession, d: str) -> DataFrame:
    """All classes of levels 1 to 3 below the root, by dotted path."""
    return kg.all_classes(ontology_paths(spark, d))


def ontology_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The node of each class path of the crossview built from the claims."""
    paths = crossview_built(spark, d).select("class_path").distinct()
    return kg.find_nodes(ontology_paths(spark, d), paths, "class_path")


def ontology_nested(spark: SparkSession, d: str) -> DataFrame:
    """The ontology as one nested JSON object."""
    return kg.nested(ontology_paths(spark, d))


def kg_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each article's different entities; an entity's vector is looked up by the number of its qid modulo 1 000, some have none."""
    ents = kg.article_entities(linked(spark, d)).where("qid rlike '^Q[0-9]+$'").select(F.col("article_no").alias("id"), (F.substring("qid", 2, 18).cast("bigint") % 1000).alias("key"))
    return kg.mean_vectors(ents, _entity_vectors(spark, d), DIM).withColumn("value", F.round("value", 5))


def transe_scores(spark: SparkSession, d: str) -> DataFrame:
    t = kb.claim_rows(claims(spark, d)).select(F.col("qid").alias("h"), F.col("property").alias("r"), F.col("value").alias("t")).distinct()
    v = lambda c: kg.hashed_vector(F.col(c), 4)
    return t.select("h", "r", "t", F.round(kg.translation_score(v("h"), v("r"), v("t")), 6).alias("score"))


def transe_negatives(spark: SparkSession, d: str) -> DataFrame:
    t = kb.claim_rows(claims(spark, d)).select(F.col("qid").alias("h"), F.col("property").alias("r"), F.col("value").alias("t")).distinct()
    ents = with_ordinal(t.select(F.col("h").alias("entity")).union(t.select("t")).distinct(), "entity")
    return kg.corrupted_tails(t, ents)


def transe_vectors(spark: SparkSession, d: str) -> DataFrame:
    t = kb.claim_rows(claims(spark, d)).select(F.col("qid").alias("h"), F.col("property").alias("r"), F.col("value").alias("t"))
    return transe.train(t).select("kind", "key", F.posexplode("vec").alias("dim", "value"))


def mention_label_rows(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the first 25 per article by whether their label is one that is linked or skipped."""
    kept = F.col("label").isin("PERSON", "ORG", "GPE", "LOC", "EVENT", "PRODUCT", "NORP", "FAC", "WORK_OF_ART")
    return article_mentions(spark, d).groupBy(F.when(kept, "linked").otherwise("skipped").alias("state"), "label").agg(F.count("*").alias("n"))


_LAST = "lw as (select key, m as mention, r as record from (select lower(mention) as key, arg_max(mention, line_no) as m, arg_max(record, line_no) as r from kb_search where mention is not null group by 1))"
_NM = "coalesce(record._no_match, false)"
_LINK = f"""{_CLEAN}, {_LAST}, ln as (select mention_id, lw.key is not null as cache_hit, case when coalesce(record.qid, '') <> '' and not {_NM} then record end as rec, record, clean from clean left join lw on lower(clean) = lw.key)"""
_CLAIMS = "cl as (select qid, k as property, i - 1 as at, claims[k][i] as value from (select qid, claims, unnest(map_keys(claims)) as k from kb_claims), range(1, 6) r(i) where i <= len(claims[k]) and claims[k][i] is not null)"
_TOP = "', '".join(kb.TOP_RELATIONS)
_TRIPLES = f"""{LINKED}, {_CLAIMS}, tr as (select article_no, link_id, linked.qid as h, f.r, f.t from linked join (select qid, property as r, value as t from cl where property in ('{_TOP}') union all select qid, 'MEMBER_OF', class_path from crossview) f on f.qid = linked.qid)"""


def _next_sql(c: str, visited: str) -> str:
    fresh = lambda p: f"list_filter({c}['{p}'], lambda v: starts_with(v, 'Q') and not list_contains([{visited}], v))[1]"
    return f"coalesce({fresh('P31')}, {fresh('P279')})"


_CHAIN = f"""h1 as (select qid, {_next_sql('claims', 'qid')} as c1 from kb_claims),
h2 as (select h1.*, {_next_sql('k.claims', 'h1.qid, c1')} as c2 from h1 left join kb_claims k on k.qid = c1),
chain as (select h2.*, {_next_sql('k.claims', "h2.qid, c1, coalesce(c2, '')")} as c3 from h2 left join kb_claims k on k.qid = c2)"""
_ONTOLOGY = f"""{_CHAIN}, p as (select qid, list_filter(['MISC', c1, c2, c3], lambda c: c is not null) as p from chain), n as (select distinct p[1:i] as p from p, range(1, 5) r(i) where i <= len(p)),
        k as (select p, unnest(map_keys(claims)) as k from p join kb_claims using (qid)), a as (select p, string_agg(distinct k, ',' order by k) as attributes from k group by p),
        o as (select array_to_string(n.p, '.') as path, len(n.p) as level, case when len(n.p) > 1 then array_to_string(n.p[1:len(n.p) - 1], '.') end as parent, coalesce(attributes, '') as attributes from n left join a on n.p = a.p)"""
_FITS = "case " + " ".join(f"when m.label = '{k}' then regexp_matches(lower(coalesce(record.description, '')), '{'|'.join(w)}')" for k, w in kb.DESCRIPTION_WORDS.items()) + " else true end"
_CLASH = "case " + " ".join(f"when m.label = '{k}' then not list_has_any(k.claims['P31'], {list(w)})" for k, w in kb.EXPECTED_CLASSES.items()) + " else false end"
_DIMS = f"range({DIM}) r(i)"
_CENT = f"cent as (select label, i as dim, count(*) as n, avg(embedding[i + 1]::double) as c from embeddings, {_DIMS} group by label, i)"
_VEC = lambda c, i: f"(2 * (cast('0x' || substr(md5((500 + {i}) || '|' || {c}), 1, 15) as bigint) / 1152921504606846976.0::double) - 1)"
_NUMBERED = "num as (select entity, row_number() over (order by entity) - 1 as ordinal from (select h as entity from tr union select t from tr))"

QUERIES = {
    f.__name__: f
    for f in (
        kb_last_write_wins, kb_stats, kb_purged, link_mentions, link_prioritised, offline_link_counters, description_checks, best_candidates, entity_triples, claims_filtered, claims_all, cache_wanted,
        qid_batches, kg_triples, kg_member_of, kg_relations, kg_article_entities, kg_entity_index, class_chain, ontology_paths, crossview_built, entities_by_class,
        kg_neighbours_2hop, article_star_edges, ontology_classes, ontology_lookup, ontology_nested, kg_weighted, class_centroids, membership_refined, membership_loss, kg_encoded, transe_scores, transe_negatives, transe_vectors, mention_label_rows,
    )
}

ORACLE = {
    "kb_last_write_wins": f"with {_LAST} select key, mention, record.qid as qid, record.label as label, record.description as description, round(record.score, 6) as score, {_NM} as no_match from lw",
    "kb_stats": f"with {_LAST} select count(*) as total, count(*) filter (coalesce(record.qid, '') <> '') as resolved, count(*) filter ({_NM}) as no_match, count(*) filter (coalesce(record.qid, '') = '' and not {_NM}) as empty from lw",
    "kb_purged": f"with {_LAST} select key, record.qid as qid from lw where coalesce(record.qid, '') <> '' or {_NM}",
    "link_mentions": f"with {_LINK} select mention_id, cache_hit, rec.qid as qid, rec.label as entity_label, rec.description as description, case when rec is not null then round(coalesce(rec.score, 0), 6) end as score from ln",
    "link_prioritised": f"with {_LINK}, q as (select ln.*, m.label, w.record as full_rec from ln join mentions m using (mention_id) left join lw w on w.key = lower(coalesce(m.label, '') || '|' || clean)) select mention_id, cache_hit or full_rec is not null as cache_hit, coalesce(full_rec.qid, rec.qid) as qid, full_rec is not null or (record is not null and not {_NM} and {_FITS.replace('m.label', 'label')}) as trusted from q",
    "offline_link_counters": f"with {_LINK} select count(*) filter (cache_hit) as hits, count(*) filter (not cache_hit) as misses, count(rec.qid) as resolved from ln",
    "description_checks": f"""with {_CLEAN}, {_LAST}, m as (select distinct lower(clean) as key, label from clean join mentions using (mention_id) where text is not null and label is not null), s as (select m.key, m.label, record is not null and not {_NM} and {_FITS} as fits, len(k.claims['P31']) > 0 and {_CLASH} as clash from m join lw using (key) left join kb_claims k on k.qid = record.qid)
        select key, label, fits, coalesce(not fits and clash, false) as clash from s""",
    "best_candidates": f"""with m as (select lower(mention) as key, line_no, record, label from kb_search, (select unnest({list(LINK_LABELS)}) as label) where mention is not null),
        b as (select key, label, arg_min(record, (case when not {_NM} and ({_FITS.replace('m.label', 'label')}) then 0 else 1 end) * 1000000000 + line_no) as r from m group by key, label) select key, label, r.qid as qid, r.description as description from b""",
    "entity_triples": f"with {_CLAIMS}, e as (select qid, count(distinct property) as n_relations, count(*) as n_values from cl group by qid) select e.qid, n_relations, n_values, class_path from e left join crossview using (qid)",
    "claims_filtered": f"with {_CLAIMS} select * from cl where property in ('{_TOP}')",
    "claims_all": f"with {_CLAIMS} select * from cl",
    "cache_wanted": f"with {LINKED} select distinct qid from linked where qid is not null and qid not in (select qid from kb_claims)",
    "qid_batches": f"with {LINKED}, w as (select distinct qid from linked where qid is not null and qid not in (select qid from kb_claims)) select qid, (row_number() over (order by qid) - 1) // 50 as batch from w",
    "kg_triples": f"with {_TRIPLES} select * from tr",
    "kg_member_of": f"with {_TRIPLES} select distinct h, t from tr where r = 'MEMBER_OF'",
    "kg_relations": f"with {_TRIPLES} select r, count(*) as n, count(distinct h) as n_heads, count(distinct t) as n_tails from tr group by r",
    "kg_article_entities": f"with {LINKED}, f as (select article_no, qid, min(link_id) as first from linked where qid is not null group by all) select article_no, row_number() over (partition by article_no order by first) as pos, qid from f",
    "kg_entity_index": f"with {_TRIPLES}, {_NUMBERED} select entity, ordinal from num",
    "class_chain": f"with {_CHAIN} select qid, c1, c2, c3 from chain",
    "ontology_paths": f"with {_ONTOLOGY} select * from o",
    "ontology_classes": f"with {_ONTOLOGY} select path, level from o where level between 1 and 3",
    "ontology_lookup": f"with {_ONTOLOGY} select class_path, level, attributes from (select distinct concat_ws('.', 'MISC', c1, c2) as class_path from chain) join o on path = class_path",
    "kg_weighted": f"""with {LINKED}, c as (select article_no as id, qid, count(*) as n from linked where regexp_full_match(qid, 'Q[0-9]+') group by all),
        a as (select id, c.qid, n * case when k.qid is not null then 2.0::double else 1.0::double end as w from c left join kb_claims k on k.qid = c.qid),
        v as (select id, w, embedding from a left join embeddings on vec_id = cast(substr(qid, 2) as bigint) % 1000),
        u as (select id, case when len(list_filter(embedding, lambda x: x <> 0)) > 0 then w end as w, embedding from v)
        select id, i as dim, round(coalesce(sum(w * embedding[i + 1]::double) / sum(w), 0), 5) as value from u, {_DIMS} group by id, i""",
    "crossview_built": f"with {_CHAIN} select qid, concat_ws('.', 'MISC', c1, c2) as class_path from chain",
    "entities_by_class": "select class_path, count(*) as n, min(qid) as first_qid from crossview group by 1",
    "kg_neighbours_2hop": f"""with {_CLAIMS}, e as (select qid as a, value as b from cl where regexp_full_match(value, 'Q[0-9]+')), u as (select a, b from e where a <> b union select b, a from e where a <> b),
        t as (select a, b from u union select x.a, y.b from u x join u y on x.b = y.a where x.a <> y.b) select a as node, (select count(*) from u where u.a = t.a) as near, count(*) as within_two from t group by a""",
    "article_star_edges": f"with {LINKED} select 'ARTICLE:' || article_no as src, qid as dst, count(*) as weight from linked where qid is not null group by all",
    "class_centroids": f"with {_CENT} select label, n, dim, round(c, 6) as value from cent",
    "membership_refined": f"with {_CENT} select vec_id, i as dim, round(c + pow(0.9::double, 5) * (embedding[i + 1]::double - c), 5) as value from embeddings e, {_DIMS} join cent on cent.label = e.label and cent.dim = i",
    "membership_loss": f"with {_CENT}, s as (select e.label, vec_id, sum((embedding[i + 1]::double - c) * (embedding[i + 1]::double - c)) as d from embeddings e, {_DIMS} join cent on cent.label = e.label and cent.dim = i group by all) select round(avg(l), 6) as loss from (select avg(d) as l from s group by label)",
    "kg_encoded": f"""with {LINKED}, a as (select distinct article_no as id, qid from linked where regexp_full_match(qid, 'Q[0-9]+')), v as (select id, embedding from a left join embeddings on vec_id = cast(substr(qid, 2) as bigint) % 1000)
        select id, i as dim, round(coalesce(avg(embedding[i + 1]::double), 0), 5) as value from v, {_DIMS} group by id, i""",
    "transe_scores": f"with {_CLAIMS}, t as (select distinct qid as h, property as r, value as t from cl) select h, r, t, round(sqrt({' + '.join(f'pow({_VEC(chr(104), i)} + {_VEC(chr(114), i)} - {_VEC(chr(116), i)}, 2)' for i in range(4))}), 6) as score from t",
    "transe_negatives": f"with {_CLAIMS}, tr as (select distinct qid as h, property as r, value as t from cl), {_NUMBERED} select h, r, t, entity as negative from tr join num on ordinal = cast('0x' || substr(md5('7|' || h || '|' || r || '|' || t), 1, 15) as bigint) % (select count(*) from num)",
    "mention_label_rows": f"""with am as ({_MENTIONS}) select case when label in ('PERSON', 'ORG', 'GPE', 'LOC', 'EVENT', 'PRODUCT', 'NORP', 'FAC', 'WORK_OF_ART') then 'linked' else 'skipped' end as state, label, count(*) as n from am group by all""",
}
