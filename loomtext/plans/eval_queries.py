"""Features, predictions, measures, comments and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..operators import augment, classify, comments, kb, kg, metrics, textrank, tfidf
from .corpus_queries import _MENTIONS, article_mentions
from .kg_queries import DIM, _CLEAN, _LAST, _NM, kg_encoded
from .tables import DOCS, LINKED, claims, docs, linked, read
from .text_queries import _TOKEN_VECTORS, _VOCAB, _WEIGHTED, doc_text_vectors
from .text_queries import DIM as TEXT_DIM


def unresolved_scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, split, label, score): share of an article's linked mentions without an entity, as a score for being fake."""
    s = linked(spark, d).groupBy(F.col("article_no").alias("id")).agg((F.count(F.when(F.col("qid").isNull(), 1)) / F.count("*")).alias("score"))
    return docs(spark, d).select("id", "split", "label").join(s, "id").withColumn("score", F.round("score", 9))


def confusion_prf(spark: SparkSession, d: str) -> DataFrame:
    rows = unresolved_scores(spark, d).withColumn("predicted", metrics.decided(F.col("score"), 0.2))
    return metrics.confusion(rows, ["split"])


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(unresolved_scores(spark, d))


def logit_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Scores read as logits, to probability and decision."""
    p = X.sigmoid(10 * F.col("score") - 2)
    return unresolved_scores(spark, d).select("id", F.round(p, 6).alias("probability"), metrics.decided(p).alias("predicted"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """First sentence as the prediction of the title."""
    first = F.coalesce(F.get(X.sentences(X.ascii_only(F.col("text"))), 0), F.lit(""))
    return docs(spark, d).select("id", first.alias("predicted"), X.ascii_only(F.col("title")).alias("reference"))


def rouge1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rouge_n(_titles(spark, d), 1).withColumn("f1", F.round("f1", 9))


def rouge2(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rouge_n(_titles(spark, d), 2).withColumn("f1", F.round("f1", 9))


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rouge_l(_titles(spark, d)).withColumn("f1", F.round("f1", 9))


def rouge_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean F1 of the three measures, from one pass."""
    names = ["rouge1", "rouge2", "rougeL"]
    means = metrics.rouge(_titles(spark, d)).agg(*[F.round(F.avg(n), 6).alias(n) for n in names])
    return means.unpivot([], names, "measure", "f1")


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Three simple models' verdicts per article."""
    s = unresolved_scores(spark, d).join(docs(spark, d).select("id", "title", "text"), "id")
    votes = F.array(
        F.struct(F.lit("entities").alias("model"), (F.col("score") >= 0.2).alias("fake")),
        F.struct(F.lit("short").alias("model"), (F.length("text") < 900).alias("fake")),
        F.struct(F.lit("loud").alias("model"), F.col("title").rlike("[!?]|BREAKING").alias("fake")),
    )
    return s.select("id", "split", "label", F.explode(votes).alias("v")).select("id", "split", "label", "v.model", F.col("v.fake").cast("int").alias("predicted"))


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return metrics.majority(_models(spark, d))


def model_reports(spark: SparkSession, d: str) -> DataFrame:
    """One report row per model, best f1 first."""
    return metrics.confusion(_models(spark, d), ["model"]).withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1", "miss_rate")}).orderBy(F.desc("f1"), "model")


def report_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return model_reports(spark, d).unpivot("model", ["precision", "recall", "f1", "miss_rate"], "metric", "value")


MAX_KINDS = 1000


def report_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Mean value per day and event type, one column per type; more than MAX_KINDS types raise ValueError."""
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    kinds = sorted(r[0] for r in e.where("event_type is not null").select("event_type").distinct().limit(MAX_KINDS + 1).collect())
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} event types cannot be columns of one report")
    return e.groupBy("day").pivot("event_type", kinds).agg(F.round(F.avg("value"), 6))


def smoothed_losses(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of each event type as the losses of a run: smoothed, with early stopping."""
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))
    rows = e.select("run", F.datediff("day", F.lit("2024-01-01")).alias("epoch"), "loss")
    return metrics.smoothed_losses(rows).withColumn("ema", F.round("ema", 6))


def comment_flags(spark: SparkSession, d: str) -> DataFrame:
    return comments.flags(article_mentions(spark, d), read(spark, d, "kb_search"), claims(spark, d))


def comment_texts(spark: SparkSession, d: str) -> DataFrame:
    return comments.comments(docs(spark, d), comment_flags(spark, d), textrank.textrank(docs(spark, d), 3))


def domain_guard(spark: SparkSession, d: str) -> DataFrame:
    """Articles too short or without resolved entities to be judged."""
    ents = linked(spark, d).where("qid is not null").groupBy(F.col("article_no").alias("id")).agg(F.countDistinct("qid").alias("resolved"))
    rows = docs(spark, d).select("id", F.size(F.filter(F.split(X.ascii_only(F.col("text")), r"\s+"), lambda w: w != "")).alias("tokens")).join(ents, "id", "left")
    return rows.withColumn("resolved", F.coalesce("resolved", F.lit(0))).select("id", "tokens", "resolved", *comments.out_of_domain("tokens", "resolved"))


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, block, dim, value): text and graph vectors of each labelled article, put together; zeros where an article has no entities."""
    base = docs(spark, d).where("label is not null").select("id", "label")
    dims = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("dim")
    text = base.select("id", "label", dims(TEXT_DIM)).join(doc_text_vectors(spark, d), ["id", "dim"], "left").select("id", "label", F.lit("text").alias("block"), "dim", F.coalesce("value", F.lit(0.0)).alias("value"))
    graph = base.select("id", "label", dims(DIM)).join(kg_encoded(spark, d), ["id", "dim"], "left").select("id", "label", F.lit("kg").alias("block"), "dim", F.coalesce("value", F.lit(0.0)).alias("value"))
    return text.unionByName(graph)


def ablation_masks(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the values that each ablation mode lets through, per article."""
    f = feature_matrix(spark, d)
    keep = lambda m, b: F.round(F.sum(F.when(F.col("block").isin(*b), F.col("value")).otherwise(0.0)), 6).alias(m)
    return f.groupBy("id").agg(keep("both", ["text", "kg"]), keep("text_only", ["text"]), keep("ontology_only", ["kg"]))


def hashing_logreg(spark: SparkSession, d: str) -> DataFrame:
    return classify.train_and_score(docs(spark, d))


def hashing_logreg_history(spark: SparkSession, d: str) -> DataFrame:
    """Loss of each iteration of the classifier's fit, smoothed, and where early stopping would have ended it."""
    rows = classify.history(docs(spark, d))
    return rows.join(metrics.smoothed_losses(rows), ["run", "epoch"]).select("run", "epoch", "loss", "ema", "stopped")


def hashing_logreg_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(hashing_logreg(spark, d).withColumn("predicted", metrics.decided(F.col("score"))), ["split"])


def textrank_prior(spark: SparkSession, d: str) -> DataFrame:
    """Keywords by a walk that starts at the tf-idf weights of the training part."""
    prior = tfidf.idf(docs(spark, d).where("split = 'train'"))
    return textrank.textrank(docs(spark, d), prior=prior).select("id", "rank", "keyword", F.round("score", 6).alias("score"))


def decision_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the small network on text and graph vectors, one row per article and ablation mode."""
    wide = feature_matrix(spark, d).groupBy("id", "label").agg(*[F.array_sort(F.collect_list(F.when(F.col("block") == b, F.struct("dim", "value")))).alias(b) for b in ("text", "kg")])
    rows = scratch.keep(wide.select("id", "label", F.col("text.value").alias("text"), F.col("kg.value").alias("kg")).join(docs(spark, d).select("id", "split"), "id"), "vectors")
    parts = [classify.decide(rows, m).withColumn("mode", F.lit(m)) for m in ("both", "text_only", "ontology_only")]
    return parts[0].union(parts[1]).union(parts[2])


def ablation_report(spark: SparkSession, d: str) -> DataFrame:
    """Confusion and measures of each ablation mode on the rows outside the training part."""
    rows = decision_scores(spark, d).where("split <> 'train'").withColumn("predicted", metrics.decided(F.col("score")))
    return metrics.confusion(rows, ["mode"])


def augmented_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with given names swapped and repetitions dropped."""
    rows = docs(spark, d).select("id", X.tokens(F.col("text")).alias("tokens"))
    topics = spark.createDataFrame([("the",), ("and",)], "word string")
    return augment.augmented(rows, augment.synonym_lists(_name_synonyms(spark, d)), topics, 0.5).select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("text"))


def _name_synonyms(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.lower("record.label"), " ")
    two = read(spark, d, "kb_search").where("record.label is not null").select(F.get(w, 1).alias("last"), F.get(w, 0).alias("first")).where("last is not null").distinct()
    return two.select("last", F.col("first").alias("word")).join(two.select("last", F.col("first").alias("synonym")), "last").select("word", "synonym")


def coverage_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("id", X.tokens(F.col("text")).alias("tokens"))
    return augment.coverage_filter(rows, 0.05).select("id", F.size("tokens").alias("n_kept"))


def synonyms_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Given names swapped for the other given names of the same surname in the search cache, as a synonym table, in titles and texts together."""
    both = X.tokens(F.concat_ws(" ", "title", "text"))
    toks = docs(spark, d).select("id", F.posexplode(both).alias("pos", "token"))
    topics = spark.createDataFrame([("the",), ("and",)], "word string")
    return augment.synonym_replace(toks, augment.synonym_lists(_name_synonyms(spark, d)), topics, 0.5)


_SCORE = f"{LINKED}, s as (select article_no as id, count(*) filter (qid is null) / count(*) as score from linked group by 1), u as (select d.id, split, d.label, round(score, 9) as score, title, text from docs d join s on s.id = d.id)"
_CONF = """count(*) filter (label = 1 and predicted = 1) as tp, count(*) filter (label = 0 and predicted = 1) as fp, count(*) filter (label = 1 and predicted = 0) as fn, count(*) filter (label = 0 and predicted = 0) as tn, count(*) as n"""


def _prf(src: str, key: str, digits: int) -> str:
    return f"""conf as (select {key}, {_CONF} from {src} where label is not null and predicted is not null group by {key}),
    prf as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from conf),
    rep as (select {key}, tp, fp, fn, tn, n, round(p, {digits}) as precision, round(r, {digits}) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, {digits}) as f1, round(1 - r, {digits}) as miss_rate from prf)"""


_VOTES = f"{DOCS}, {_SCORE}, v as (select id, split, label, 'entities' as model, cast(score >= 0.2 as int) as predicted from u union all select id, split, label, 'short', cast(length(text) < 900 as int) from u union all select id, split, label, 'loud', cast(regexp_matches(title, '[!?]|BREAKING') as int) from u)"
_TITLES = r"""
ti as (select id, regexp_replace(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '([.!?])\s+([A-Z0-9"])', '\1' || chr(1) || '\2', 'g') as s, regexp_replace(title, '[^\x00-\x7F]', ' ', 'g') as reference from docs),
pr as (select id, list_filter(str_split_regex(lower(str_split(s, chr(1))[1]), '\s+'), lambda x: x <> '') as p, list_filter(str_split_regex(lower(reference), '\s+'), lambda x: x <> '') as r from ti)
"""


def _rouge(n: int) -> str:
    gram = lambda c: f"list_transform(range(1, greatest(len({c}) - {n - 2}, 1)), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    return f"""{_TITLES}, g as (select id, unnest({gram('p')}) as g, 1 as cp, 0 as cr from pr union all select id, unnest({gram('r')}), 0, 1 from pr),
    gc as (select id, g, sum(cp) as cp, sum(cr) as cr from g group by id, g), rg as (select id, 2 * sum(least(cp, cr)) / (sum(cp) + sum(cr)) as f1 from gc group by id),
    ro as (select id, coalesce(f1, 0.0) as f1 from docs left join rg using (id))"""


#: Longest common subsequence row by row of its table: `row` holds the best length with each prefix of the reference.
_LCS = f"""{_TITLES}, lc as (
      select id, p, r, 0 as i, list_transform(range(len(r) + 1), lambda x: 0) as row from pr
      union all
      select id, p, r, i + 1, list_transform(range(len(r) + 1), lambda j: case when j = 0 then 0 else list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k + 1], case when p[i + 1] = r[k] then row[k] + 1 else 0 end))) end)
      from lc where i < len(p)),
    lo as (select id, case when row[len(r) + 1] > 0 then 2 * row[len(r) + 1] / (len(p) + len(r)) else 0.0 end as f1 from lc where i = len(p))"""
_FITS = "case " + " ".join(f"when label = '{k}' then regexp_matches(lower(coalesce(rec.description, '')), '{'|'.join(w)}')" for k, w in kb.DESCRIPTION_WORDS.items()) + " else true end"
_CLASH = "case " + " ".join(f"when label = '{k}' then coalesce(len(c), 0) > 0 and not list_has_any(c, {list(w)})" for k, w in kb.EXPECTED_CLASSES.items()) + " else false end"

_ESCAPED = r"replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_QUOTED = f"""case when contains(text, '''') and not contains(text, '"') then '"' || {_ESCAPED} || '"' else '''' || replace({_ESCAPED}, '''', '\\''') || '''' end"""

QUERIES = {
    f.__name__: f
    for f in (
        unresolved_scores, confusion_prf, roc_auc, logit_decisions, rouge1, rouge2, rouge_l, rouge_means, majority_vote, model_reports, report_unpivot, report_pivot,
        smoothed_losses, comment_flags, comment_texts, domain_guard, feature_matrix, ablation_masks, hashing_logreg, hashing_logreg_history, hashing_logreg_report, textrank_prior, decision_scores, ablation_report, coverage_filtered, synonyms_replaced, augmented_texts,
    )
}

ORACLE = {
    "unresolved_scores": f"with {DOCS}, {_SCORE} select id, split, label, score from u",
    "confusion_prf": f"with {DOCS}, {_SCORE}, x as (select *, cast(score >= 0.2 as int) as predicted from u), {_prf('x', 'split', 9)} select * from rep",
    "roc_auc": f"with {DOCS}, {_SCORE}, k as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from u where label is not null) select round((sum(rk) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2) / (count(*) filter (label = 1) * count(*) filter (label = 0)), 9) as auc from k",
    "logit_decisions": f"with {DOCS}, {_SCORE}, p as (select id, 1 / (1 + exp(-(10 * score - 2))) as p from u) select id, round(p, 6) as probability, cast(p >= 0.5 as int) as predicted from p",
    "rouge1": f"with {DOCS}, {_rouge(1)} select id, round(f1, 9) as f1 from ro",
    "rouge2": f"with {DOCS}, {_rouge(2)} select id, round(f1, 9) as f1 from ro",
    "rouge_l": f"with recursive {DOCS}, {_LCS} select id, round(f1, 9) as f1 from lo",
    "rouge_means": f"""select 'rouge1' as measure, (with {DOCS}, {_rouge(1)} select round(avg(f1), 6) from ro) as f1 union all select 'rouge2', (with {DOCS}, {_rouge(2)} select round(avg(f1), 6) from ro)
        union all select 'rougeL', (with recursive {DOCS}, {_LCS} select round(avg(f1), 6) from lo)""",
    "majority_vote": f"with {_VOTES} select id, count(*) as n, cast(sum(predicted) as bigint) as n_fake, case when sum(predicted) > count(*) / 2 then 'FAKE' else 'REAL' end as verdict from v group by id",
    "model_reports": f"with {_VOTES}, {_prf('v', 'model', 4)} select * from rep",
    "report_unpivot": f"with {_VOTES}, {_prf('v', 'model', 4)} select model, unnest(['precision', 'recall', 'f1', 'miss_rate']) as metric, unnest([precision, recall, f1, miss_rate]) as value from rep",
    "report_pivot": "select cast(ts as date) as day, " + ", ".join(f"round(avg(value) filter (event_type = '{k}'), 6) as {k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
    "smoothed_losses": """with recursive e as (select event_type as run, cast(ts as date) - date '2024-01-01' as epoch, avg(value) as loss from events group by all), o as (select *, row_number() over (partition by run order by epoch) as k from e),
        s as (select run, k, epoch, loss as ema, loss as best, 0 as stale, false as stopped, false as halt from o where k = 1
          union all select o.run, o.k, o.epoch, 0.8::double * ema + 0.2::double * loss, least(best, case when 0.8::double * ema + 0.2::double * loss < best - 0.0001::double then 0.8::double * ema + 0.2::double * loss else best end),
            case when 0.8::double * ema + 0.2::double * loss < best - 0.0001::double then 0 else stale + 1 end, halt, halt or case when 0.8::double * ema + 0.2::double * loss < best - 0.0001::double then 0 else stale + 1 end >= 3
          from s join o on o.run = s.run and o.k = s.k + 1) select run, epoch, round(ema, 6) as ema, stopped from s""",
    "synonyms_replaced": f"""with {DOCS}, w as (select distinct str_split(lower(record.label), ' ')[2] as last, str_split(lower(record.label), ' ')[1] as first from kb_search where record.label is not null and len(str_split(record.label, ' ')) > 1),
        y as (select a.first as word, list_sort(list(distinct b.first)) as syn from w a join w b on a.last = b.last and a.first <> b.first and instr(b.first, '_') = 0 group by 1),
        t as (select id, generate_subscripts(x, 1) - 1 as pos, unnest(x) as token from (select id, list_transform(regexp_extract_all(title || ' ' || text, '[A-Za-z]+'), lambda z: lower(z)) as x from docs)),
        h as (select *, cast('0x' || substr(md5('1|' || id || '|' || pos), 1, 15) as bigint) / 1152921504606846976.0::double as u, cast('0x' || substr(md5('2|' || id || '|' || pos), 1, 15) as bigint) as h from t)
        select id, pos, case when u < 0.5 and token not in ('the', 'and') and len(syn) > 0 then syn[h % len(syn) + 1] else token end as token from h left join y on y.word = token""",
    "coverage_filtered": f"""with recursive {DOCS}, t as (select id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda z: lower(z)) as w from docs),
        c as (select id, w, 0 as i, null::varchar as last, 0 as kept, 0 as again, []::varchar[] as pairs from t
          union all
          select id, w, i + 1, case when fits then tok else last end, kept + fits::int, again, case when kept > 0 then list_append(pairs, last || ' ' || tok) else pairs end
          from (select id, w, i, last, kept, pairs, tok, again + known::int as again, kept = 0 or again + known::int <= 0.05 * kept as fits
            from (select *, w[i + 1] as tok, kept > 0 and list_contains(pairs, last || ' ' || w[i + 1]) as known from c where i < len(w))))
        select id, kept as n_kept from c where i = len(w)""",
    "comment_flags": f"""with am as ({_MENTIONS}), {_CLEAN}, {_LAST}, l as (select am.*, case when coalesce(record.qid, '') <> '' and not {_NM} then record end as rec from am join clean using (mention_id) left join lw on key = lower(clean)),
        k as (select l.*, claims['P31'] as c from l left join kb_claims on kb_claims.qid = rec.qid),
        r as (select *, case when rec is null then {_QUOTED} || ': no Wikidata match found' when not {_FITS} and {_CLASH} then {_QUOTED} || ' (NER: ' || label || ') -> linked to ''' || coalesce(rec.label, rec.qid) || ''' [' || coalesce(rec.description, '(no description)') || '], which does not look like a ' || label end as reason from k),
        o as (select *, count(reason) over (partition by article_no order by pos) as n from r), e as (select *, min(case when rec is not null and n >= 5 then pos end) over (partition by article_no) as stop from o)
        select article_no, pos, text, reason from e where reason is not null and (stop is null or pos <= stop)""",
    "domain_guard": f"with {DOCS}, {LINKED}, e as (select article_no as id, count(distinct qid) as resolved from linked where qid is not null group by 1), t as (select id, len(list_filter(str_split_regex(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '\\s+'), lambda x: x <> '')) as tokens, coalesce(resolved, 0) as resolved from docs left join e using (id)) select id, tokens, resolved, tokens < 50 as too_short, resolved = 0 as no_entities from t",
    "feature_matrix": None,
}
_TEXT_VEC = f"""{_WEIGHTED}, {_VOCAB}, {_TOKEN_VECTORS},
    te as (select id, dim, round(sum(weight * v) / sum(weight), 6) as value from wt join tv using (token) group by id, dim),
    ea as (select distinct article_no as id, qid from linked where regexp_full_match(qid, 'Q[0-9]+')), ev as (select id, embedding from ea left join embeddings on vec_id = cast(substr(qid, 2) as bigint) % 1000),
    ke as (select id, i as dim, round(coalesce(avg(embedding[i + 1]::double), 0), 5) as value from ev, range({DIM}) r(i) group by id, i),
    fm as (select d.id, d.label, 'text' as block, i as dim, coalesce(value, 0) as value from docs d cross join range({TEXT_DIM}) r(i) left join te on te.id = d.id and te.dim = i where d.label is not null
           union all select d.id, d.label, 'kg', i, coalesce(value, 0) from docs d cross join range({DIM}) r(i) left join ke on ke.id = d.id and ke.dim = i where d.label is not null)"""
ORACLE["feature_matrix"] = f"with {LINKED}, {_TEXT_VEC} select * from fm"
ORACLE["ablation_masks"] = f"with {LINKED}, {_TEXT_VEC} select id, round(sum(value), 6) as both, round(sum(value) filter (block = 'text'), 6) as text_only, round(sum(value) filter (block = 'kg'), 6) as ontology_only from fm group by id"
