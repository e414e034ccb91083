"""The knowledge-base cache: last write wins, linking, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Relations kept when an article's knowledge graph is built.
TOP_RELATIONS = ("P31", "P279", "P17", "P569", "P570", "P27", "P19", "P106", "P159")
#: Per label, the parts of a description that fit it.
DESCRIPTION_WORDS = {
    "PERSON": (
        "person", "human", "politician", "actor", "actress", "singer", "musician", "writer", "author", "poet", "artist", "athlete", "scientist",
        "physicist", "chemist", "biologist", "mathematician", "philosopher", "engineer", "businessman", "businessperson", "businesswoman",
        "journalist", "soldier", "general", "officer", "president", "senator", "monarch", "king", "queen", "prince", "princess", "founding father",
        "designer", "upholsterer", "seamstress", "minister", "diplomat", "lawyer", "judge", "doctor", "physician", "nurse", "teacher", "professor",
        "director", "producer", "composer", "painter", "sculptor",
    ),
    "ORG": (
        "organization", "organisation", "company", "corporation", "agency", "institute", "institution", "association", "society", "party",
        "department", "ministry", "club", "non-profit", "nonprofit", "team", "council", "committee", "school", "university", "college", "consortium",
        "alliance", "headquarters", "building", "office", "bureau", "service", "force", "army", "navy", "air force", "coalition", "union",
        "federation",
    ),
    "GPE": (
        "country", "city", "town", "village", "state", "province", "capital", "republic", "kingdom", "municipality", "county", "district", "borough",
        "settlement", "metropolis", "commonwealth", "territory", "nation", "sovereign",
    ),
    "LOC": (
        "mountain", "river", "lake", "ocean", "sea", "island", "continent", "forest", "desert", "valley", "peninsula", "bay", "gulf", "strait",
        "region", "area", "plateau", "archipelago", "reef",
    ),
    "FAC": (
        "building", "structure", "airport", "stadium", "bridge", "tunnel", "monument", "museum", "library", "hospital", "facility", "tower",
        "skyscraper", "fort", "fortress", "headquarters", "complex", "plaza",
    ),
    "EVENT": (
        "war", "battle", "event", "summit", "competition", "conference", "festival", "election", "olympics", "championship", "tournament",
        "ceremony", "anniversary", "revolution",
    ),
    "PRODUCT": (
        "product", "vehicle", "device", "model", "software", "weapon", "aircraft", "ship", "car", "smartphone",
    ),
    "WORK_OF_ART": (
        "film", "movie", "novel", "song", "album", "book", "painting", "play", "tv series", "drama", "sculpture", "documentary",
    ),
    "LAW": (
        "law", "act", "amendment", "treaty", "constitution", "convention", "statute", "code", "regulation",
    ),
}
#: Per label, the classes that an entity's P31 is expected to name.
EXPECTED_CLASSES = {
    "PERSON": (
        "Q5", "Q15632617",
    ),
    "ORG": (
        "Q43229", "Q4830453", "Q783794", "Q22865", "Q327333", "Q1530705", "Q2659904", "Q163740", "Q484652", "Q748019", "Q7210356", "Q11691",
        "Q11032", "Q15265344", "Q3918", "Q9826", "Q1664720", "Q31855", "Q294163", "Q15911314", "Q7188",
    ),
    "GPE": (
        "Q6256", "Q515", "Q3624078", "Q3957", "Q56061", "Q1093829", "Q35657", "Q1549591", "Q5119", "Q486972", "Q852446", "Q1352230",
    ),
    "LOC": (
        "Q17334923", "Q35145263",
    ),
    "EVENT": (
        "Q1656682", "Q198", "Q178561",
    ),
    "WORK_OF_ART": (
        "Q838948", "Q11424", "Q7725634",
    ),
    "PRODUCT": (
        "Q2424752",
    ),
}


def last_writes(search: DataFrame) -> DataFrame:
    """(key, mention, record): per lower-cased mention the line written last; null mentions are left out. A struct maximum, combined map-side."""
    last = F.max(F.struct("line_no", "mention", "record"))
    return search.where("mention is not null").groupBy(F.lower("mention").alias("key")).agg(last.alias("w")).select("key", "w.mention", "w.record")


def is_resolved(record: Column) -> Column:
    return F.coalesce(record["qid"], F.lit("")) != ""


def is_no_match(record: Column) -> Column:
    return F.coalesce(record["_no_match"], F.lit(False))


def cache_stats(search: DataFrame) -> DataFrame:
    """One row: entries after last write wins, resolved, known to have no match, and empty ones of old."""
    r = last_writes(search)
    rec = F.col("record")
    count = lambda c: F.count(F.when(c, 1))
    return r.agg(F.count("*").alias("total"), count(is_resolved(rec)).alias("resolved"), count(is_no_match(rec)).alias("no_match"), count(~is_resolved(rec) & ~is_no_match(rec)).alias("empty"))


def valid_entries(search: DataFrame) -> DataFrame:
    """Entries worth keeping: resolved or known to have no match."""
    return last_writes(search).where(is_resolved(F.col("record")) | is_no_match(F.col("record")))


def link(mentions: DataFrame, search: DataFrame, text: str = "text") -> DataFrame:
    """`mentions` with cache_hit, qid, entity_label, description, score of the cache entry of the cleaned mention; misses and no-match entries have a null qid."""
    cache = last_writes(search).select(F.col("key").alias("_key"), "record")
    joined = mentions.withColumn("_key", F.lower(X.clean_mention(F.col(text)))).join(cache, "_key", "left").drop("_key")
    return _entity(joined)


def link_prioritised(mentions: DataFrame, search: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """As link, but an entry under LABEL|mention goes before the plain one; `trusted` says whether the entry used was qualified or its description fits the label."""
    cache = last_writes(search)
    clean = X.clean_mention(F.col(text))
    rows = mentions.withColumn("_bare", F.lower(clean)).withColumn("_full", F.lower(F.concat(F.coalesce(label, F.lit("")), F.lit("|"), clean)))
    bare = cache.select(F.col("key").alias("_bare"), F.col("record").alias("_b"))
    full = cache.select(F.col("key").alias("_full"), F.col("record").alias("_f"))
    joined = rows.join(full, "_full", "left").join(bare, "_bare", "left").drop("_full", "_bare")
    joined = joined.withColumn("record", F.coalesce("_f", "_b")).withColumn("trusted", F.col("_f").isNotNull() | description_fits(F.col("_b"), F.col(label))).drop("_f", "_b")
    return _entity(joined)


def _entity(joined: DataFrame) -> DataFrame:
    known = is_resolved(F.col("record")) & ~is_no_match(F.col("record"))
    pick = lambda f: F.when(known, F.col(f"record.{f}"))
    return joined.withColumns({"cache_hit": F.col("record").isNotNull(), "qid": pick("qid"), "entity_label": pick("label"), "description": pick("description"), "score": F.when(known, F.coalesce("record.score", F.lit(0.0)))}).drop("record")


def description_fits(record: Column, label: Column) -> Column:
    """Whether a record's description holds a word of its label: false without record or for no-match, true for labels without words, false for an empty description."""
    desc = F.lower(F.coalesce(record["description"], F.lit("")))
    fits = F.lit(True)
    for name, words in DESCRIPTION_WORDS.items():
        fits = F.when(label == name, desc.rlike("|".join(words))).otherwise(fits)
    return F.when(record.isNull() | is_no_match(record), False).otherwise(fits)


def class_mismatch(record: Column, classes: Column, label: Column) -> Column:
    """Whether an entity's kind clearly disagrees with the label: neither its description nor any of its classes fits."""
    clash = F.lit(False)
    for name, expected in EXPECTED_CLASSES.items():
        known = F.size(F.coalesce(classes, F.array().cast("array<string>"))) > 0
        clash = F.when(label == name, known & ~F.arrays_overlap(classes, F.array(*[F.lit(x) for x in expected]))).otherwise(clash)
    return ~description_fits(record, label) & clash


def claim_rows(claims: DataFrame, keep: tuple[str, ...] | None = None, most: int = 5) -> DataFrame:
    """(qid, property, at, value): the claims one value a row, at most `most` values a property, of the properties in `keep`."""
    rows = claims.select("qid", F.explode("claims").alias("property", "values"))
    if keep is not None:
        rows = rows.where(F.col("property").isin(*keep))
    return rows.select("qid", "property", F.posexplode(F.slice("values", 1, most)).alias("at", "value")).where("value is not null")


def flatten_claims(payload: Column, most: int = 5) -> Column:
    """Claims of an entity as fetched (JSON text) to map<property, array<string>>: id, text or time values in order, others dropped, at most `most`, empty properties left out."""
    parsed = F.from_json(payload, "claims map<string, array<struct<mainsnak: struct<datavalue: struct<value: string>>>>>")["claims"]

    def text(snak: Column) -> Column:
        v = snak["mainsnak"]["datavalue"]["value"]
        return F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.id"), F.get_json_object(v, "$.time"))).otherwise(v)

    values = F.transform_values(parsed, lambda _, xs: F.slice(F.filter(F.transform(xs, text), lambda x: x.isNotNull()), 1, most))
    return F.map_filter(values, lambda _, xs: F.size(xs) > 0)


def best_candidate(candidates: Column, label: Column) -> Column:
    """First record of the array whose description fits the label, else the first."""
    return F.coalesce(F.get(F.filter(candidates, lambda r: description_fits(r, label)), 0), F.get(candidates, 0))
