"""Article knowledge graphs, class chains and vectors of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60

MEMBER_OF = "MEMBER_OF"


def article_triples(linked: DataFrame, claim_rows: DataFrame, crossview: DataFrame) -> DataFrame:
    """(article_no, link_id, h, r, t): per resolved mention its entity's claims and its class; repeated mentions repeat their triples."""
    rows = linked.where("qid is not null").select("article_no", "link_id", "qid")
    facts = claim_rows.select("qid", F.col("property").alias("r"), F.col("value").alias("t"))
    classes = crossview.select("qid", F.lit(MEMBER_OF).alias("r"), F.col("class_path").alias("t"))
    return rows.join(facts.unionByName(classes), "qid").select("article_no", "link_id", F.col("qid").alias("h"), "r", "t")


def article_entities(linked: DataFrame) -> DataFrame:
    """(article_no, pos, qid): different entities of each article in order of first mention."""
    from pyspark.sql import Window

    first = linked.where("qid is not null").groupBy("article_no", "qid").agg(F.min("link_id").alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("article_no").orderBy("first"))).select("article_no", "pos", "qid")


def _next(claims: Column, visited: list[Column]) -> Column:
    """First class not visited among P31, then P279."""
    fresh = lambda p: F.get(F.filter(claims[p], lambda v: v.startswith("Q") & ~F.array_contains(F.array(*visited), v)), 0)
    return F.coalesce(fresh("P31"), fresh("P279"))


def class_chains(claims: DataFrame) -> DataFrame:
    """(qid, c1, c2, c3): up to three classes reached from each entity by P31, else P279, never back; nulls once the chain ends. Three left joins, no recursion."""
    side = claims.select(F.col("qid").alias("_at"), F.col("claims").alias("_claims"))
    none = F.lit("")
    out = claims.select("qid", _next(F.col("claims"), [F.col("qid")]).alias("c1"))
    for i in (2, 3):
        visited = [F.col("qid"), *[F.coalesce(f"c{j}", none) for j in range(1, i)]]
        out = out.join(side, F.col(f"c{i - 1}") == F.col("_at"), "left").withColumn(f"c{i}", _next(F.col("_claims"), visited)).drop("_at", "_claims")
    return out


def crossview_of(chains: DataFrame, top: str = "MISC") -> DataFrame:
    """(qid, class_path): top level and first two classes, dotted."""
    return chains.select("qid", F.concat_ws(".", F.lit(top), "c1", "c2").alias("class_path"))


def ontology_nodes(chains: DataFrame, claims: DataFrame, top: str = "MISC") -> DataFrame:
    """(path, level, parent, attributes): every prefix of every class path, with the sorted properties of the entities whose path ends there."""
    full = F.filter(F.array(F.lit(top), "c1", "c2", "c3"), lambda c: c.isNotNull())
    paths = chains.select("qid", full.alias("p"))
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", 1, i))).alias("p")).distinct()
    own = paths.join(claims.select("qid", F.explode(F.map_keys("claims")).alias("property")), "qid").groupBy("p").agg(F.array_join(F.array_sort(F.collect_set("property")), ",").alias("attributes"))
    joined = nodes.join(own, "p", "left")
    parent = F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "."))
    return joined.select(F.array_join("p", ".").alias("path"), F.size("p").alias("level"), parent.alias("parent"), F.coalesce("attributes", F.lit("")).alias("attributes"))


def all_classes(nodes: DataFrame) -> DataFrame:
    """(path, level) of the classes of levels 1 to 3."""
    return nodes.where("level between 1 and 3").select("path", "level")


def find_nodes(nodes: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, level, attributes) of the nodes at dotted paths; paths the ontology lacks give no row."""
    return paths.select(F.col(path).alias("_p")).join(nodes, F.col("_p") == F.col("path")).select(F.col("_p").alias(path), "level", "attributes")


def nested(nodes: DataFrame, depth: int = 4) -> DataFrame:
    """(json): (path, level, parent, attributes) as one nested object of name to level, parent, attributes and children.

    Built from the deepest level up, one aggregation a level; for ontologies that fit one row.
    """
    name = F.element_at(F.split("path", r"\."), -1)
    below = None
    for level in range(depth, 0, -1):
        here = nodes.where(F.col("level") == level)
        here = here.join(below, "path", "left") if below is not None else here.withColumn("children", F.lit(None).cast("string"))
        attributes = F.to_json(F.filter(F.split("attributes", ","), lambda x: x != ""))
        parent = F.coalesce(F.to_json(F.array("parent")), F.lit("[null]"))
        body = F.concat(F.lit('{"name":'), _quoted(name), F.lit(f',"level":{level},"parent":'), F.substring(parent, F.lit(2), F.length(parent) - 2), F.lit(',"attributes":'), attributes, F.lit(',"children":{'), F.coalesce("children", F.lit("")), F.lit("}}"))
        entries = here.select(F.coalesce("parent", F.lit("")).alias("path"), F.struct(name.alias("name"), F.concat(_quoted(name), F.lit(":"), body).alias("entry")).alias("e"))
        below = entries.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("e"))["entry"], ",").alias("children"))
    return below.select(F.concat(F.lit("{"), "children", F.lit("}")).alias("json"))


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(node, near, within_two): different neighbours, and nodes at most two undirected edges away, from edges (a, b)."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    two = both.select("a", F.col("b").alias("m")).join(both.select(F.col("a").alias("m"), "b"), "m").where("a <> b").select("a", "b")
    near = both.groupBy("a").agg(F.count("*").alias("near"))
    return near.join(both.union(two).distinct().groupBy("a").agg(F.count("*").alias("within_two")), "a").withColumnRenamed("a", "node")


def centroids(vectors: DataFrame, dim: int, key: str = "label", vec: str = "embedding") -> DataFrame:
    """(key, n, c): mean vector of each class; one partial row per class and task is shuffled."""
    means = vectors.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(F.col(vec)[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    return means.select(key, "n", F.array(*[f"m{i}" for i in range(dim)]).alias("c"))


def refine(vectors: DataFrame, dim: int, weight: float = 0.1, rounds: int = 5, key: str = "label", vec: str = "embedding") -> DataFrame:
    """`vectors` drawn towards their class centroid, `rounds` times by `weight`.

    A round leaves the centroid in place, so the rounds have a closed form and
    the centroids are computed once.
    """
    keep = (1 - weight) ** rounds
    c = centroids(vectors, dim, key, vec).select(key, "c")
    moved = F.zip_with(vec, "c", lambda v, m: m + keep * (v.cast("double") - m))
    return vectors.join(c, key).withColumn(vec, moved).drop("c")


def membership_loss(vectors: DataFrame, dim: int, key: str = "label", vec: str = "embedding") -> DataFrame:
    """One row: mean over classes of the mean squared distance to the class centroid."""
    c = centroids(vectors, dim, key, vec)
    sq = F.aggregate(F.zip_with(vec, "c", lambda v, m: (v.cast("double") - m) * (v.cast("double") - m)), F.lit(0.0), lambda s, x: s + x)
    return vectors.join(c, key).groupBy(key).agg(F.avg(sq).alias("l")).agg(F.avg("l").alias("loss"))


def mean_vectors(entities: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, dim, value): mean vector of each article's entities, entities without a vector skipped, zeros where none is left; from (id, key) and (key, vec)."""
    joined = entities.join(vectors, "key", "left")
    means = joined.groupBy("id").agg(*[F.coalesce(F.avg(F.col("vec")[i].cast("double")), F.lit(0.0)).alias(f"m{i}") for i in range(dim)])
    return means.select("id", F.posexplode(F.array(*[f"m{i}" for i in range(dim)])).alias("dim", "value"))


def weighted_mean_vectors(entities: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, dim, value): mean of each article's entity vectors weighted by count times given weight, from (id, key, count, given) and (key, vec). Entities without a vector or with a zero one are skipped, zeros where none is left; a null given weight is 1."""
    joined = entities.join(vectors, "key", "left")
    useful = F.exists("vec", lambda x: x != 0)
    w = F.when(useful, F.col("count") * F.coalesce("given", F.lit(1.0)))
    sums = joined.withColumn("_w", w).groupBy("id").agg(F.sum("_w").alias("_t"), *[F.sum(F.col("_w") * F.col("vec")[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    values = F.array(*[F.when(F.col("_t") != 0, F.col(f"m{i}") / F.col("_t")).otherwise(0.0) for i in range(dim)])
    return sums.select("id", F.posexplode(values).alias("dim", "value"))


def hashed_vector(key: Column, dim: int, seed: int = 500) -> Column:
    return F.array(*[2 * (hash60(seed + i, key) / F.lit(float(1 << 60))) - 1 for i in range(dim)])


def translation_score(h: Column, r: Column, t: Column) -> Column:
    """Length of head + relation - tail."""
    gap = F.zip_with(F.zip_with(h, r, lambda a, b: a + b), t, lambda s, c: s - c)
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def corrupted_tails(triples: DataFrame, entities: DataFrame, seed: int = 7) -> DataFrame:
    """`triples` (h, r, t) with a tail drawn by hash from the numbered entities (ordinal, entity)."""
    n = entities.count()
    draw = F.pmod(hash60(seed, F.concat_ws("|", "h", "r", "t")), F.lit(max(1, n)))
    return triples.withColumn("_d", draw).join(entities.select(F.col("ordinal").alias("_d"), F.col("entity").alias("negative")), "_d").drop("_d")
