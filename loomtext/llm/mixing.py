"""Problem 9: mixing sources to target weights.

Efraimidis-Spirakis sampling: each document gets the key -ln(u) / w, with u
from a hash of its id and w its quality weight, and a source is read in order
of the keys. A source's budget is its share of the total; as many complete
epochs as fit come first, then documents in order of their keys while they fit
into the rest. Sources that their repeats hold below their share stop there,
and the report says what is missing.

Prefix sums are taken in levels. Keys are whole numbers of 60 bits; a level
adds up, per source, the tokens of the 4 096 stretches that share the next 12
bits (map-side, one scan), finds the stretch in which the rest ends, and the
next level looks into that stretch only, until it holds at most EDGE_ROWS
documents. These, and up to as many behind them, are read in order in one task
a source. If a document behind them still fits into what is then left, the
stretch that begins with it follows; what is left shrinks under the least
document read, so there are hardly two of these. No task ever holds a source.

The quality weight is fitted to the whole corpus: signals of each document
(tokens a character, shares of letters, capitals, digits, marks, mark-up and
line breaks) are compared with their mean and spread over all documents of its
language, and the weight falls with the distance, so texts unlike the rest of
their language are drawn late.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from . import tokens as K

KEY_BITS, LEVEL_BITS, SEED, EDGE_ROWS = 60, 12, 29, 1 << 16
#: As total_tokens: all tokens of the sources among the targets.
CORPUS = "corpus"
#: Weight of the oddest texts, and the squared distance beyond which a signal counts no more.
LEAST_QUALITY, FARTHEST = 0.05, 25.0


def fitted_quality(rows: DataFrame) -> DataFrame:
    """`rows` with a column quality in place of signals: exp(-d / 2) of the mean squared distance d of the signals from those of their language, in spreads."""
    n = len(K.SIGNALS)
    each = [F.col("signals")[i] for i in range(n)]
    fit = rows.groupBy("lang").agg(F.array(*[F.avg(s) for s in each]).alias("means"), F.array(*[F.stddev_pop(s) for s in each]).alias("spreads"))
    near = F.zip_with(F.zip_with("signals", "means", lambda x, m: x - m), "spreads", lambda d, s: F.least(F.coalesce((d / F.nullif(s, F.lit(0.0))) * (d / s), F.lit(0.0)), F.lit(FARTHEST)))
    mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / n
    out = rows.join(fit.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    return out.withColumn("quality", F.greatest(F.exp(-mean / 2), F.lit(LEAST_QUALITY))).drop("_lang", "means", "spreads", "signals")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, lang_col: str | None = None, quality_col: str | None = None) -> DataFrame:
    """(row, doc_id, source, tokens, key), written once; row numbers the rows, for ids may come again, and key is the place in the order of drawing."""
    lang = F.substring(F.lower(F.trim(F.col(lang_col))), 1, 2) if lang_col in docs.columns else F.lit(None).cast("string")
    own = F.col(quality_col).cast("double") if quality_col else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lower(F.trim(F.col(source_col))).alias("source"), F.col(text_col).alias("text"), lang.alias("lang"), own.alias("own"))
    schema = "doc_id bigint, source string, lang string, own double, tokens bigint, signals array<double>"
    rows = scratch.spread(rows).mapInArrow(K.sizer("text", vocabulary, ("doc_id", "source", "lang", "own"), signals=True), schema)
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "signals")
    rows = rows.withColumn("quality", F.greatest("own", F.lit(LEAST_QUALITY))).drop("signals") if quality_col else fitted_quality(rows)
    return scratch.keep(rows.select("row", "doc_id", "source", "tokens", drawing_key(F.col("doc_id"), F.col("row"), F.coalesce("quality", F.lit(LEAST_QUALITY))).alias("key")), "sized")


def drawing_key(doc_id: Column, row: Column, quality: Column) -> Column:
    """-ln(u) / quality on a rising scale of KEY_BITS bits: 40 bits of it, and 20 of a hash of the row, which part the rows of one id."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 11) + F.lit(1)) / F.lit(float(2**53 + 1))
    key = -F.log(u) / quality
    place = F.least(F.floor(key / (1 + key) * float(1 << 40)).cast("bigint"), F.lit((1 << 40) - 1))
    return F.shiftleft(place, 20).bitwiseOR(F.shiftrightunsigned(F.xxhash64(row, F.lit(SEED)), 44))


def budgets(per_source: DataFrame, targets: DataFrame, total_tokens: int | str | None) -> DataFrame:
    """(source, target_share, max_repeats, tokens, wanted, budget, epochs, rest) of every target source.

    Without total_tokens the total is the largest that every source with
    documents can fill at its share within its repeats; with CORPUS it is the
    tokens of all target sources. A source whose repeats end below its share of
    the total (`wanted`) stops there.
    """
    t = targets.select(F.lower(F.trim("source_name")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    per = t.join(per_source, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    if total_tokens is None:
        most = per.where("tokens > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0]
        total_tokens = int(most or 0)
    elif total_tokens == CORPUS:
        total_tokens = int(per.agg(F.sum("tokens")).first()[0] or 0)
    per = per.withColumn("wanted", F.col("target_share") * F.lit(float(total_tokens)))
    per = per.withColumn("budget", F.least(F.col("wanted"), F.col("tokens") * F.col("max_repeats").cast("double")))
    per = per.withColumn("epochs", F.least(F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))), F.col("max_repeats").cast("bigint")))
    return per.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0.0))


def edges(items: DataFrame, per: DataFrame, edge_rows: int) -> DataFrame:
    """(source, epochs, lo, hi, left): per source with a rest the stretch of keys lo to hi, hi exclusive, in which it ends, and what is left of it there.

    One scan and one small table a level; a level multiplies the number of
    documents that can be told apart by 4 096, so there are hardly two.
    """
    at = per.where("rest > 0").select("source", "epochs", F.col("rest").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    shift = KEY_BITS
    while True:
        inside = items.join(F.broadcast(at.select("source", "prefix")), "source").where(F.shiftright("key", shift) == F.col("prefix"))  # one row a target source
        shift -= LEVEL_BITS
        bins = inside.groupBy("source", F.shiftright("key", shift).alias("bin")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        w = Window.partitionBy("source").orderBy("bin")  # at most 4 096 rows a source
        sums = bins.withColumn("through", F.sum("tokens").over(w)).withColumn("passed", F.sum("n").over(w)).join(at.select("source", "epochs", "left"), "source")
        first = sums.where(F.col("through") >= F.col("left")).groupBy("source").agg(F.min(F.struct("bin", (F.col("left") - F.col("through") + F.col("tokens")).alias("left"), "n", "passed")).alias("e"))
        ahead = sums.join(first, "source").where(F.col("passed") > F.col("e.passed") + edge_rows).groupBy("source").agg(F.min("bin").alias("until"))
        found = at.select("source", "epochs").join(first, "source").join(ahead, "source", "left")
        whole = F.shiftleft(F.shiftright("e.bin", LEVEL_BITS) + 1, LEVEL_BITS)  # the end of the stretch of the level before
        end = F.coalesce(F.when(F.col("until") > F.col("e.bin"), F.col("until")), whole)
        at = scratch.keep(found.select("source", "epochs", F.col("e.left").alias("left"), F.col("e.bin").alias("prefix"), end.alias("end"), F.col("e.n").alias("n")), "edges")
        most = at.agg(F.max("n")).first()[0]
        if most is None or most <= edge_rows or shift == 0:
            return at.select("source", "epochs", F.shiftleft("prefix", shift).alias("lo"), F.shiftleft("end", shift).alias("hi"), "left")


def _fill(t: pa.Table) -> pa.Table:
    """Documents of a stretch in order of their keys, taken while they fit into what is left."""
    order = np.lexsort((t["row"].to_numpy(), t["key"].to_numpy()))
    tokens = t["tokens"].to_numpy()
    left = t["left"][0].as_py()
    more = np.zeros(len(tokens), np.int64)
    for i in order.tolist():
        if tokens[i] <= left:
            more[i] = 1
            left -= tokens[i]
    return pa.table({"doc_id": t["doc_id"], "source": t["source"], "tokens": t["tokens"], "uses": pa.array(t["epochs"].to_numpy() + more), "more": pa.array(more)})


def fractions(items: DataFrame, per: DataFrame, edge_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables, stretches): the documents read in order with their uses, and per source the stretches (lo, hi) of keys they cover; the first begins where the prefix that fits as a whole ends."""
    spark = items.sparkSession
    at = {r["source"]: r.asDict() for r in edges(items, per, edge_rows).collect()}  # one row a target source
    widths = {s: r["hi"] - r["lo"] for s, r in at.items()}
    tables, stretches = [], []
    while at:
        now = spark.createDataFrame([(s, r["epochs"], r["lo"], r["hi"], float(r["left"])) for s, r in at.items()], "source string, epochs bigint, lo bigint, hi bigint, left double")
        stretches.append(now.select("source", "lo", "hi"))
        inside = items.join(F.broadcast(now), "source").where("key >= lo and key < hi")
        done = scratch.keep(inside.groupBy("source").applyInArrow(_fill, "doc_id bigint, source string, tokens bigint, uses bigint, more bigint"), "filled")
        tables.append(done.drop("more"))
        took = {r[0]: r[1] for r in done.groupBy("source").agg(F.sum(F.col("tokens") * F.col("more"))).collect()}
        rest = [(s, r["epochs"], r["hi"], r["left"] - (took.get(s) or 0)) for s, r in at.items() if r["hi"] < 1 << KEY_BITS]
        if not rest:
            break
        open_ends = spark.createDataFrame(rest, "source string, epochs bigint, hi bigint, left double")
        fits = items.join(F.broadcast(open_ends), "source").where("key >= hi and tokens > 0 and tokens <= left").groupBy("source", "epochs", "left").agg(F.min("key").alias("lo")).collect()
        at = {r["source"]: r.asDict() | {"hi": min(1 << KEY_BITS, r["lo"] + widths[r["source"]])} for r in fits}
    if not stretches:
        return [], spark.createDataFrame([], "source string, spans array<struct<lo: bigint, hi: bigint>>, first bigint")
    every = stretches[0]
    for more in stretches[1:]:
        every = every.union(more)
    return tables, every.groupBy("source").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"), F.min("lo").alias("first"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = K.VOCABULARY, lang_col: str | None = None, quality_col: str | None = None, edge_rows: int = EDGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(uses, plan): uses has (doc_id, source, tokens, uses) of every document.

    Documents whose source is null or not among the targets have 0 uses.
    Sources are compared trimmed and lower-cased; targets without a positive
    share and repeats are ignored, one without documents stays empty and shows
    in the report. Null and empty texts have 0 tokens. Equal keys go by row.
    Rows of one id count each. With quality_col the weights come from that
    column, null and small ones as LEAST_QUALITY, else they are fitted to the
    documents of each lang_col, a null language being one of its own, or where
    there is no such column to all documents. Other columns are ignored. Empty tables give an empty
    result. No source gets more than its budget, and no document that its last
    epoch leaves out would fit into what is missing.
    """
    items = sized(docs, id_col, text_col, source_col, vocabulary, lang_col, quality_col)
    per = scratch.keep(budgets(items.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets, total_tokens), "plan")
    tables, spans = fractions(items, per, edge_rows)
    small = F.broadcast(per.select("source", "epochs").join(spans, "source", "left"))  # one row per target source
    rows = items.join(small, "source", "left")
    read = F.coalesce(F.exists("spans", lambda x: (F.col("key") >= x["lo"]) & (F.col("key") < x["hi"])), F.lit(False))
    more = F.when(F.col("key") < F.col("first"), 1).otherwise(0)
    out = rows.where(~read).select("doc_id", "source", "tokens", F.coalesce(F.col("epochs") + more, F.lit(0)).alias("uses"))
    for t in tables:
        out = out.union(t)
    return out, per


def share_report(uses: DataFrame, per: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, max_repeats, most_uses, n_used, tokens_used, tokens_there, tokens_short) of every target source; tokens_short is what its repeats leave of its share of the total."""
    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"), F.count(F.when(F.col("uses") > 0, 1)).alias("n_used"))
    out = per.join(got, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
    whole = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # one row per target source
    return out.select(
        "source", "target_share", (F.col("tokens_used") / F.greatest(whole, F.lit(1))).alias("actual_share"), "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("n_used", F.lit(0)).alias("n_used"),
        "tokens_used", F.col("tokens").alias("tokens_there"), F.greatest(F.col("wanted") - F.col("budget"), F.lit(0.0)).alias("tokens_short"),
    )


def checks(uses: DataFrame, per: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, within_repeats, epochs_whole, within_budget, filled, short_at_cap) of every target source.

    within_repeats: no document is used more than max_repeats times.
    epochs_whole: uses of any two documents differ by one at most.
    within_budget: the tokens used do not pass the budget. filled: no document
    that the last epoch leaves out would fit into what is missing of it.
    short_at_cap: a source gets less than its share of the total only where
    each of its documents is used max_repeats times.
    """
    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most"), F.min("uses").alias("least"))
    base = per.join(got, "source", "left").na.fill({"used": 0, "most": 0, "least": 0})
    left = F.col("budget") - F.col("used")
    fits = uses.join(F.broadcast(base.select("source", "epochs", left.alias("left"))), "source").where("uses <= epochs and tokens > 0 and tokens <= left")  # one row per target source
    out = base.join(fits.groupBy("source").agg(F.count("*").alias("n_fit")), "source", "left")
    filled = F.col("n_fit").isNull() | (F.col("epochs") == F.col("max_repeats"))
    short = (F.col("wanted") <= F.col("budget") + 1e-6) | (F.col("tokens") == 0) | (F.col("least") == F.col("max_repeats"))
    return out.select(
        "source", "target_share", "max_repeats", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.col("most") - F.col("least") <= 1).alias("epochs_whole"), (left >= -1e-6).alias("within_budget"),
        filled.alias("filled"), short.alias("short_at_cap"),
    )
