"""Attribute-value rows into wide tables by positional stitching.

1. Values are read in the JVM. Of the rows of one (entity, property) in an
   Arrow batch only the readable one of the highest row number goes on, so an
   entity or a property that holds a third of all rows is reduced before it is
   shuffled.
2. Entities get dense global ordinals: one shuffle by entity, sorted inside
   the task, where the winner of each cell is the first row; entities are
   numbered within their partition and written; the offset of a partition is
   the prefix sum of the partitions before it.
3. Ordinals are cut into ranges. All cells of a range meet in one task, where
   each property is laid out as one typed vector aligned to the range, with
   nulls at the positions of entities that lack it.
4. The vectors of a range are put side by side by position. No join on the
   entity, no pivot and no per-entity map takes part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

DATES = ("P569", "P570", "P571")
WHOLE = ("P1082", "P1128")
#: Marks and words that stand for a missing value, lower-cased.
NO_VALUE = ("", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "?", "-", "--", "–", "—", "...", "tbd", "missing", "undefined", "no value", "not available", "not known")
BLANK = r"[ \t\r\n\u000b\u000c ]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def normal_qid(c: Column) -> Column:
    """Blanks cut, upper case, a leading WD: removed; null where nothing is left."""
    out = F.regexp_replace(F.upper(_trim(c)), "^WD:", "")
    return F.when(out != "", out)


def normal_property(c: Column) -> Column:
    out = F.regexp_replace(F.upper(_trim(c)), "^WDT:", "")
    return F.when(out != "", out)


#: Names of the months, written out, as `sept` or as their first three letters or more.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_ISO = r"\+?(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:t\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:z|[+-]\d{2}:?\d{2})?)?"
_DOTTED = r"(\d{1,2})\. ?(\d{1,2})\. ?(\d{4})"
_DAY_FIRST = r"(\d{1,2})(?:st|nd|rd|th)?\.? ([a-z]{3,9})\.?,? (\d{4})"
_MONTH_FIRST = r"([a-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})"


def collapsed(c: Column) -> Column:
    """Runs of blanks as one, ends cut."""
    return F.regexp_replace(_trim(c), f"{BLANK}+", " ")


def date_parts(text: Column) -> Column:
    """[mark, year, month, day] as written in a collapsed text; another array where it is no date.

    One pass of one pattern, in which the groups of the forms that do not match
    are empty. The mark is a line break, which no collapsed text has.
    """
    whole = f"^(?:{_ISO}|{_DOTTED}|{_DAY_FIRST}|{_MONTH_FIRST})$"
    return F.split(F.regexp_replace(F.lower(text), whole, "\n-$1$6$9$12-$2$5$8$10-$3$4$7$11"), "-")


def date_of(parts: Column) -> Column:
    """yyyy-mm-dd of date parts, null where there is no such day."""
    numbers = {f"{i:0{w}}": i for i in range(1, 13) for w in (1, 2)}
    names = {m[:k]: i for i, m in enumerate(MONTHS, 1) for k in range(3, len(m) + 1)}
    months = F.create_map(*[F.lit(x) for name, i in (numbers | names).items() for x in (name, f"{i:02}")])
    dash = F.lit("-")
    made = F.concat(F.get(parts, 1), dash, F.try_element_at(months, F.get(parts, 2)), dash, F.lpad(F.get(parts, 3), 2, "0"))
    return F.when((F.size(parts) == 4) & (F.get(parts, 0) == "\n"), made.try_cast("date").cast("string"))


def read_date(c: Column) -> Column:
    """yyyy-mm-dd where day, month and year are all given and exist; dotted dates are day first."""
    return date_of(date_parts(collapsed(c)))


def plain_number(text: Column) -> Column:
    """A written number without grouping marks, as decimal; null where it is none."""
    mark = "[ ,'_\u00a0\u2009\u202f]"
    grouped = rf"^[+-]?\d{{1,3}}(?:{mark}\d{{3}})+(?:\.0+)?$"
    dots = r"^[+-]?\d{1,3}(?:\.\d{3}){2,}$"
    plain = r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d{1,2})?$"
    digits = F.when(text.rlike(plain), text).when(text.rlike(grouped), F.regexp_replace(text, mark, "")).when(text.rlike(dots), F.regexp_replace(text, r"\.", ""))
    return digits.try_cast("decimal(38,10)")


def whole_of(number: Column) -> Column:
    """Plain digits of a decimal that is a whole number and fits bigint."""
    return F.when(number == F.floor(number), number.try_cast("bigint").cast("string"))


def read_whole(c: Column) -> Column:
    """Plain digits of one exact whole number that fits bigint; grouping marks, sign, exponent and .0 allowed."""
    return whole_of(plain_number(_trim(c)))


def text_of(text: Column) -> Column:
    return F.when(text.rlike("^(?i:wd:)?[qQ][0-9]+$"), normal_qid(text)).otherwise(F.when(text != "", text))


def read_text(c: Column) -> Column:
    return text_of(collapsed(c))


def read_cells(triples: DataFrame, dates: Sequence[str] = DATES, whole: Sequence[str] = WHOLE) -> DataFrame:
    """(e, p, v, no): every row, normalised, v null where it is not readable.

    Steps that are used more than once are columns of a projection of their
    own, so each is evaluated once and the generated code stays short.
    """
    t = triples.select(normal_qid(F.col("e")).alias("e"), normal_property(F.col("p")).alias("p"), collapsed(F.col("v")).alias("t"), F.coalesce(F.col("triple_no").cast("bigint"), F.lit(-(2**63))).alias("no"))
    t = t.withColumn("kind", F.when(F.lower("t").isin(*NO_VALUE), 0).when(F.col("p").isin(*dates), 1).when(F.col("p").isin(*whole), 2).otherwise(3))
    t = t.select("e", "p", "no", "t", "kind", F.when(F.col("kind") == 1, date_parts(F.col("t"))).alias("parts"), F.when(F.col("kind") == 2, plain_number(F.col("t"))).alias("number"))
    value = F.when(F.col("kind") == 1, date_of(F.col("parts"))).when(F.col("kind") == 2, whole_of(F.col("number"))).when(F.col("kind") == 3, text_of(F.col("t")))
    return t.select("e", "p", value.alias("v"), "no")


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch with one (entity, property) the readable one of the highest number, ties by the greater value; rows without entity or property are dropped."""
    for b in batches:
        b = b.filter(pc.and_(pc.is_valid(b.column("e")), pc.is_valid(b.column("p"))))
        if not b.num_rows:
            continue
        e, p = (b.column(c).dictionary_encode() for c in ("e", "p"))
        cell = e.indices.to_numpy().astype(np.int64) * len(p.dictionary) + p.indices.to_numpy()
        keys = pa.table({"cell": cell, "none": pc.is_null(b.column("v")), "no": b.column("no"), "v": b.column("v")})
        order = pc.sort_indices(keys, sort_keys=[("cell", "ascending"), ("none", "ascending"), ("no", "descending"), ("v", "descending")]).to_numpy()
        first = np.ones(len(order), bool)
        first[1:] = cell[order[1:]] != cell[order[:-1]]
        yield b.take(pa.array(order[first]))


def _changes(a: pa.Array, before: str | None) -> np.ndarray:
    """Whether each value of a sorted array differs from the one before it."""
    new = np.ones(len(a), bool)
    new[1:] = pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
    new[0] = a[0].as_py() != before
    return new


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each cell of one sorted partition, its entities numbered from 0."""
    part, last_e, last_p, at = TaskContext.get().partitionId(), None, None, -1
    for b in batches:
        if not b.num_rows:
            continue
        e, p = b.column("e"), b.column("p")
        new_e = _changes(e, last_e)
        first = new_e | _changes(p, last_p)
        local = at + np.cumsum(new_e)
        at, last_e, last_p = int(local[-1]), e[len(e) - 1].as_py(), p[len(p) - 1].as_py()
        out = pa.RecordBatch.from_arrays([e, p, b.column("v"), pa.array(np.full(len(e), part, np.int32)), pa.array(local)], ["e", "p", "v", "part", "local"])
        yield out.filter(pa.array(first))


def _assembler(properties: list[str], names: list[str], kinds: list[str], width: int):
    """A function that lays out the cells of each ordinal range as aligned typed vectors."""
    types = {"date": pa.date32(), "bigint": pa.int64(), "string": pa.string()}

    def layout(cells: pa.Table) -> pa.RecordBatch:
        at = cells.column("ordinal").to_numpy() % width
        size = int(at.max()) + 1
        p, v = cells.column("p").combine_chunks(), cells.column("v").combine_chunks()
        p = p if pa.types.is_dictionary(p.type) else p.dictionary_encode()
        code = p.indices.to_numpy()
        known = {x: i for i, x in enumerate(p.dictionary.to_pylist())}
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(known) + 1))

        def aligned(values: pa.Array, where: np.ndarray, rows: np.ndarray) -> pa.Array:
            slot = np.full(size, -1, np.int64)
            slot[where] = rows
            return values.take(pa.array(slot, mask=slot < 0))

        columns = [aligned(cells.column("e").combine_chunks(), at, np.arange(len(at)))]
        for prop, kind in zip(properties, kinds):
            if prop not in known:
                columns.append(pa.nulls(size, types[kind]))
                continue
            rows = order[bounds[known[prop]] : bounds[known[prop] + 1]]
            typed = v.take(pa.array(rows)).cast(types[kind])
            columns.append(aligned(typed, at[rows], np.arange(len(rows))))
        return pa.RecordBatch.from_arrays(columns, names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            block = b.column("ordinal").to_numpy() // width
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if now is not None and block[lo] != now:
                    yield layout(pa.Table.from_batches(held))
                    held = []
                now = block[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield layout(pa.Table.from_batches(held))

    return assemble


def wide_table(triples: DataFrame, dates: Sequence[str] = DATES, whole: Sequence[str] = WHOLE, max_columns: int = 5000, cells_per_range: int = 1 << 19) -> DataFrame:
    """One row per entity of (e, p, v, triple_no) rows, one typed column per property.

    The first column, `e`, is the entity; the others carry the property names
    in order, those of `dates` typed date, those of `whole` bigint, all others
    string. A property whose name would clash with `e` gets a trailing `_`.
    An entity with no readable value at all is a row of nulls. Rows without
    entity or property are no cells; equal triple_no are ordered by value, a
    null triple_no is lowest. A whole number that bigint cannot hold is not readable.
    Columns of `triples` other than the four are ignored. An empty table gives
    an empty one with the single column `e`.

    The property names make the schema, so they alone come to the driver; more
    than `max_columns` of them raise ValueError. A range of ordinals is as long
    as keeps its cells under `cells_per_range`, which bounds a task's memory.
    """
    spark = triples.sparkSession
    cells = read_cells(triples, dates, whole).mapInArrow(_winners, "e string, p string, v string, no bigint")
    sorted_cells = cells.repartition(F.col("e")).sortWithinPartitions("e", "p", F.col("v").isNull(), F.desc("no"), F.desc("v"))
    kept = scratch.keep(sorted_cells.select("e", "p", "v").mapInArrow(_number, "e string, p string, v string, part int, local bigint"), "cells")
    properties = sorted(r[0] for r in kept.where("v is not null").select("p").distinct().limit(max_columns + 1).collect())
    if len(properties) > max_columns:
        raise ValueError(f"more than {max_columns} properties; raise max_columns if the wide table is to be that wide")
    counts = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg((F.max("local") + 1).alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist() if counts else [0]
    width = max(64, cells_per_range // max(1, len(properties)))
    names = ["e", *(p + "_" if p.lower() == "e" else p for p in properties)]
    kinds = ["date" if p in dates else "bigint" if p in whole else "string" for p in properties]
    schema = T.StructType([T.StructField("e", T.StringType()), *(T.StructField(n, {"date": T.DateType(), "bigint": T.LongType(), "string": T.StringType()}[k]) for n, k in zip(names[1:], kinds))])
    offsets = spark.createDataFrame([(part, start) for (part, _), start in zip(counts, starts)], "part int, start bigint")  # one row per task of the numbering
    placed = kept.join(F.broadcast(offsets), "part").select("e", "p", "v", (F.col("start") + F.col("local")).alias("ordinal"))
    tasks = max(1, min(-(-starts[-1] // width), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges = placed.repartition(tasks, F.floor(F.col("ordinal") / width)).sortWithinPartitions("ordinal")
    return ranges.mapInArrow(_assembler(properties, names, kinds, width), schema)


def melt(wide: DataFrame) -> DataFrame:
    """(e, p, v): the filled cells of a wide table, v as text."""
    cells = [F.struct(F.lit(c).alias("p"), F.col(f"`{c}`").cast("string").alias("v")) for c in wide.columns if c != "e"]
    if not cells:
        return wide.select("e", F.lit("").alias("p"), F.lit("").alias("v")).where("false")
    return wide.select("e", F.explode(F.array(*cells)).alias("c")).select("e", "c.p", "c.v").where("v is not null")
