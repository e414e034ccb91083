"""Problem 7: occurrences and records of every term.

An external sort of (term, record) pairs. Terms are counted inside each
record before anything moves; pairs are range-partitioned by term and, inside
a term, by a hash of the record, so a term that is in every record is spread
over as many ranges as it fills. Sorted ranges are scanned run by run, and the
runs of a term that a bound cuts are added up.

Range bounds are weighted quantiles of the pairs of a bounded sample, taken
from the first rows of some evenly spaced input partitions, so the texts are
read once and not a second time for the bounds; they only balance the load.
The number of ranges follows from the number of pairs the sample promises.

The records that have any term are counted in the same pass: each sends one
row without term to a range drawn by the hash of the record, so these rows lie
evenly over all ranges and rows of one record still meet.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

TERM = re.compile("[a-z]+")
#: Sampled input partitions, records of all of them together, and pairs of a record.
SAMPLE_PARTITIONS, SAMPLE_RECORDS, SAMPLE_TERMS = 32, 4096, 128
#: Pairs a range is meant to hold; small tables get shorter ranges, down to FEWEST_PAIRS, so that all cores work.
PAIRS_A_RANGE, FEWEST_PAIRS = 2_000_000, 50_000


def _slot(record: int) -> int:
    """31 bits that order the records inside a term."""
    return (record * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 33


def _sampler(per_partition: int):
    """The first records of a partition, each as its number of different terms and some evenly spaced ones of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = per_partition
        for b in batches:
            b = b.slice(0, left)
            left -= b.num_rows
            sizes, picked = [], []
            for record, text in zip(b.column("record").to_pylist(), b.column("text").to_pylist()):
                found = sorted(set(TERM.findall(text.lower()))) if text else []
                step = -(-len(found) // SAMPLE_TERMS) or 1
                sizes.append(len(found))
                picked.append(found[_slot(record) % step :: step])
            yield pa.RecordBatch.from_arrays([b.column("record"), pa.array(sizes, pa.int64()), pa.array(picked, pa.list_(pa.string()))], ["record", "size", "terms"])
            if left <= 0:
                return

    return run


def _sample(records: DataFrame, sample_records: int) -> list[tuple]:
    """(record, size, terms) of the first rows of up to SAMPLE_PARTITIONS input partitions; only those partitions are opened."""
    n = records.rdd.getNumPartitions()
    chosen = sorted({n * i // SAMPLE_PARTITIONS for i in range(SAMPLE_PARTITIONS)}) if n else []
    each = -(-sample_records // max(1, len(chosen)))
    sampled = records.mapInArrow(_sampler(each), "record bigint, size bigint, terms array<string>").rdd
    take = lambda rows: [tuple(r) for r in islice(rows, each)]
    return sampled.context.runJob(sampled, take, chosen) if chosen else []


def bounds_of(records: DataFrame, parts: int | None = None, sample_records: int = SAMPLE_RECORDS) -> list[tuple[str, int]]:
    """Upper bounds of all ranges but the last: weighted quantiles of the sampled pairs.

    Without `parts` there are as many ranges as hold PAIRS_A_RANGE pairs each,
    or, for small tables, as there are cores.
    """
    sample = _sample(records, sample_records)
    if parts is None:
        pairs = sum(size for _, size, _ in sample) / max(1, len(sample)) * records.count()
        cores = records.sparkSession.sparkContext.defaultParallelism
        parts = max(1, int(pairs // PAIRS_A_RANGE), min(cores, int(pairs // FEWEST_PAIRS)))
    weighted = sorted((t, _slot(record), size / len(terms)) for record, size, terms in sample for t in terms)
    if not weighted:
        return []
    through = np.cumsum([w for _, _, w in weighted])
    at = np.searchsorted(through, through[-1] * np.arange(1, parts) / parts)
    return sorted({weighted[i][:2] for i in at.tolist()})


def _pairs(bounds: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [b[0] for b in bounds]
        whole: dict[str, int] = {}
        cut = set(names)
        for b in batches:
            terms, counts, records, parts = [], [], [], []
            for record, text in zip(b.column("record").to_pylist(), b.column("text").to_pylist()):
                found = Counter(TERM.findall(text.lower())) if text else None
                if not found:
                    continue
                slot = _slot(record)
                for t in found:
                    if t in cut:
                        parts.append(bisect_left(bounds, (t, slot)))
                    else:
                        at = whole.get(t)
                        if at is None:
                            at = whole[t] = bisect_left(names, t)
                        parts.append(at)
                parts.append(slot % (len(bounds) + 1))
                terms.extend(found.keys())
                terms.append("")
                counts.extend(found.values())
                counts.append(1)
                records.extend([record] * (len(found) + 1))
                if len(whole) > 1_000_000:
                    whole.clear()
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(terms, pa.string()), pa.array(records, pa.int64()), pa.array(counts, pa.int32())], ["part", "term", "record", "count"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs to (term, occurrences, records) of each run."""
    last = (None, None)
    for b in batches:
        k = b.num_rows
        if not k:
            continue
        term, record = b.column("term"), b.column("record").to_numpy()
        new_term = np.ones(k, bool)
        new_term[1:] = pc.not_equal(term.slice(1), term.slice(0, k - 1)).to_numpy(zero_copy_only=False)
        new_pair = new_term.copy()
        new_pair[1:] |= record[1:] != record[:-1]
        new_pair[0] = (term[0].as_py(), int(record[0])) != last
        starts = np.flatnonzero(new_term)
        last = (term[k - 1].as_py(), int(record[-1]))
        yield pa.RecordBatch.from_arrays([term.take(pa.array(starts)), pa.array(np.add.reduceat(b.column("count").to_numpy().astype(np.int64), starts)), pa.array(np.add.reduceat(new_pair.astype(np.int64), starts))], ["term", "occurrences", "records"])


def ranged(records: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """(part, term, record, count): the pairs, and one row without term for each record, with the range they belong to."""
    return scratch.spread(records).mapInArrow(_pairs(bounds), "part int, term string, record bigint, count int")


def term_table(docs: DataFrame, id_col: str, text_col: str, rare_below: int = 2, common_above: float = 0.8, ranges: int | None = None) -> DataFrame:
    """(term, n_occurrences, n_records, mark) of every term: a run of ASCII letters of the lower-cased text.

    mark is `rare` for a term in fewer than rare_below records, `common` for
    one in more than common_above of the records that have any term (rare wins
    where both hold), else null. Null and empty texts have no terms. Records
    are told apart by id_col; rows of one id count as one record, rows with a
    null id as one record together. Other columns are ignored, whatever their
    names. An empty table gives an empty result. `ranges` fixes the number of
    ranges, which otherwise follows from the size; it changes no row.
    """
    records = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("record"), F.col(text_col).alias("text"))
    bounds = bounds_of(records, ranges)
    pairs = ranged(records, bounds)
    sorted_ranges = pairs.repartitionById(len(bounds) + 1, F.col("part")).select("term", "record", "count").sortWithinPartitions("term", "record")
    runs = sorted_ranges.mapInArrow(_runs, "term string, occurrences bigint, records bigint")
    terms = scratch.keep(runs.groupBy("term").agg(F.sum("occurrences").alias("n_occurrences"), F.sum("records").alias("n_records")), "terms")
    with_terms = terms.where("term = ''").first()
    total = with_terms["n_records"] if with_terms else 0
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * total, "common")
    return terms.where("term <> ''").withColumn("mark", mark)
