"""Training-data queries that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stitch


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return stitch.melt(stitch.wide_table(spark.read.parquet(f"{d}/triples.parquet")))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return stitch.wide_table(spark.read.parquet(f"{d}/triples.parquet"))


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    """Per property how many entities have it and how many different values they show."""
    cells = stitch.melt(stitch.wide_table(spark.read.parquet(f"{d}/triples.parquet")))
    return cells.groupBy("p").agg(F.count("*").alias("n_entities"), F.countDistinct("v").alias("n_values"))


QUERIES = {"p2_found": p2_found, "p2_wide": p2_wide, "p2_columns": p2_columns}

_CELLS = r"""
t as (
  select nullif(regexp_replace(upper(trim(e, e' \t\r\n')), '^WD:', ''), '') as e,
         nullif(regexp_replace(upper(trim(p, e' \t\r\n')), '^WDT:', ''), '') as p,
         regexp_replace(trim(v, e' \t\r\n'), '\s+', ' ', 'g') as v, triple_no
  from triples
), d as (
  select *, case
    when regexp_full_match(v, '\+?\d{4}[-/]\d{1,2}[-/]\d{1,2}(T.*)?') then try_cast(replace(regexp_extract(v, '\d{4}[-/]\d{1,2}[-/]\d{1,2}'), '/', '-') as date)
    when regexp_full_match(v, '\d{1,2}\.\d{1,2}\.\d{4}') then try_cast(regexp_replace(v, '(\d+)\.(\d+)\.(\d+)', '\3-\2-\1') as date)
    when regexp_full_match(v, '\d{1,2} [A-Za-z]+ \d{4}') then coalesce(try_strptime(v, '%d %B %Y'), try_strptime(v, '%d %b %Y'))::date
    when regexp_full_match(v, '[A-Za-z]+ \d{1,2}, \d{4}') then coalesce(try_strptime(v, '%B %d, %Y'), try_strptime(v, '%b %d, %Y'))::date
    end as dv,
    case when regexp_full_match(v, '[+-]?\d{1,3}([ ,]\d{3})+') then try_cast(regexp_replace(v, '[ ,+]', '', 'g') as decimal(38, 10))
         when regexp_full_match(v, '[+-]?\d+(\.\d+)?([eE][+-]?\d+)?') then try_cast(v as decimal(38, 10)) end as nv
  from t where e is not null and p is not null
), c as (
  select e, p, triple_no, case
    when lower(v) in ('', 'n/a', 'none', 'null', 'unknown', '?', '-') then null
    when p in ('P569', 'P570', 'P571') then cast(dv as varchar)
    when p in ('P1082', 'P1128') then case when nv = floor(nv) then cast(cast(nv as bigint) as varchar) end
    when regexp_full_match(v, '([wW][dD]:)?[qQ]\d+') then regexp_replace(upper(v), '^WD:', '')
    else v end as v
  from d
), cells as (select e, p, arg_max(v, triple_no) as v from c where v is not null group by e, p)
"""

#: The properties of the test tables: the named ones and 40 of one series.
_COLUMNS = (*stitch.DATES, *stitch.WHOLE, "P106", "P159", "P17", "P19", "P27", "P279", "P31", *(f"P{9100 + 7 * i}" for i in range(40)))


def _cell(p: str) -> str:
    kind = "date" if p in stitch.DATES else "bigint" if p in stitch.WHOLE else "varchar"
    return f"cast(max(v) filter (p = '{p}') as {kind}) as {p}"


ORACLE = {
    "p2_wide": f"with {_CELLS}, all_e as (select distinct e from t where e is not null and p is not null) select e, {', '.join(map(_cell, _COLUMNS))} from all_e left join cells using (e) group by e",
    "p2_found": f"with {_CELLS} select e, p, v from cells",
    "p2_columns": f"with {_CELLS} select p, count(*) as n_entities, count(distinct v) as n_values from cells group by p",
}
