import datetime

import pytest
from pyspark.sql import functions as F

from loomtext.operators import stitch

SCHEMA = "e string, p string, v string, triple_no bigint"


def wide(spark, rows, **kw):
    return {r["e"]: r.asDict() for r in stitch.wide_table(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def cell(spark, f, value):
    return spark.range(1).select(f(F.lit(value).cast("string")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1999-12-31", "1999-12-31"), ("+1999-12-31T00:00:00Z", "1999-12-31"), ("1999/2/3", "1999-02-03"), ("03.02.1999", "1999-02-03"), ("3 Feb 1999", "1999-02-03"), (" 03 FEBRUARY  1999 ", "1999-02-03"),
        ("February 3, 1999", "1999-02-03"), ("Sept 3, 1999", "1999-09-03"), ("2019-13-05", None), ("30.02.1999", None), ("1999", None), ("circa 1999", None), ("1999-02", None), ("+1999-00-00T00:00:00Z", None), ("3 Foo 1999", None), ("3 Febr 1999", "1999-02-03"), ("3 Februari 1999", None), ("=-1999-02-03", None), ("29 Feb 1999", None), ("29 Feb 2000", "2000-02-29"), ("", None), (None, None),
    ],
)
def test_dates(spark, text, want):
    assert cell(spark, stitch.read_date, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("12", "12"), (" 1,234 ", "1234"), ("1 234 567", "1234567"), ("+5", "5"), ("-7", "-7"), ("9.0e+04", "90000"), ("1.5e1", "15"), ("1.5", None), ("102.0", "102"), ("007", "7"), ("12k", None), ("about 5", None), ("5-9", None), ("1,23", None),
        ("", None), (None, None), ("9" * 30, None), ("1e99", None), ("9223372036854775807", "9223372036854775807"), ("-9223372036854775808", "-9223372036854775808"), ("9223372036854775808", None), ("1e18", "1000000000000000000"), ("5 000 000 000 000 000 000", "5000000000000000000"),
    ],
)
def test_whole_numbers(spark, text, want):
    assert cell(spark, stitch.read_whole, text) == want


def test_wide_types_and_latest_value(spark):
    rows = [
        (" wd:q1 ", "wdt:p569", "3 Feb 1999", 1), ("Q1", "P569", "unreadable", 9), ("q1", "P1082", "1,000", 2), ("Q1", "P1082", "2 000", 3), ("Q1", "P31", " wd:q5 ", 4), ("Q2", "P9", "  a   b ", 5), ("Q2", "P9", "n/a", 6),
        ("Q3", "P31", "unknown", 7), (None, "P31", "Q5", 8), ("", "P31", "Q5", 8), ("Q4", None, "x", 8), ("Q5", "P9", "x", None), ("Q5", "P9", "a", 1), ("Q6", "e", "clash", 1),
    ]
    got = wide(spark, rows)
    assert got["Q1"]["P569"] == datetime.date(1999, 2, 3) and got["Q1"]["P1082"] == 2000 and got["Q1"]["P31"] == "Q5"
    assert got["Q2"]["P9"] == "a b" and got["Q5"]["P9"] == "a" and got["Q6"]["E_"] == "clash"
    assert set(got) == {"Q1", "Q2", "Q3", "Q5", "Q6"} and all(v is None for k, v in got["Q3"].items() if k != "e")


def test_repeated_rows_ties_and_extra_columns(spark):
    rows = [("Q1", "P9", "b", 1), ("Q1", "P9", "b", 1), ("Q1", "P9", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"ordinal": F.lit(9), "part": F.lit("x"), "local": F.lit(1)})
    assert [tuple(r) for r in stitch.wide_table(df).collect()] == [("Q1", "b")]


def test_empty_and_too_many_columns(spark):
    empty = stitch.wide_table(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["e"] and empty.count() == 0 and stitch.melt(empty).count() == 0
    with pytest.raises(ValueError):
        stitch.wide_table(spark.createDataFrame([("Q1", f"P{i}", "x", i) for i in range(5)], SCHEMA), max_columns=4)


def test_many_ranges_and_a_hot_entity(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "Q0").otherwise(F.concat(F.lit("Q"), F.col("id"))).alias("e"), F.concat(F.lit("P"), F.col("id") % 7).alias("p"), F.col("id").cast("string").alias("v"), F.col("id").alias("triple_no"))
    got = stitch.melt(stitch.wide_table(rows, cells_per_range=1024))
    want = rows.groupBy("e", "p").agg(F.max_by("v", "triple_no").alias("v"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_long_values(spark):
    long = "word " * 200_000
    assert wide(spark, [("Q1", "P9", long, 1)])["Q1"]["P9"] == long.strip()


def test_plan_has_generated_code_and_no_sort_aggregate(spark, data):
    """Reading the values compiles into whole stages, and cells are not chosen by sorting aggregates."""
    triples = spark.read.parquet(f"{data}/triples.parquet")
    plan = stitch.read_cells(triples)._jdf.queryExecution()
    assert "SortAggregate" not in plan.executedPlan().toString()
    debug = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenStringSeq(plan.executedPlan())
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and all(0 < n < 64 * 1024 for n in sizes)
