import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in Path(data).glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t if t.is_file() else t / '*.parquet'}'")
    return con


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Compare a query with its SQL: column names and rows in any order, floats to nine digits."""

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    def norm(row):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in row)

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        quoted = ", ".join(f'"{c}"' for c in names)
        want = duck.execute(f"select {quoted} from ({sql})").fetchall()
        assert sorted(duck.execute(f"select * from ({sql}) limit 0").description and [c[0] for c in duck.execute(f"select * from ({sql}) limit 0").description]) == names
        got = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
        assert sorted(map(norm, got), key=key) == sorted(map(norm, want), key=key)

    return check
