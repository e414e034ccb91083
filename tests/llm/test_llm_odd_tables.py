"""Every query over empty tables, and over tables with nulls in each column, repeated rows and clashing columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import odd_tables  # noqa: E402

from loomtext.llm import registry  # noqa: E402


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    return {k: odd_tables.write(spark, data, base / k, k) for k in ("empty", "dirty")}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(name, spark, folders):
    df = registry.QUERIES[name](spark, folders["empty"])
    assert df.count() == (1 if name in ("p3_audit", "p3_filter") else 0) or name in ("p9_shares", "p9_checks")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_dirty(name, spark, folders, data):
    assert len(registry.QUERIES[name](spark, folders["dirty"]).collect()) >= 0.9 * registry.QUERIES[name](spark, data).count()
