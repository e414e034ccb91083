"""Stitching over empty tables, and over tables with nulls in each column, repeated rows and clashing columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import odd_tables  # noqa: E402

from loomtext.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    return {k: odd_tables.write(spark, data, base / k, k) for k in ("empty", "dirty")}


@pytest.mark.parametrize("name", ["p2_found", "p2_wide", "p2_columns"])
def test_stitching(name, spark, folders, data):
    assert registry.QUERIES[name](spark, folders["empty"]).count() == 0
    assert registry.QUERIES[name](spark, folders["dirty"]).count() >= 0.9 * registry.QUERIES[name](spark, data).count()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"p2_found", "p2_wide", "p2_columns", "hashing_logreg", "hashing_logreg_report", "decision_scores", "ablation_report"}))
def test_empty_tables(name, spark, folders):
    assert registry.QUERIES[name](spark, folders["empty"]).count() >= 0
