"""Every query against its SQL twin on the smallest data set."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402
from oracle import connect, difference  # noqa: E402

from checks.oracles import ORACLES  # noqa: E402
from checks.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry_points_hold_all_queries():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(con, QUERIES[name](spark, sf_dir), ORACLES[name]) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and len(df.columns) == 25
