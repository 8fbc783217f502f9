"""Every registered query against its SQL on the smallest tables."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(FOLDER)


# The queries of rankloom/llm have their tests in tests/llm.
NAMES = sorted(n for part in entry._PARTS if part.__name__.startswith("rankloom.plans.") for n in part.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    good, message = check_queries.compare(spark, con, name, FOLDER)
    assert good, message


def test_every_query_has_sql_or_is_listed():
    assert set(NAMES) - set(entry.oracle_sql()) == set()


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0
