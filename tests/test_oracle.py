"""Every query that has a SQL twin gives the same rows as DuckDB; others give rows."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, duck, name):
    assert oracle.compare(entry.queries()[name](spark, SF), duck, TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(TWINS)))
def test_query_without_twin_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
