"""Every registered query of the package's own against its SQL in DuckDB."""

import pytest

from compare_oracle import connect, difference
from workload_lens.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == ""


def test_attribution_of_all_rows(spark):
    # order keys go beyond the 5,000 of attribute_clusters
    found = QUERIES["attribute_all_clusters"](spark, "/root/testdata/sf0.01")
    assert found.count() > 5000 and found.where("outcome is null").count() == 0
    assert difference(found, connect("/root/testdata/sf0.01"), ORACLES["attribute_all_clusters"]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
