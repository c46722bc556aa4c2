"""Registered queries against their SQL twins on the smallest tables.

"""

import pytest
from conftest import SMALL

import __spark_entry__ as contract
from duoscreen.catalog import QUERIES
from duoscreen.catalog.check import compare, connect
from duoscreen.plans import variational_gi

NAMES = list(QUERIES)


@pytest.fixture(scope="module", autouse=True)
def one_fit():
    """The variational queries of equal arguments read one fit here; each fits for itself outside the tests."""
    fit, kept = variational_gi.infer, {}

    def once(long, *args, **options):
        key = repr((args, sorted(options.items())))
        if key not in kept:
            kept[key] = fit(long, *args, **options)
        return kept[key]

    variational_gi.infer = once
    yield
    variational_gi.infer = fit


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, SMALL, name)
    assert problem is None or problem == "both empty", problem


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["gene_pair", "sample", "dlfc", "zdlfc"] or set(contract.entry(spark).columns) == {
        "gene_pair", "sample", "dlfc", "zdlfc",
    }
