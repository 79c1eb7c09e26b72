import pytest

from evalweave.plans import catalogue
from oracle import compare

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, DIR, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0
