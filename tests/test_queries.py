"""Every query against its SQL; those without SQL give rows with a stable schema."""

import pytest

from tests.compare import differences, duck
from tickloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
