"""Every registered query on the supplied tables against its SQL check."""

from __future__ import annotations

import pytest

from ledgerline.queries import catalog
from tests.compare import connect, difference

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
# At the smallest scale no entity passes every rule of this study.
MAY_BE_EMPTY = {"restrict_sample"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    actual = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(actual, duck.execute(ORACLES[name]).df()) is None
    assert len(actual) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
