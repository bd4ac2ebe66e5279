"""Every registered query of the library against its SQL, at the smallest size."""

import pytest

from cindertrace import catalog
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, small, oracle, name):
    got = rows_of(r.asDict() for r in catalog.QUERIES[name](spark, small).collect())
    assert got == oracle(catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
