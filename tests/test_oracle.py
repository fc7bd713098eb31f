"""Every civic-incident query equals its SQL on the smallest tables."""

import pytest

from tests.oracle import check
from wardline import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name])
