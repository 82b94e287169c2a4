"""Each registered query against its SQL, on the smallest tables."""

import oracle
import pytest
from oracle import SF

from stepwright import catalog

ROWS_ONLY = {"pca_projection", "fuzzy_terms", "search_misspelt", "embed_stub"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = oracle.of_spark(df)
    if name in ROWS_ONLY:
        assert got[1]
        return
    assert oracle.difference(got, oracle.of_sql(duck, catalog.oracle_sql()[name])) == ""


def test_every_query_has_sql_or_is_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == ROWS_ONLY
