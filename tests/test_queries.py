"""Every registered engine query that has SQL agrees with it; the others give rows."""

import pytest

from netloom.plans import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_gives_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert [r.router_id for r in out.collect()] == [f"router-00{i}" for i in range(1, 6)]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
