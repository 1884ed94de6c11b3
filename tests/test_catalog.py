"""Oracle parity: every catalogue query against its DuckDB SQL at sf0.01."""

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF001, SF01
from tests.parity import compare, duck

from pinax.plans import catalog

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_parity(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF01), con, ORACLE[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["n_name", "year", "price", "p0", "pl"]
    assert len(rows) > 0 and all(r.pl == 100.0 for r in rows if r.year == 1995)


def test_queries_run_at_smallest_scale(spark):
    for name, fn in QUERIES.items():
        fn(spark, SF001).write.format("noop").mode("overwrite").save()
