"""Every registered query equals its DuckDB oracle at sf0.01."""

import pytest

import __spark_entry__ as entry
from cohortlens.plans import registry
from tests.conftest import SF001
from tests.oracle_check import canon, duck

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert canon(srows, df.columns) == canon(drows, dcols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert df.columns[:2] == ["intervention_type", "n"]
