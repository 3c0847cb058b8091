"""Every registered query of the engine against DuckDB, on the smallest tables."""

import pytest

from tests.compare import database, same
from wayfare.plans.oracles import ORACLES
from wayfare.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, db, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()
    assert e.queries()["signals_hourly_float"](spark, SF).count() > 0
