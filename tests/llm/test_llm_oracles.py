"""The registered queries of the subpackage that have SQL, on the smallest tables."""

import pytest

from tests.compare import database, same
from wayfare.llm.oracles import ORACLES
from wayfare.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    same(QUERIES[name](spark, SF), db, ORACLES[name])
