"""Every registered query at the smallest scale, next to its SQL where it has one."""

import duckdb
import pytest

from compare import difference, duck
from defectflow.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours) > 0
    if name in ORACLES:
        assert difference(ours, db.sql(ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and duckdb
