"""Registered queries over whole tables at the smallest scale, next to SQL where there is some."""

import os

import pytest

from compare import difference, duck
from defectflow.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
if not os.path.exists(SF):
    pytest.skip("no test tables", allow_module_level=True)


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours) > 0
    if name in ORACLES:
        assert difference(ours, duck(SF).sql(ORACLES[name]).df()) is None
