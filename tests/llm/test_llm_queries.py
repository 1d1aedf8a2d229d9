"""Every registered query of the training-data operators on the smallest tables, against its SQL where there is some."""

import pytest

import check
from taufold.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.oracle(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    if name == "pipeline":
        pytest.skip("tests of its stages are in test_llm.py")
    found = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(found.columns)
        assert check.rows_of(found.columns, rows) == check.rows_of(names, cursor.fetchall())
