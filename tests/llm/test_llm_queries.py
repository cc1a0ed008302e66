"""The operators' queries against their SQL on the smallest data folder."""

import compare as C
import pytest

from worklake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return C.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert C.compare(spark, duck, FOLDER, name, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
