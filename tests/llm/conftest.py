import pytest
from llm_helpers import SCHEMA, prose, table


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, tied, repeated and very long texts."""
    rows = [(1, ""), (2, None), (3, "one"), (3, "one"), (None, "no id here"), (4, prose(4, 120_000)), (5, "?! ..."), (6, "Ünïcode ✓ 漢字 text"), (7, prose(7, 80)), (8, prose(7, 80)), (9, " \t\n"), (None, None)]
    return table(spark, rows).union(spark.createDataFrame([(10, prose(10, 60), None, None, None, None, None, None, None, None, None, None, None)], SCHEMA))


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(1, 11)] + [(None, 1, True), (3, None, None)], "doc_id long, quality int, t boolean").selectExpr("doc_id", "quality", "int(t) toxic")
