"""The registered queries on whole tables: DuckDB statements where there are any."""

import compare
import pytest

from fleetspark.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, duck, sf_dir, name):
    assert compare.compare(spark, duck, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) == ""


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
