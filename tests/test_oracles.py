"""Every registered query against its DuckDB statement, on whole tables."""

import compare
import pytest

import __spark_entry__ as entry
from fleetspark.plans.registry import QUERIES

ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
# No row of the small tables meets the condition of these.
MAY_BE_EMPTY = {"short_id_collisions"}


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    problem = compare.compare(spark, duck, name, QUERIES[name], ORACLES[name], sf_dir)
    assert problem in ("", "no rows" if name in MAY_BE_EMPTY else ""), problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster", "shard", "ordinal", "step", "name", "statement"]
    assert df.count() > 0
