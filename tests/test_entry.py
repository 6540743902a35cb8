import re

import pytest
from conftest import DATA

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in (1, 3, 4, 6)} <= set(queries)


def test_flagship(spark):
    r = entry.entry(spark).collect()
    assert len(r) == 1 and 0 <= r[0]["p"] <= 1


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p6_found", "edges_clean", "degree_bins", "binned_sample"])
def test_runs_on_the_smallest_tables(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert all(re.fullmatch(r"\w+", c) for c in df.columns) and df.count() > 0
