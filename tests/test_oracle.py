"""Registered queries against DuckDB on the smallest given tables.

``python tests/compare.py`` does the same for every query on larger data; the
slowest ones, which have tests of their own, are left to it.
"""

import inspect

import pytest

import __spark_entry__ as entry_module
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from tests.compare import connect, difference

SLOW = {
    "a1_read_listings", "a2_with_row_index", "a4_write_read_normalized", "e2_search_batch", "f3_answer_lines",
    "h3_top_k_per_request", "k3_render_search", "m1_stream_listings", "m2_stream_bookings",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())
    for query in QUERIES.values():
        assert list(inspect.signature(query).parameters) == ["spark", "sf_dir"]


def test_entry_answers_the_flagship_question(spark):
    rows = entry_module.entry(spark).collect()
    assert [r.row_index for r in rows] == [508, 2, 1146, 640, 893]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_same_rows_as_duckdb(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, QUERIES[name], ORACLE[name]) is None
