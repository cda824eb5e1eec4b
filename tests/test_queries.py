"""Every registered query with SQL gives what the SQL gives, and some rows."""

from __future__ import annotations

import pytest

from tests.oracle import assert_same, connection
from textloom.plans.catalog import registered

FOLDER = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"jon12_users_without_end", "ext11_cache_reads", "str03_live_entries", "agg11_finding_totals", "scl13_quotations", "sta09_cache_aware_run"}
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    return connection(FOLDER)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, duck, name):
    run, sql = QUERIES[name]
    assert assert_same(run(spark, FOLDER), sql, duck) > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, name):
    assert QUERIES[name][0](spark, FOLDER).count() > 0
