"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry
from spectrail.catalog import collect

SMALL = "/root/testdata/sf0.001"


def test_queries_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    own, own_sql = collect()
    assert set(own) <= set(queries) and set(own_sql) <= set(own)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_a_core_query_over_the_smallest_tables(spark):
    assert entry.queries()["p1_report"](spark, SMALL).count() > 0
