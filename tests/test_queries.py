"""Registered queries against their SQL, on the smallest tables. All of them, on larger
tables, are compared by scripts/check_queries.py."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry
from check_queries import TABLES, rows_of
from newsburst.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "i4_validate",
    "j2_visible_all_tenants",
    "a7_visible_stats",
    "q10_article_listing",
    "q2_live_events_global",
    "q3_latest_per_tenant",
    "e4_hash_encode",
    "s1_ingest_stream",
    "s2_embed_stream",
    "s3_refresh_stream",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    result = entry.queries()[name](spark, FOLDER)
    got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    answer = duck.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in answer.description], answer.fetchall())
