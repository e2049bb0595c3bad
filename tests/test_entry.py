import duckdb
import pytest

import __spark_entry__ as entry_point
from equivcheck.registry import all_queries
from equivcheck.registry_sql import all_sql

# Cheap ones of every kind; tools/check.py compares all of them.
SAMPLE = [
    "filter_other",
    "lineitem_map_other",
    "keyagg_avg_other",
    "lineitem_keyagg_sum_tagged",
    "winpart_avg_other",
    "winpart_sum_other_by5",
    "scalar_arithmetic",
    "predicate_operators",
    "multi_source_union",
    "generated_times",
    "generated_stream",
    "compare_missing",
    "compare_tolerance_blocks",
    "diff_of_results",
    "suite_totals",
]


def test_entry(spark):
    out = entry_point.entry(spark)
    assert out.columns == ["start", "end", "key", "value"]
    assert not out.isEmpty()


def test_every_query_has_sql():
    queries, sql = all_queries(), all_sql()
    assert set(queries) == set(sql)
    assert len(queries) > 100
    # Other operators may be registered beside these, some of them without SQL.
    assert set(queries) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for table in ("events", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, con, name):
    got = entry_point.queries()[name](spark, sf)
    names = sorted(got.columns)
    ours = sorted(map(repr, (tuple(r) for r in got.select(names).collect())))
    theirs = con.sql(entry_point.oracle_sql()[name])
    quoted = ", ".join(f'"{n}"' for n in names)
    assert sorted(theirs.columns) == names
    assert ours == sorted(map(repr, theirs.project(quoted).fetchall()))
