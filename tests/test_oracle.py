"""Queries against their SQL on the smallest test tables, where these are there; the driver compares all of them on larger ones."""

import glob
import os

import pytest

D = "/root/testdata/sf0.001"
NAMES = "p2_found p2_messages p3_found p3_rolling p5_found p6_found p6_hierarchy p7_found j4_narrowest_range j11_follows_within j20_version_matching a3_category_cost a10_role_summary a15_command_groups w5_error_windows w14_status_fold q9_okapi q14_near_duplicates g4_supertypes r1_resolution t4_tumbling t8_growing_messages k6_fill_only f8_task_query x5_issue_delta".split()


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 200


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    import duckdb

    import __spark_entry__ as e
    from tools.compare import bag

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = e.queries()[name](spark, D)
    r = con.execute(e.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert bag(df.columns, [tuple(x) for x in df.collect()]) == bag(cols, r.fetchall())
