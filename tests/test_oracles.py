"""A sample of the queries against their SQL on the smallest tables; every query is registered with a result schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from imprynt.plans.fixtures import TABLES

SAMPLE = ["a01_value_counts", "a06_histogram", "a14_timeline_week", "e04_lora_uses", "g05_reachable", "g13_cleanup_plan", "j10_prompts_for_images", "p13_resolve", "src09_diff_catalog", "t04_top_terms", "u05_link_attempts", "w02_burst_clusters"]


def clean(frame):
    rows = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).values.tolist()
    return sorted([[f"{v:.5f}" if isinstance(v, float) else str(v) for v in r] for r in rows])


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert clean(entry.queries()[name](spark, sf).toPandas()) == clean(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)
