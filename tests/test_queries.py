"""Every registered query against its SQL, and its plan."""

import re

import pytest
from compare import database, differences

import __spark_entry__ as entry_points
from lumbre.operators.ranking import page_rank
from lumbre.plans.programs import purchase_graph

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    stats = entry_points.entry(spark)
    assert stats.count() == 14
    assert stats.columns[:4] == ["tabla", "registros", "tamaño_total", "tamaño_tabla"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["word_count", "pagerank", "fk_verify", "run_outcomes", "roc_curve", "cadence_weekdays", "table_stats"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(QUERIES["cadence_6h"](spark, sf_dir))
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<ts:timestamp_ntz,event_type:string,value:double>"]
    counts = plan_of(QUERIES["table_row_counts"](spark, sf_dir))
    assert set(re.findall(r"ReadSchema: (\S+)", counts)) == {"struct<>"}


def test_filters_reach_the_scan(spark, sf_dir):
    assert "EqualTo(event_type,signup)" in plan_of(QUERIES["run_keys"](spark, sf_dir))


def test_tails_are_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["log_tail"](spark, sf_dir))
    assert "row_number(), 20, Partial" in plan


def test_rounds_do_not_shuffle_the_links(spark, sf_dir):
    """A round shuffles shares and partial sums; the links are read where they lie, whatever the size of the table."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plans = [plan_of(page_rank(purchase_graph(spark, d), 2)) for d in (sf_dir, sf_dir.replace("sf0.01", "sf0.001"))]
    finally:
        spark.conf.set(threshold, before)
    shapes = [re.findall(r"Exchange|SortMergeJoin|ShuffledHashJoin|BroadcastExchange|Bucketed: true", plan) for plan in plans]
    assert shapes[0] == shapes[1]
    assert all("Bucketed: true" in plan and "BroadcastExchange" not in plan for plan in plans)
    for plan in plans:
        for scan in re.findall(r"Scan parquet[^\n]*dst[^\n]*", plan):
            assert "Bucketed: true" in scan
