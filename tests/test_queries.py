"""Every registered query against its SQL in a second engine."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry_points
from ticketlens.plans import catalog, oracle

QUERIES = catalog.QUERIES
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, con):
    assert compare.differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


STORING = (
    "full_refresh_roundtrip", "refresh_current", "closed_increment_rows", "closed_increment_appended", "closed_days_synced",
    "stored_activity_state", "stored_activity_history", "stored_activity_files",
    "tracking_page_stored", "page_summary_stored", "table_freshness_stored",
    "volumetry_rollup", "volumetry_by_user_rollup", "mean_handling_time_rollup",
)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STORING)))
def test_plan_without_early_jobs_and_products(name, spark, sf_dir):
    """No job runs before a query returns, and no join multiplies whole tables."""
    context = spark.sparkContext
    context.setJobGroup(f"plan-{name}", name)
    try:
        df = QUERIES[name](spark, sf_dir)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(f"plan-{name}")]
    stages = [tracker.getStageInfo(stage) for job in jobs for stage in job.stageIds]
    # Opening a file reads its columns from the footer: the only job allowed.
    assert all(stage.name.startswith("parquet at") for stage in stages)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name", ["stay_totals", "tracking_active", "volumetry_by_user", "activity_list", "rejected_commands"]
)
def test_query_without_broadcasts(name, spark, sf_dir, con):
    """Tables that outgrow every broadcast give the same rows by shuffles."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in settings}
    for key in settings:
        spark.conf.set(key, "-1")
    try:
        assert compare.differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
