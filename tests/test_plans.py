"""Plan shapes the scale design relies on (checked on the physical plan text)."""

import re

from pingtrail import catalog
from pingtrail.operators import events, range_test
from pingtrail.session import scratch_path
from pingtrail.sources import tables
from pingtrail.sources.stages import load_stage, save_stage

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _stage(spark):
    tidy = catalog.tidy_for(spark, SF)
    return load_stage(spark, save_stage(tidy, scratch_path(spark, "plan-tidy")), tidy.schema)


def test_dedupe_limits_copies_before_the_shuffle(spark):
    p = _plan(catalog.tidy_for(spark, SF))
    # a partial WindowGroupLimit sits below the exchange: hot groups of copies shrink map-side
    assert re.search(r"WindowGroupLimit[^\n]*Partial", p) or p.count("WindowGroupLimit") >= 2
    assert "BroadcastHashJoin" in p and "BroadcastNestedLoopJoin" not in p


def test_residency_events_aggregate_before_any_window(spark):
    p = _plan(events.residency_events(_stage(spark), min_days=1.0))
    lines = p.splitlines()
    scan = max(i for i, l in enumerate(lines) if "FileScan parquet" in l)
    first_agg = max(i for i, l in enumerate(lines) if "HashAggregate" in l and "partial_" in l)
    windows = [i for i, l in enumerate(lines) if re.search(r"\bWindow\b", l)]
    # the partial aggregate reads the scan; every window is above the aggregate (on bucket rows)
    assert first_agg > max(windows) and scan > first_agg


def test_schedule_lookup_is_an_equi_join(spark):
    hourly = range_test.range_hourly(tables.range_raw(spark, SF), zone="UTC")
    p = _plan(range_test.with_expected(hourly, tables.range_schedule(spark)))
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p and "Cartesian" not in p


def test_scans_are_pruned(spark):
    p = _plan(events.hourly_bins(catalog.tidy_for(spark, SF)))
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    events_schema = [s for s in schema if "user_id" in s]
    assert events_schema and all("value" not in s for s in events_schema)


def test_no_job_runs_while_a_query_is_defined(spark):
    catalog.tidy_stage(spark, SF)  # written once per session and folder
    catalog.tidy_multi_year_stage(spark, SF)
    tracker = spark.sparkContext.statusTracker()
    for name in ("movement_base", "movement_legs", "abacus", "hourly_event_ids", "datetime_summary",
                 "residency_event_rows", "residency_events", "monthly_days"):
        spark.sparkContext.setJobGroup(f"define-{name}", name)
        catalog.QUERIES[name](spark, SF)
        assert len(tracker.getJobIdsForGroup(f"define-{name}")) == 0, name
    spark.sparkContext.setJobGroup("other", "other")
