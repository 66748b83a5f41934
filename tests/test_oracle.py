"""Spark queries against their DuckDB SQL on the smallest tables."""

import pytest

from tools.oracle_check import digest, duck

SF = "/root/testdata/sf0.001"
CORE = ["tidy_detections", "movement_base", "movement_legs", "residency_events", "residency_event_rows",
        "hourly_event_ids", "hour_bins", "abacus", "monthly_days", "mean_residency_station", "range_by_distance",
        "range_model", "datetime_summary", "missing_cells",
        # file round trips, partitioned writes, variants and model outputs
        "parse_detections", "csv_tidy_detections", "rose_partitions", "tag_roses", "resident_hours_semi",
        "days_per_year", "unique_tags_stacked", "mean_residency_summary", "range_curve", "range_thresholds", "unique_tags_stacked_station",
        "station_points", "hourly_residency", "resident_hours"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
