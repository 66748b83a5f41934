"""Schedules in local time: skipped and repeated hours, windows at any instant, the row check."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pingtrail.functions.time import local_bounds
from pingtrail.operators import range_test
from pingtrail.sources import tables

ZONE = "America/Santiago"
COLUMNS = "date_utc string, time_utc string, receiver string, transmitter string, distance string"


def _bounds(spark, text, zone=ZONE):
    first, last = local_bounds("t", zone)
    row = spark.sql(f"select timestamp_ntz'{text}' t").select(first.alias("a"), last.alias("b")).first()
    return str(row.a), str(row.b)


@pytest.mark.parametrize("zone_of_session", ["UTC", "Europe/Berlin"])
def test_bounds_of_skipped_and_repeated_hours(spark, zone_of_session):
    spark.conf.set("spark.sql.session.timeZone", zone_of_session)
    try:
        assert _bounds(spark, "2024-01-15 12:00:00") == ("2024-01-15 15:00:00",) * 2
        # clocks went back from midnight to 23:00: 23:30 was shown twice
        assert _bounds(spark, "2024-04-06 23:30:00") == ("2024-04-07 02:30:00", "2024-04-07 03:30:00")
        assert _bounds(spark, "2024-04-07 00:00:00") == ("2024-04-07 04:00:00",) * 2
        # clocks went from midnight to 01:00: 00:30 was never shown
        assert _bounds(spark, "2024-09-08 00:30:00") == ("2024-09-08 04:00:00", "2024-09-08 03:59:59.999999")
        assert _bounds(spark, "2024-09-08 01:00:00") == ("2024-09-08 04:00:00",) * 2
        assert _bounds(spark, "2024-09-08 00:30:00", "UTC") == ("2024-09-08 00:30:00",) * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _raw(spark, utc_times):
    rows = [(t.strftime("%d-%m-%y"), t.strftime("%H:%M:%S"), "R", "T", "20 metros") for t in utc_times]
    return spark.createDataFrame(rows, COLUMNS)


def _local(spark, utc_times, schedule):
    hourly = range_test.range_hourly(_raw(spark, utc_times), ZONE, keep_instant=True)
    rates = range_test.with_expected(hourly, tables.range_schedule(spark, schedule), zone=ZONE)
    return sorted((str(r.hour_utc), str(r.hour_time)) for r in rates.collect())


def test_a_window_of_a_repeated_hour_holds_both(spark):
    times = [dt.datetime(2024, 4, 7, h, 10) for h in (1, 2, 3, 4)]
    both = [("2024-04-07 02:00:00", "2024-04-06 23:00:00"), ("2024-04-07 03:00:00", "2024-04-06 23:00:00")]
    assert _local(spark, times, [("2024-04-06 23:00:00", "2024-04-06 23:59:59", 6.0)]) == both
    assert _local(spark, times, [("2024-04-07 00:00:00", "2024-04-07 00:30:00", 6.0)]) == [("2024-04-07 04:00:00", "2024-04-07 00:00:00")]


def test_a_window_of_a_skipped_hour(spark):
    times = [dt.datetime(2024, 9, 8, h, 10) for h in (2, 3, 4, 5)]
    # it ends in the skipped hour: up to the change; it starts there: from the change on
    assert _local(spark, times, [("2024-09-07 23:00:00", "2024-09-08 00:30:00", 6.0)]) == [("2024-09-08 03:00:00", "2024-09-07 23:00:00")]
    assert _local(spark, times, [("2024-09-08 00:30:00", "2024-09-08 01:59:00", 6.0)]) == [("2024-09-08 04:00:00", "2024-09-08 01:00:00")]


def test_half_hour_bins_and_zones_of_half_hours(spark):
    times = [dt.datetime(2024, 1, 1, 10, m) for m in (5, 29, 31, 59)]
    halves = range_test.range_hourly(_raw(spark, times), "UTC", bin_us=1_800_000_000)
    assert sorted((str(r.hour_time), r.n_det) for r in halves.collect()) == [("2024-01-01 10:00:00", 2), ("2024-01-01 10:30:00", 2)]
    india = range_test.range_hourly(_raw(spark, times), "Asia/Kolkata", keep_instant=True).collect()
    assert sorted((str(r.hour_utc), str(r.hour_time), r.n_det) for r in india) == [
        ("2024-01-01 09:30:00", "2024-01-01 15:00:00", 2), ("2024-01-01 10:30:00", "2024-01-01 16:00:00", 2)]


@pytest.mark.parametrize("bucket_us", [60_000_000, 3_600_000_000, 40 * 86_400_000_000])
def test_windows_as_brute_force(spark, bucket_us):
    rnd = random.Random(bucket_us)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda: t0 + dt.timedelta(microseconds=rnd.randrange(0, 86_400_000_000, 250_000))
    windows = [(a := at(), a + dt.timedelta(seconds=rnd.choice([-60, 0, 90, 1800, 20_000])), float(i), rnd.randrange(5)) for i in range(20)]
    windows += [(None, t0, 99.0, 0), (t0, None, 98.0, 0)]
    # one value per priority, so that ties are equal
    windows = [(a, b, float(p), p) for a, b, _, p in windows]
    times = [at() for _ in range(300)] + [w[k] for w in windows for k in (0, 1)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    w = spark.createDataFrame(windows, "window_start timestamp_ntz, window_end timestamp_ntz, expected double, priority int")
    got = {r.i: r.e for r in range_test.window_lookup(df, "t", w, "expected", "e", bucket_us=bucket_us).collect()}
    assert len(got) == len(times)
    for i, t in enumerate(times):
        fit = [p for a, b, _, p in windows if None not in (a, b, t) and a <= t <= b]
        assert got[i] == (float(min(fit)) if fit else None)


def test_the_row_check_fails_on_an_action_only(spark):
    schedule = tables.range_schedule(spark)
    outside = range_test.range_hourly(_raw(spark, [dt.datetime(2030, 1, 1)]), "UTC")
    checked = range_test.with_expected(outside, schedule, require_rows=True)  # nothing runs here
    with pytest.raises(Exception, match="no hourly rows left"):
        checked.collect()
    with pytest.raises(Exception, match="no hourly rows left"):
        checked.write.format("noop").mode("overwrite").save()
    inside = range_test.range_hourly(_raw(spark, [dt.datetime(2024, 1, 2)]), "UTC")
    assert range_test.with_expected(inside, schedule, require_rows=True).count() == 1
    assert range_test.with_expected(outside, schedule).count() == 0


def test_a_larger_table_keeps_its_share(spark):
    kept = []
    for sf in ("sf0.01", "sf0.1"):
        raw = tables.range_raw(spark, f"/root/testdata/{sf}")
        hourly = range_test.range_hourly(raw, zone="UTC")
        total = hourly.agg(F.sum("n_det")).first()[0]
        # the schedule's hole aside
        held = range_test.with_expected(hourly, tables.range_schedule(spark)).agg(F.sum("n_det")).first()[0]
        kept.append(held / total)
    assert kept[1] >= kept[0] - 0.005 and kept[1] > 0.99
