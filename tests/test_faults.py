"""Cases outside the test tables: DST, short windows, quoting, ties, missing times, definition-time jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pingtrail import catalog
from pingtrail.functions.text import parse_number
from pingtrail.operators import events, range_test, tidy
from pingtrail.plans.sequence import lead_columns, number_rows
from pingtrail.session import scratch_path
from pingtrail.sources import tables
from pingtrail.sources.delimited import read_delimited

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("window, hours", [(("10:15", "10:45"), 0), (("10:00", "11:00"), 2), (("10:15", "11:00"), 1)])
def test_schedule_covers_whole_hours_only(spark, window, hours):
    s = tables.range_schedule(spark, [(f"2024-01-01 {window[0]}:00", f"2024-01-01 {window[1]}:00", 6.0)])
    assert range_test.schedule_hours(s).count() == hours


def test_hours_of_the_clock_change_stay_apart(spark):
    raw = spark.createDataFrame([("03-04-22", "02:30:00"), ("03-04-22", "03:30:00")], "date_utc string, time_utc string")
    raw = raw.withColumns({"receiver": F.lit("r"), "transmitter": F.lit("t"), "distance": F.lit("20 metros")})
    rows = range_test.range_hourly(raw, "America/Santiago").collect()
    assert [r.n_det for r in rows] == [1, 1] and len({r.hour_time for r in rows}) == 1


def test_quotes_backslashes_and_blanks_in_csv(spark):
    path = scratch_path(spark, "csv")
    lines = ['a,b', '"say ""hi"" x",1', '"back\\",2', '" pad ", 3']
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(path)
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    assert {(r.a, r.b) for r in read_delimited(spark, path, schema).collect()} == {('say "hi" x', "1"), ("back\\", "2"), ("pad", "3")}
    doubled = read_delimited(spark, path, schema, escape_double=False)
    assert doubled.where("b = '1'").first().a == 'say ""hi"" x'


def test_numbers_with_a_leading_point_and_a_grid_of_one(spark):
    row = spark.sql("select '.5 m' a, '1,250 m' b, '-3.25' c, 'x' d").select(*[parse_number(c).alias(c) for c in "abcd"]).first()
    assert tuple(row) == (0.5, 1250.0, -3.25, None)
    model = spark.sql("select 1D b0, -0.01D b1, 0.1D v00, 0D v01, 0.001D v11, 300D max_distance")
    assert [r.distance for r in range_test.range_curve(model, n=1).collect()] == [0.0]


def test_keep_first_with_two_metadata_rows_of_a_station(spark):
    det = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "A-1234", "r", "s", "sp")],
                                "row_id long, date_time timestamp_ntz, transmitter string, receiver string, station_name string, scientific_name string")
    rx = spark.createDataFrame([("s", 1.0, 2.0, "p2", "x"), ("s", 1.0, 2.0, "p1", "x")],
                               "station_name string, station_latitude double, station_longitude double, installation_name string, substrate_general string")
    tags = spark.createDataFrame([("A-1234", "c", "l")], "transmitter string, sitio_captura string, sitio_liberacion string")
    for order in (rx, rx.orderBy("installation_name")):
        assert [r.protection for r in tidy.tidy_detections(det, order.repartition(3), tags).collect()] == ["p1"]


def test_rows_without_a_time_stay(spark):
    rows = [("a", None, 1), ("a", dt.datetime(2024, 1, 1), 2), ("a", dt.datetime(2024, 1, 5), 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v int")
    plans = [sorted((r.v, r.n, r.nxt) for r in lead_columns(df, ["k"], ["t", "v"], {"nxt": "v"}, row_number="n", chunk_rows=m)
                    .fillna(-1, ["nxt"]).collect()) for m in (10, 1)]
    assert plans[0] == plans[1] and len(plans[0]) == 4
    assert dict(number_rows(df, ["k"], ["t", "v"], out="n").dtypes)["n"] == "bigint"


def test_hourly_bins_by_other_keys(spark):
    df = spark.createDataFrame([("1", "s", "sp", dt.datetime(2024, 1, 1, 0, m)) for m in (0, 5, 10)],
                               "tag_id string, station_name string, scientific_name string, datetime timestamp_ntz")
    (row,) = events.hourly_bins(df, keys=["tag_id", "station_name"]).collect()
    assert row.dets_in_hour == 3 and row.station_name == "s"


def test_more_input_gives_more_tidy_rows(spark):
    small, large = (catalog.tidy_for(spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01"))
    assert small > 900 and large > 9 * small
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert catalog.tidy_for(spark, SF).count() > 0.95 * n


def test_opening_tables_and_tidying_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("definition", "")
    catalog.tidy_for(spark, SF)
    catalog.q_range_expected(spark, SF)
    assert tracker.getJobIdsForGroup("definition") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
