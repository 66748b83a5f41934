import datetime as dt

from pyspark.sql import functions as F

from pingtrail.functions.text import clean_name, clean_names, parse_number, trailing_digits
from pingtrail.functions.time import (
    US_PER_DAY, US_PER_HOUR, epoch_us, floor_time, from_epoch_us, month_label, parse_date_time, parse_dmy_hm,
    round_ratio_half_up, shift_zone,
)


def test_parse_dmy_hm_separators_and_failures(spark):
    df = spark.createDataFrame([("03/01/2024 10:05",), ("3-1-24 10.05",), ("31/02/2024 10:00",), ("junk",), (None,),
                                ("03/01/2024",)], "s string")
    got = [r[0] for r in df.select(parse_dmy_hm("s")).collect()]
    assert got[0] == dt.datetime(2024, 1, 3, 10, 5)
    assert got[1] == dt.datetime(2024, 1, 3, 10, 5)
    assert got[2:] == [None, None, None, None]


def test_two_digit_years_follow_posix_rule(spark):
    df = spark.createDataFrame([("01-02-21", "20:00:05"), ("01-02-70", "00:00:00")], "d string, t string")
    got = [r[0] for r in df.select(parse_date_time("d", "t")).collect()]
    assert got == [dt.datetime(2021, 2, 1, 20, 0, 5), dt.datetime(1970, 2, 1, 0, 0, 0)]


def test_time_arithmetic_ignores_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 7),)], "t timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        results = []
        for zone in ("UTC", "America/Santiago", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            results.append(df.select(epoch_us("t"), floor_time("t", US_PER_HOUR), F.hour("t")).collect()[0])
        assert len(set(tuple(r) for r in results)) == 1
        assert results[0][1] == dt.datetime(2024, 3, 10, 2, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_epoch_roundtrip_and_zone_shift(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 12, 16, 20, 0, 5),)], "t timestamp_ntz")
    r = df.select(from_epoch_us(epoch_us("t")), shift_zone("t", "America/Santiago"), shift_zone("t", "UTC")).collect()[0]
    assert r[0] == dt.datetime(2021, 12, 16, 20, 0, 5)
    assert r[1] == dt.datetime(2021, 12, 16, 17, 0, 5)
    assert r[2] == dt.datetime(2021, 12, 16, 20, 0, 5)


def test_round_half_up_on_ties(spark):
    # 36 minutes = 0.025 days exactly; 0.005 days = 7.2 minutes
    df = spark.createDataFrame([(36 * 60 * 10**6,), (0,), (US_PER_DAY * 3 // 2,), (432 * 10**6,)], "us long")
    got = [r[0] for r in df.select(round_ratio_half_up("us", US_PER_DAY, 2)).collect()]
    assert got == [0.03, 0.0, 1.5, 0.01]


def test_clean_names():
    assert clean_name("Date_Time_UTC") == "date_time_utc"
    assert clean_name("Sitio Captura") == "sitio_captura"
    assert clean_name("stationName") == "station_name"
    assert clean_name("...1") == "x1"
    assert clean_name("Distancia (m)") == "distancia_m"


def test_clean_names_dedupes(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a_b` int")
    assert clean_names(df).columns == ["a_b", "a_b_2"]


def test_parse_number_and_trailing_digits(spark):
    df = spark.createDataFrame([("150 metros", "A69-1602-12345"), ("1,250.5 m", "A69-1602-SYNC"), ("none", "X-123")],
                               "d string, t string")
    got = df.select(parse_number("d"), trailing_digits("t")).collect()
    assert [tuple(r) for r in got] == [(150.0, "12345"), (1250.5, None), (None, None)]


def test_month_label(spark):
    got = [r[0] for r in spark.range(1, 13).select(month_label(F.col("id").cast("int"))).collect()]
    assert got[0] == "Jan" and got[11] == "Dec" and len(set(got)) == 12
