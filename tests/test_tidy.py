import datetime as dt

from pyspark.sql import functions as F

from pingtrail.operators.tidy import any_missing, missing_cells, six_number, station_counts, tidy_detections

RX = [("ST1", -33.5, -71.6, "MPA", "rock"), ("ST2", -33.6, -71.7, "OPEN", "sand")]
TAGS = [("A69-1602-12345", "CAP_A", "LIB_A"), ("A69-1602-SYNC", "CAP_B", "LIB_B"), ("A69-1602-2222", "CAP_C", None)]


def _inputs(spark, det):
    d = spark.createDataFrame(det, "row_id long, date_time string, date_time_utc string, transmitter string, "
                                   "receiver string, station_name string, scientific_name string")
    rx = spark.createDataFrame(RX, "station_name string, station_latitude double, station_longitude double, "
                                   "installation_name string, substrate_general string")
    tg = spark.createDataFrame(TAGS, "transmitter string, sitio_captura string, sitio_liberacion string")
    return d, rx, tg


def test_fixture_cases(spark):
    det = [
        (1, "03/01/2024 10:05", "x", "A69-1602-12345", "R1", "ST1", "Sp"),   # kept
        (2, "03/01/2024 10:05", "x", "A69-1602-12345", "R9", "ST1", "Sp"),   # duplicate key, later row: dropped
        (3, "03/01/2024 10:05", "x", "A69-1602-12345", "R1", "ST2", "Sp"),   # same minute, other station: kept
        (4, "03/01/2024 10:06", "x", "A69-1602-12345", "R1", "ST9", "Sp"),   # station not in receivers
        (5, "03/01/2024 10:07", "x", "A69-1602-99999", "R1", "ST1", "Sp"),   # transmitter not in tags
        (6, "03/01/2024 10:08", "x", "A69-1602-12345", None, "ST1", "Sp"),   # NULL cell
        (7, "99/99/2024 10:09", "x", "A69-1602-12345", "R1", "ST1", "Sp"),   # unparseable time
        (8, "03/01/2024 23:59", "x", "A69-1602-SYNC", "R1", "ST2", "Sp"),    # no trailing digits: NULL tag
        (9, "03/01/2024 00:00", "x", "A69-1602-2222", "R1", "ST1", "Sp"),    # tag row with a NULL cell
    ]
    out = tidy_detections(*_inputs(spark, det))
    got = sorted(((r.receiver, r.station_name, r.tag_id, r.hour, r.minute, r.datetime) for r in out.collect()), key=repr)
    assert got == sorted([
        ("R1", "ST1", "12345", 10, 5, dt.datetime(2024, 1, 3, 10, 5)),
        ("R1", "ST2", "12345", 10, 5, dt.datetime(2024, 1, 3, 10, 5)),
        ("R1", "ST2", None, 23, 59, dt.datetime(2024, 1, 3, 23, 59)),
    ], key=repr)
    assert out.columns[:3] == ["datetime", "transmitter", "receiver"] and "row_id" not in out.columns
    assert "date_time_utc" not in out.columns
    miss = {r.column_name: r.n_missing for r in missing_cells(out).collect()}
    assert miss["tag_id"] == 1 and sum(miss.values()) == 1
    assert any_missing(out)
    assert not any_missing(out.where(F.col("tag_id").isNotNull()))


def test_keep_first_follows_file_order(spark):
    det = [(20, "03/01/2024 10:05", "x", "A69-1602-12345", "late", "ST1", "Sp"),
           (10, "03/01/2024 10:05", "x", "A69-1602-12345", "early", "ST1", "Sp")]
    out = tidy_detections(*_inputs(spark, det))
    assert [r.receiver for r in out.collect()] == ["early"]


def test_summaries(spark):
    det = [(i, f"03/01/2024 10:0{i}", "x", "A69-1602-12345", "R1", "ST1" if i < 3 else "ST2", "Sp") for i in range(5)]
    out = tidy_detections(*_inputs(spark, det))
    counts = {r.station_name: r.num_det for r in station_counts(out).collect()}
    assert counts == {"ST1": 3, "ST2": 2}
    s = six_number(out, "datetime").collect()[0]
    assert s["min"] == dt.datetime(2024, 1, 3, 10, 0) and s["max"] == dt.datetime(2024, 1, 3, 10, 4)
    assert s["median"] == dt.datetime(2024, 1, 3, 10, 2) and s["mean"] == dt.datetime(2024, 1, 3, 10, 2)
    assert s["q1"] == dt.datetime(2024, 1, 3, 10, 1)
