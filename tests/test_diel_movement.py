from pyspark.sql import functions as F

from helpers import detections_df
from pingtrail.operators.diel import rose_counts, tag_roses
from pingtrail.operators.movement import movement_base, movement_legs, movement_station_counts


def test_bins_left_and_right_closed(spark):
    df = spark.createDataFrame([(0,), (1,), (23,), (1,)], "hour int").withColumn("k", F.lit("a"))
    left = {r.bin_start: r.n for r in rose_counts(df, ["k"], "hour", "left").collect()}
    right = {r.bin_start: r.n for r in rose_counts(df, ["k"], "hour", "right").collect()}
    assert left == {0: 1, 1: 2, 23: 1}
    assert right == {0: 3, 22: 1}
    assert sum(left.values()) == sum(right.values()) == df.count()


def test_tag_roses_species_label(spark):
    hours = spark.createDataFrame([("1", "SpB", "MPA", 5), ("1", "SpA", "OPEN", 6), (None, "SpC", "MPA", 0)],
                                  "tag_id string, scientific_name string, protection string, hour_of_day int")
    got = {(r.tag_id, r.protection): (r.bin_start, r.n, r.species) for r in tag_roses(hours).collect()}
    assert got == {("1", "MPA"): (4, 1, "SpA"), ("1", "OPEN"): (5, 1, "SpA"), (None, "MPA"): (0, 1, "SpC")}


def test_movements(spark):
    df = detections_df(spark, [
        ("2024-01-01 00:00:00", "A69-1602-12345", "ST1", "MPA"),
        ("2024-01-01 00:00:00", "A69-1602-12345", "ST2", "MPA"),   # same minute: station breaks the tie
        ("2024-01-03 05:00:00", "A69-1602-12345", "ST1", "MPA"),
        ("2024-01-01 00:00:00", "A69-1602-SYNC", "ST1", "MPA"),    # NULL tag: dropped
    ])
    base = movement_base(df).orderBy("movement_id").collect()
    assert [(r.movement_id, r.station_name, r.next_station_name) for r in base] == [
        (1, "ST1", "ST2"), (2, "ST2", "ST1"), (3, "ST1", None)]
    legs = movement_legs(movement_base(df))
    assert legs.count() == 2 * len(base)
    assert legs.where("movement = 'arrival' AND datetime IS NULL").count() == 1
    counts = {r.station_name: r.num_det for r in movement_station_counts(legs).collect()}
    assert counts == {"ST1": 3, "ST2": 2}
    moves = movement_legs(movement_base(df), only_moves=True)
    assert moves.count() == 4
