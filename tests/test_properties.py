"""Properties from the reference's inline checks, on the driver's sf0.001 tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pingtrail import catalog
from pingtrail.functions.time import epoch_us
from pingtrail.operators import diel, events, movement, residency

SF = "/root/testdata/sf0.001"


def test_event_ids_contiguous_and_gap_rule(spark):
    tidy = catalog.tidy_for(spark, SF, 5)
    ev = events.event_ids(tidy, ["tag_id", "protection"], 3600)
    g = F.struct("tag_id", "protection")
    per = ev.groupBy(g.alias("g")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"),
                                       F.countDistinct("event_id").alias("n"))
    assert per.where("lo <> 1 OR hi <> n").count() == 0
    # inside an event every gap <= limit; every event start has gap > limit (or is the first row)
    assert ev.where("new_event = 0 AND gap_secs > 3600").count() == 0
    assert ev.where("new_event = 1 AND gap_secs IS NOT NULL AND gap_secs <= 3600").count() == 0
    # the event id increases by one exactly at starts
    w = Window.partitionBy("tag_id", "protection").orderBy("datetime", "station_name", "transmitter")
    steps = ev.withColumn("d", F.col("event_id") - F.lag("event_id", 1, 0).over(w))
    assert steps.where("d <> new_event").count() == 0


def test_days_and_rose_totals(spark):
    ev = catalog.events_multi_year(spark, SF)
    days = residency.expand_days(ev)
    expect = ev.select(F.sum(F.datediff(F.to_date("end_datetime"), F.to_date("start_datetime")) + 1)).first()[0]
    assert days.count() == expect
    tidy = catalog.tidy_for(spark, SF)
    n = tidy.count()
    for closed in ("left", "right"):
        r = diel.rose_counts(tidy, ["scientific_name"], "hour", closed)
        assert r.agg(F.sum("n")).first()[0] == n


def test_legs_double_base_and_station_frequency(spark):
    tidy = catalog.tidy_for(spark, SF)
    base = movement.movement_base(tidy)
    legs = movement.movement_legs(base)
    assert legs.count() == 2 * base.count()
    freq = legs.where("station_name IS NOT NULL").groupBy("station_name").count()
    assert freq.agg(F.sum("count")).first()[0] == legs.where("station_name IS NOT NULL").count()


def test_invariant_to_input_order_and_partitions(spark):
    tidy = catalog.tidy_for(spark, SF, 5)
    a = events.residency_events(tidy, min_days=0.0, min_detections=1)
    shuffled = tidy.repartition(13).sortWithinPartitions(F.rand(5))
    b = events.residency_events(shuffled, min_days=0.0, min_detections=1)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(a) == key(b)
    ma = movement.movement_base(tidy)
    mb = movement.movement_base(tidy.repartition(3).sortWithinPartitions(F.rand(9)))
    assert key(ma) == key(mb.select(*ma.columns))
    sa = events.event_ids(tidy, ["tag_id", "protection"], 3600)
    sb = events.event_ids(shuffled, ["tag_id", "protection"], 3600)
    assert key(sa) == key(sb.select(*sa.columns))


def test_tidy_has_no_missing_values_except_tag(spark):
    from pingtrail.operators.tidy import missing_cells
    tidy = catalog.tidy_for(spark, SF)
    bad = missing_cells(tidy).where("n_missing > 0").collect()
    assert [r.column_name for r in bad] == ["tag_id"]
    lo, hi = tidy.agg(F.min(epoch_us("datetime")), F.max(epoch_us("datetime"))).first()
    assert lo <= hi
