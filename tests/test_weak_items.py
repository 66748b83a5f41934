"""Months from events, descent quantiles, saved event filters, rebalanced writes, models per group, GeoJSON, display orders."""

import datetime as dt
import glob
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pingtrail import catalog
from pingtrail.operators import events, movement, range_test, residency
from pingtrail.plans.quantiles import exact_quantiles
from pingtrail.session import scratch_path
from pingtrail.sources import tables
from pingtrail.sources.geojson import read_geojson, write_geojson
from pingtrail.sources.stages import load_stage, write_partitioned

EVENTS = "tag_id string, station_name string, protection string, scientific_name string, start_datetime timestamp_ntz, end_datetime timestamp_ntz"


def _events(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        a = dt.datetime(2022, 12, 1) + dt.timedelta(hours=rnd.randrange(900 * 24))
        b = a + dt.timedelta(hours=rnd.choice([0, 1, 30, 24 * 40, 24 * 400]))
        rows.append((rnd.choice(["1", "2", None]), rnd.choice(["a", "b"]), rnd.choice(["x", None]), "sp", a, b))
    # overlapping, nested, touching and equal events; the last days of months; a leap day
    for a, b in (("2024-01-30", "2024-03-01"), ("2024-02-10", "2024-02-12"), ("2024-03-01", "2024-03-31"), ("2024-02-29", "2024-02-29"),
                 ("2024-01-30", "2024-03-01"), ("2023-12-31", "2024-01-01")):
        rows.append(("9", "a", "x", "sp", dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)))
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("years", ["distinct", "rows"])
def test_months_of_overlapping_events(spark, years):
    ev = _events(spark)
    want = residency.monthly_days(residency.expand_days(ev), years)
    got = residency.monthly_presence(ev, years).select(*want.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    nine = {(r.year, r.month): r.n_days_present for r in got.where("tag_id = '9'").collect()}
    assert nine == {(2023, 12): 1, (2024, 1): 3, (2024, 2): 29, (2024, 3): 31}
    tags = residency.unique_tags(residency.expand_days(ev))
    assert sorted(map(repr, residency.unique_tags(residency.monthly_presence(ev)).collect())) == sorted(map(repr, tags.collect()))


def test_months_without_events(spark):
    ev = _events(spark, 0)
    assert residency.monthly_presence(ev.where("false")).collect() == []
    assert residency.monthly_presence(ev.withColumn("end_datetime", F.lit(None).cast("timestamp_ntz"))).collect() == []


@pytest.mark.parametrize("kind", ["sliver", "wide", "one", "steps"])
def test_quantiles_of_crowded_values(spark, kind):
    rnd = random.Random(3)
    far = 2**61
    values = {
        "sliver": [far, -far] + [10**15 + rnd.randrange(2000) for _ in range(3000)],
        "wide": [rnd.randrange(-far, far) for _ in range(2000)],
        "one": [5] * 100 + [far],
        "steps": [-far, far] + [10**9 * rnd.randrange(3) + rnd.randrange(3) for _ in range(500)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for cells in (65_536, 16):
        r = exact_quantiles(df, "v", probs, cells).first()
        assert (r.n, r["min"], r["max"], int(r["sum"])) == (len(values), min(values), max(values), sum(values))
        ordered = sorted(values)
        for i, p in enumerate(probs):
            pos = (len(values) - 1) * p
            lo, hi = float(ordered[math.floor(pos)]), float(ordered[min(math.floor(pos) + 1, len(values) - 1)])
            assert r[f"q_{i}"] == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)), rel=1e-12), (kind, p)


def test_quantiles_of_crowded_doubles(spark):
    rnd = random.Random(4)
    values = [1e18, -1e18] + [1.0 + rnd.random() * 1e-9 for _ in range(2000)] + [0.0] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = exact_quantiles(df, "v", [0.25, 0.5, 0.75]).first()
    assert [r.q_0, r.q_1, r.q_2] == pytest.approx(list(np.quantile(np.array(values), [0.25, 0.5, 0.75])), rel=1e-12)
    none = exact_quantiles(df.where("false"), "v", [0.5]).first()
    assert none.n is None and none.q_0 is None


BINS = "tag_id string, scientific_name string, protection string, event_id long, hour_bin timestamp_ntz, dets_in_hour long, " \
       "hour_start timestamp_ntz, hour_end timestamp_ntz"


def _bins(spark):
    rows = []
    for tag, sp, prot in (("1", "s", "p"), (None, "s", "p"), ("1", None, None), (None, None, None)):
        for event, counts in ((1, (2, 3)), (2, (1, 5)), (3, (2,))):
            for h, n in enumerate(counts):
                at = dt.datetime(2024, 1, event, 5 + h)
                rows.append((tag, sp, prot, event, at, n, at, at + dt.timedelta(minutes=50)))
    return spark.createDataFrame(rows, BINS)


def test_bins_of_saved_events(spark):
    bins = _bins(spark)
    saved = events.hourly_residency(bins, min_hours=1, min_per_hour=2)
    assert {r.event_id for r in saved.collect()} == {1} and saved.count() == 4
    by_table = events.resident_hours(bins, min_per_hour=2, event_filter=saved)
    by_window = events.resident_hours(bins, min_per_hour=2, event_filter="semi", min_hours=1)
    assert by_table.count() == 8 and sorted(map(repr, by_table.collect())) == sorted(map(repr, by_window.collect()))
    # events that are listed twice keep a bin once
    assert events.resident_hours(bins, min_per_hour=2, event_filter=saved.unionAll(saved)).count() == 8
    assert events.resident_hours(bins, min_per_hour=2, event_filter=saved.where("false")).count() == 0
    joined = events.bins_with_events(bins, saved, min_per_hour=2).collect()
    assert len(joined) == 16 and sum(r.duration_hours is not None for r in joined) == 8
    assert sorted(repr(r.hour_bin) for r in joined) == sorted(repr(r.hour_bin) for r in bins.where("dets_in_hour >= 2").collect())
    with pytest.raises(ValueError):
        events.resident_hours(bins, event_filter="anti")


def test_files_per_key_are_bounded(spark):
    rows = spark.range(200_000, numPartitions=40).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("key"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        path = write_partitioned(rows, scratch_path(spark, "keys"), "key")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {os.path.basename(d).split("=")[1]: len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path.removeprefix('file:')}/key=*")}
    hot = files.pop("hot")
    assert hot > 1  # a third of the rows is not one task's work
    # a key has the files of its own partition only, which is in as many pieces as the hot key where that is in it too
    assert max(files.values()) <= hot and sum(files.values()) < 400  # tasks x keys would be 4,000
    assert spark.read.parquet(path).count() == 200_000


def test_folders_of_small_keys_are_dealt_over_tasks(spark):
    rows = spark.range(2_000).select((F.col("id") % 200).cast("string").alias("key"), "id")
    path = write_partitioned(rows, scratch_path(spark, "small-keys"), "key").removeprefix("file:")
    files = [os.path.basename(f) for f in glob.glob(f"{path}/key=*/*.parquet")]
    assert len(files) == 200  # one file per key
    assert len({f.split("-")[1] for f in files}) > 4  # a few bytes, but not one task's work
    assert spark.read.parquet(path).count() == 2_000
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_many_folders_are_listed_by_few_tasks(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("key"), "id")
    path = write_partitioned(rows, scratch_path(spark, "listed"), "key")
    sc = spark.sparkContext
    sc.setJobGroup("listing", "load_stage")
    try:
        back = load_stage(spark, path, rows.schema)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(i).numTasks for j in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 8  # not a task per folder
    assert sorted(map(tuple, back.select("key", "id").collect())) == sorted(map(tuple, rows.collect()))


def _by_distance(spark, rows):
    return spark.createDataFrame(rows, "g string, distance double, tasa_detec double, total_expected double")


def _newton(rows, steps=40):
    x, y, n = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    X, b = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(steps):
        m = 1 / (1 + np.exp(-X @ b))
        H = X.T @ (X * (n * m * (1 - m))[:, None])
        b = b + np.linalg.solve(H, X.T @ (n * (y - m)))
    return b, np.linalg.inv(H)


def test_models_of_groups(spark):
    rnd = random.Random(2)
    rows = []
    for g in ("a", "b", None):
        slope = rnd.uniform(0.005, 0.02)
        rows += [(g, float(d), 1 / (1 + math.exp(-2 + slope * d)), float(rnd.randrange(50, 500))) for d in range(0, 500, 25)]
    rows += [("one distance", 20.0, 0.5, 10.0), ("separable", 10.0, 1.0, 5.0), ("separable", 20.0, 0.0, 5.0), ("no trials", 10.0, None, 0.0),
             ("a", None, 0.3, 10.0)]
    got = {r.g: r for r in range_test.fit_range(_by_distance(spark, rows), by=["g"]).collect()}
    for g in ("a", "b", None):
        b, cov = _newton([r for r in rows if r[0] == g and r[1] is not None])
        m = got[g]
        assert [m.b0, m.b1] == pytest.approx(list(b), rel=1e-9)
        assert [m.v00, m.v01, m.v11] == pytest.approx([cov[0, 0], cov[0, 1], cov[1, 1]], rel=1e-6) and m.max_distance == 475
    for g in ("one distance", "separable"):
        assert got[g].b0 is None and got[g].v11 is None
    assert "no trials" not in got
    curve = range_test.range_curve(range_test.fit_range(_by_distance(spark, rows), by=["g"]), n=5)
    assert curve.columns[0] == "g" and curve.count() == 5 * len(got)
    assert range_test.range_thresholds(range_test.fit_range(_by_distance(spark, rows), by=["g"])).count() == 3 * len(got)


def test_a_model_of_nothing(spark):
    empty = _by_distance(spark, [])
    (row,) = range_test.fit_range(empty).collect()
    assert tuple(row) == (None,) * 6
    assert range_test.fit_range(empty, by=["g"]).collect() == []


def test_geojson_round_trip(spark):
    rows = [("st \"1\"", 5, -71.25, -33.5), ("é\n", None, 0.0, 0.0), (None, 2, None, -33.0), ("nan", 1, float("nan"), 1.0), ("inf", 1, 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "station_name string, num_det long, longitude double, latitude double")
    path = write_geojson(df, scratch_path(spark, "geo"))
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(lines) == 5 and {x["type"] for x in lines} == {"Feature"}
    assert sum(x["geometry"] is None for x in lines) == 3
    assert [x["geometry"]["coordinates"] for x in lines if x["properties"]["num_det"] == 5] == [[-71.25, -33.5]]
    back = read_geojson(spark, path, StructType([StructField("station_name", StringType()), StructField("num_det", LongType())]))
    want = [(a, b, lo if lo is not None and la is not None and math.isfinite(lo) and math.isfinite(la) else None) for a, b, lo, la in rows]
    assert sorted(map(repr, [(r.station_name, r.num_det, r.longitude) for r in back.collect()])) == sorted(map(repr, want))


def test_display_orders(spark):
    legs = spark.createDataFrame(
        [(None, 1, "arrival", None), ("b", 2, "departure", dt.datetime(2024, 1, 2)), ("b", 2, "arrival", None), ("b", 1, "departure", dt.datetime(2024, 1, 1)),
         ("a", None, "arrival", None), ("a", 3, "arrival", dt.datetime(2024, 1, 1))],
        "tag_id string, movement_id long, movement string, datetime timestamp_ntz")
    got = [(r.tag_id, r.movement_id, r.movement) for r in movement.sorted_legs(legs.repartition(4)).collect()]
    assert got == [("a", 3, "arrival"), ("a", None, "arrival"), ("b", 1, "departure"), ("b", 2, "arrival"), ("b", 2, "departure"), (None, 1, "arrival")]
    ev = spark.createDataFrame([("b", None), ("b", dt.datetime(2024, 1, 2)), (None, dt.datetime(2023, 1, 1)), ("b", dt.datetime(2024, 1, 1)),
                                ("a", dt.datetime(2025, 1, 1))], "tag_id string, start_datetime timestamp_ntz")
    got = [(r.tag_id, r.start_datetime and r.start_datetime.year) for r in events.sorted_events(ev.repartition(3)).collect()]
    assert got == [("a", 2025), ("b", 2024), ("b", 2024), ("b", None), (None, 2023)]


def test_a_rewritten_table_gives_a_new_stage(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in tables.SCHEMAS:
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = catalog.tidy_stage(spark, str(tmp_path)).count()
    assert catalog.tidy_stage(spark, str(tmp_path)).inputFiles() == catalog.tidy_stage(spark, str(tmp_path)).inputFiles()
    spark.read.parquet(f"{source}/events.parquet").limit(100).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert catalog.tidy_stage(spark, str(tmp_path)).count() <= 100 < before
