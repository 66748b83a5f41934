"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the work list, over the driver's tables through the adapter in
:mod:`pingtrail.sources.tables`.  The matching DuckDB SQL is in
:mod:`pingtrail.oracle`; columns and rounding agree between the two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StringType, StructField, StructType

from pingtrail.functions.time import parse_dmy_hm
from pingtrail.operators import diel, events, movement, range_test, residency, tidy, timeline
from pingtrail.session import files_state, scratch_path
from pingtrail.sources import tables
from pingtrail.sources.delimited import read_delimited
from pingtrail.sources.geojson import read_geojson, write_geojson
from pingtrail.sources.stages import load_stage, save_stage

# With a tag per user a tag has tens of pings: a three-day gap and hourly events
# of a quarter of an hour select events at every scale.
STATION_GAP_SECS = 3 * 86_400
MIN_DAYS = 1.0
MIN_HOURS, MIN_PER_HOUR = 0.25, 1
# The two-per-hour rule, on one tag per species.
STRICT_HOURS, STRICT_PER_HOUR = 1, 2
ENTRY_STATIONS = 5
MULTI_YEAR_GAP_SECS = 10 * 86_400
HALF_HOUR_US = 1_800_000_000

# Decimal places for floating results computed in a different order by the
# two engines (means, SDs, model outputs).
STAT_PLACES = 9
MODEL_PLACES = 6
COV_PLACES = 12
CURVE_POINTS = 200
CURVE_Z = 1.96
THRESHOLD_PROBS = (0.05, 0.5, 0.95)


def round_doubles(df: DataFrame, places: int, only=None) -> DataFrame:
    cols = {
        f.name: F.round(F.col(f.name), places)
        for f in df.schema.fields
        if isinstance(f.dataType, (DoubleType, FloatType)) and (only is None or f.name in only)
    }
    return df.withColumns(cols) if cols else df


# --- shared stages -------------------------------------------------------------

def tidy_for(spark: SparkSession, sf_dir: str, n_stations: int = tables.N_STATIONS) -> DataFrame:
    return tidy.tidy_detections(
        tables.detections(spark, sf_dir, n_stations),
        tables.receivers(spark, sf_dir),
        tables.tags(spark, sf_dir),
    )


_STAGES: dict[tuple, tuple[str, StructType]] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """``build(spark, sf_dir)`` as a stage, written once per session and state of the
    folder's tables (operators that read their input more than once start from it)."""
    state = tuple((t, files_state(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")) for t in sorted(tables.SCHEMAS))
    key = (spark.sparkContext.applicationId, sf_dir, name, state)
    if key not in _STAGES:
        df = build(spark, sf_dir)
        _STAGES[key] = save_stage(df, scratch_path(spark, name)), df.schema
    path, schema = _STAGES[key]
    return load_stage(spark, path, schema)


def tidy_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "tidy", tidy_for)


def tidy_multi_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy.tidy_detections(
        tables.detections_multi_year(spark, sf_dir), tables.receivers(spark, sf_dir), tables.tags(spark, sf_dir))


def tidy_multi_year_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "tidy-multi-year", tidy_multi_year)


def events_multi_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.residency_events(tidy_multi_year_stage(spark, sf_dir), min_days=MIN_DAYS,
                                   max_gap_secs=MULTI_YEAR_GAP_SECS)


def days_multi_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residency.expand_days(events_multi_year(spark, sf_dir))


def months_multi_year(spark: SparkSession, sf_dir: str, years: str = "distinct") -> DataFrame:
    return residency.monthly_presence(events_multi_year(spark, sf_dir), years=years)


def _base(spark, sf):
    return movement.movement_base(tidy_stage(spark, sf))


def _legs(spark, sf):
    return movement.movement_legs(_base(spark, sf))


def _hourly_ids(spark, sf):
    return events.event_ids(tidy_stage(spark, sf), ["tag_id", "protection"], 3600)


def _bins(spark, sf):
    return events.hourly_bins(tidy_stage(spark, sf), ["tag_id", "protection"], 3600)


def _zone_bins(spark, sf):
    """Bins by zone alone: the detections of all tags of a species, many per hour."""
    return events.hourly_bins(_one_tag_per_species(tidy_stage(spark, sf)), ["tag_id", "protection"], 3600)


def _one_tag_per_species(detections: DataFrame) -> DataFrame:
    """Detections under one tag per species, so that hours hold many of them."""
    return detections.withColumn("tag_id", F.col("scientific_name"))


def _strict_events(spark, sf):
    return events.hourly_residency(_zone_bins(spark, sf), min_hours=STRICT_HOURS, min_per_hour=STRICT_PER_HOUR)


def _range_rates(spark, sf):
    hourly = range_test.range_hourly(tables.range_raw(spark, sf), zone="UTC")
    return range_test.with_expected(hourly, tables.range_schedule(spark))


def _range_model(spark, sf):
    return range_test.fit_range(range_test.range_by_distance(_range_rates(spark, sf)))


# --- queries -----------------------------------------------------------------------

DETECTIONS_CSV_HEADER = ["...1", "Date_Time", "Date_Time_UTC", "transmitter", "receiver", "station_name",
                         "scientific_name"]


def q_parse_detections(spark, sf):
    """Detections written as the reference's CSV (row index, day-first text
    times, original header), read back with a schema, first column dropped,
    names cleaned and times parsed."""
    raw = tables.detections(spark, sf)
    t = F.col("date_time")
    text = F.format_string("%02d/%02d/%04d %02d:%02d", F.dayofmonth(t), F.month(t), F.year(t), F.hour(t), F.minute(t))
    csv = raw.select(F.col("row_id"), text, text, "transmitter", "receiver", "station_name", "scientific_name")
    csv = csv.toDF(*DETECTIONS_CSV_HEADER)
    path = scratch_path(spark, "detections-csv")
    csv.write.mode("overwrite").option("header", "true").csv(path)
    schema = StructType([StructField(DETECTIONS_CSV_HEADER[0], LongType())] +
                        [StructField(c, StringType()) for c in DETECTIONS_CSV_HEADER[1:]])
    df = read_delimited(spark, path, schema, sep=",", drop_first=True, clean_names=True)
    return df.select(parse_dmy_hm("date_time").alias("datetime"), "transmitter", "receiver", "station_name",
                     "scientific_name")


RECEIVER_CSV_HEADER = ["station_name", "station_latitude", "station_longitude", "installation_name",
                       "substrate_general"]
TAG_CSV_HEADER = ["Transmitter", "Sitio Captura", "Sitio Liberacion"]


def q_csv_tidy_detections(spark, sf):
    """The three input files of the reference's first step, written from the
    driver's tables (detections and receivers with ``,``; tag info with ``;``,
    padded values and unclean headers) and read back through
    :func:`read_delimited`; then tidied."""
    raw = tables.detections(spark, sf)
    t = F.col("date_time")
    text = F.format_string("%02d/%02d/%04d %02d:%02d", F.dayofmonth(t), F.month(t), F.year(t), F.hour(t), F.minute(t))
    det_path, rx_path, tag_path = (scratch_path(spark, n) for n in ("det-csv", "rx-csv", "tag-csv"))
    (raw.select(F.col("row_id"), text, text, "transmitter", "receiver", "station_name", "scientific_name")
     .toDF(*DETECTIONS_CSV_HEADER).write.mode("overwrite").option("header", "true").csv(det_path))
    tables.receivers(spark, sf).toDF(*RECEIVER_CSV_HEADER).write.mode("overwrite").option("header", "true").csv(rx_path)
    pad = lambda c: F.concat(F.lit("  "), F.col(c), F.lit(" "))
    (tables.tags(spark, sf).select(pad("transmitter"), pad("sitio_captura"), pad("sitio_liberacion"))
     .toDF(*TAG_CSV_HEADER).write.mode("overwrite").option("header", "true").option("sep", ";").csv(tag_path))
    det = read_delimited(spark, det_path, StructType(
        [StructField(DETECTIONS_CSV_HEADER[0], LongType())] +
        [StructField(c, StringType()) for c in DETECTIONS_CSV_HEADER[1:]]), clean_names=True)
    det = det.withColumnRenamed("x1", "row_id")
    rx = read_delimited(spark, rx_path, StructType(
        [StructField("station_name", StringType()), StructField("station_latitude", DoubleType()),
         StructField("station_longitude", DoubleType()), StructField("installation_name", StringType()),
         StructField("substrate_general", StringType())]))
    tg = read_delimited(spark, tag_path, StructType([StructField(c, StringType()) for c in TAG_CSV_HEADER]),
                        sep=";", clean_names=True)
    return tidy.tidy_detections(det, rx, tg)


def q_stage_roundtrip(spark, sf):
    df = tidy_for(spark, sf)
    path = save_stage(df, scratch_path(spark, "tidy-stage"))
    return load_stage(spark, path, df.schema)


def q_tidy(spark, sf):
    return tidy_for(spark, sf)


def q_missing_cells(spark, sf):
    return tidy.missing_cells(tidy_for(spark, sf))


def q_distinct_species(spark, sf):
    return tidy.distinct_values(tidy_for(spark, sf), "scientific_name")


def q_station_frequency(spark, sf):
    return tidy.frequency(_legs(spark, sf), "station_name")


def q_datetime_summary(spark, sf):
    return tidy.six_number(tidy_stage(spark, sf), "datetime")


def q_station_counts(spark, sf):
    return tidy.station_counts(tidy_for(spark, sf))


def q_movement_base(spark, sf):
    return _base(spark, sf)


def q_movement_legs(spark, sf):
    return _legs(spark, sf)


def q_movement_station_counts(spark, sf):
    return movement.movement_station_counts(_legs(spark, sf))


def q_residency_events(spark, sf):
    return events.residency_events(tidy_stage(spark, sf), min_days=MIN_DAYS, max_gap_secs=STATION_GAP_SECS)


def q_residency_event_rows(spark, sf):
    return events.residency_events(tidy_stage(spark, sf), min_days=MIN_DAYS, max_gap_secs=STATION_GAP_SECS,
                                   per="detection")


def q_residency_days(spark, sf):
    return days_multi_year(spark, sf)


def q_monthly_days(spark, sf):
    return months_multi_year(spark, sf)


def q_days_per_year(spark, sf):
    return months_multi_year(spark, sf, "rows")


STATION_KEYS = ["station_name", "protection", "scientific_name", "month"]
PROTECTION_KEYS = ["protection", "scientific_name", "month"]


def q_mean_residency_station(spark, sf):
    m = months_multi_year(spark, sf)
    return round_doubles(residency.mean_residency(m, STATION_KEYS, se="tags"), STAT_PLACES)


def q_mean_residency_protection(spark, sf):
    m = months_multi_year(spark, sf)
    return round_doubles(residency.mean_residency(m, PROTECTION_KEYS, se="tags"), STAT_PLACES)


def q_mean_residency_station_se_rows(spark, sf):
    m = months_multi_year(spark, sf, "rows")
    return round_doubles(residency.mean_residency(m, STATION_KEYS, se="rows"), STAT_PLACES)


def q_unique_tags(spark, sf):
    return residency.unique_tags(months_multi_year(spark, sf))


def q_unique_tags_stacked_station(spark, sf):
    return residency.stacked_totals(residency.unique_tags(months_multi_year(spark, sf)), STATION_KEYS)


def q_station_points(spark, sf):
    points = tidy.as_points(tidy.station_counts(tidy_for(spark, sf)))
    return points.select("station_name", F.col("geometry.lon").alias("longitude"),
                         F.col("geometry.lat").alias("latitude"), "num_det")


def q_unique_tags_stacked(spark, sf):
    return residency.stacked_totals(residency.unique_tags(months_multi_year(spark, sf)))


def q_rose_detections(spark, sf):
    return diel.rose_detections(tidy_for(spark, sf))


def q_rose_partitions(spark, sf):
    rose = diel.rose_detections(tidy_for(spark, sf))
    path = diel.write_roses(rose, scratch_path(spark, "roses"), "scientific_name")
    return load_stage(spark, path, rose.schema).select(*rose.columns)


def q_hourly_event_ids(spark, sf):
    return _hourly_ids(spark, sf)


def q_hour_bins(spark, sf):
    return _bins(spark, sf)


def q_hourly_residency(spark, sf):
    return events.hourly_residency(_bins(spark, sf), min_hours=MIN_HOURS, min_per_hour=MIN_PER_HOUR)


def q_resident_hours(spark, sf):
    return events.resident_hours(_bins(spark, sf), min_per_hour=MIN_PER_HOUR, event_filter="none")


def q_resident_hours_semi(spark, sf):
    return events.resident_hours(_bins(spark, sf), min_per_hour=MIN_PER_HOUR, event_filter="semi",
                                 min_hours=MIN_HOURS)


def q_rose_resident_hours(spark, sf):
    return diel.rose_resident_hours(events.resident_hours(_bins(spark, sf), min_per_hour=MIN_PER_HOUR))


def q_abacus(spark, sf):
    return timeline.abacus(tidy_stage(spark, sf))


def q_tag_roses(spark, sf):
    roses = diel.tag_roses(events.resident_hours(_bins(spark, sf), min_per_hour=MIN_PER_HOUR))
    path = diel.write_roses(roses, scratch_path(spark, "tag-roses"), "tag_id")
    return load_stage(spark, path, roses.schema).select(*roses.columns)


def q_residency_station_frequency(spark, sf):
    return tidy.frequency(events.residency_events(tidy_stage(spark, sf), min_days=MIN_DAYS, max_gap_secs=STATION_GAP_SECS), "station_name")


def q_range_datetime_summary(spark, sf):
    return tidy.six_number(range_test.range_detections(tables.range_raw(spark, sf), zone="UTC"), "datetime")


def _means(spark, sf):
    m = months_multi_year(spark, sf)
    return residency.mean_residency(m, STATION_KEYS, se="tags")


def q_mean_residency_summary(spark, sf):
    means = _stage(spark, sf, "mean-residency", _means)
    return round_doubles(tidy.numeric_summary(means, "mean_days_present"), STAT_PLACES)


def q_range_hourly(spark, sf):
    return range_test.range_hourly(tables.range_raw(spark, sf), zone="UTC")


def q_range_hourly_local(spark, sf):
    return range_test.range_hourly(tables.range_raw(spark, sf), zone=tables.LOCAL_ZONE, keep_instant=True)


def q_range_expected_local(spark, sf):
    schedule = tables.range_schedule(spark, tables.LOCAL_SCHEDULE)
    return range_test.with_expected(q_range_hourly_local(spark, sf), schedule, zone=tables.LOCAL_ZONE)


def q_range_expected_half_hours(spark, sf):
    half_hours = range_test.range_hourly(tables.range_raw(spark, sf), zone="UTC", bin_us=HALF_HOUR_US)
    return range_test.with_expected(half_hours, tables.range_schedule(spark, tables.HALF_HOUR_SCHEDULE), require_rows=True)


def q_range_models(spark, sf):
    """A model per receiver."""
    m = range_test.fit_range(range_test.range_by_distance(_range_rates(spark, sf), by=["receiver"]), by=["receiver"])
    m = round_doubles(m, MODEL_PLACES, only=("b0", "b1", "max_distance"))
    return round_doubles(m, COV_PLACES, only=("v00", "v01", "v11"))


def q_hourly_residency_strict(spark, sf):
    return _strict_events(spark, sf)


def q_resident_hours_of_events(spark, sf):
    """Bins of a saved table of events."""
    return events.resident_hours(_zone_bins(spark, sf), min_per_hour=STRICT_PER_HOUR,
                                 event_filter=_stage(spark, sf, "strict-events", _strict_events))


def q_bins_with_events(spark, sf):
    return events.bins_with_events(_zone_bins(spark, sf), _stage(spark, sf, "strict-events", _strict_events),
                                   min_per_hour=STRICT_PER_HOUR)


def q_station_geojson(spark, sf):
    """The station points written as GeoJSON and read back."""
    counts = tidy.station_counts(tidy_for(spark, sf))
    path = write_geojson(counts, scratch_path(spark, "stations-geojson"))
    properties = StructType([StructField("station_name", StringType()), StructField("num_det", LongType())])
    return read_geojson(spark, path, properties).select(*counts.columns)


def q_range_expected(spark, sf):
    return _range_rates(spark, sf)


def q_range_by_distance(spark, sf):
    return range_test.range_by_distance(_range_rates(spark, sf))


def q_range_model(spark, sf):
    m = round_doubles(_range_model(spark, sf), MODEL_PLACES, only=("b0", "b1", "max_distance"))
    return round_doubles(m, COV_PLACES, only=("v00", "v01", "v11"))


def q_range_curve(spark, sf):
    curve = range_test.range_curve(_range_model(spark, sf), n=CURVE_POINTS, z=CURVE_Z)
    return round_doubles(curve, MODEL_PLACES)


def q_range_thresholds(spark, sf):
    return round_doubles(range_test.range_thresholds(_range_model(spark, sf), THRESHOLD_PROBS), MODEL_PLACES - 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_detections": q_parse_detections,
    "csv_tidy_detections": q_csv_tidy_detections,
    "stage_roundtrip": q_stage_roundtrip,
    "tidy_detections": q_tidy,
    "missing_cells": q_missing_cells,
    "distinct_species": q_distinct_species,
    "station_frequency": q_station_frequency,
    "datetime_summary": q_datetime_summary,
    "station_counts": q_station_counts,
    "movement_base": q_movement_base,
    "movement_legs": q_movement_legs,
    "movement_station_counts": q_movement_station_counts,
    "residency_events": q_residency_events,
    "residency_event_rows": q_residency_event_rows,
    "residency_days": q_residency_days,
    "monthly_days": q_monthly_days,
    "days_per_year": q_days_per_year,
    "rose_detections": q_rose_detections,
    "mean_residency_station": q_mean_residency_station,
    "mean_residency_protection": q_mean_residency_protection,
    "mean_residency_station_se_rows": q_mean_residency_station_se_rows,
    "unique_tags": q_unique_tags,
    "unique_tags_stacked": q_unique_tags_stacked,
    "unique_tags_stacked_station": q_unique_tags_stacked_station,
    "station_points": q_station_points,
    "rose_partitions": q_rose_partitions,
    "hourly_event_ids": q_hourly_event_ids,
    "hour_bins": q_hour_bins,
    "hourly_residency": q_hourly_residency,
    "resident_hours": q_resident_hours,
    "resident_hours_semi": q_resident_hours_semi,
    "rose_resident_hours": q_rose_resident_hours,
    "abacus": q_abacus,
    "tag_roses": q_tag_roses,
    "residency_station_frequency": q_residency_station_frequency,
    "range_datetime_summary": q_range_datetime_summary,
    "mean_residency_summary": q_mean_residency_summary,
    "range_hourly": q_range_hourly,
    "range_expected": q_range_expected,
    "range_by_distance": q_range_by_distance,
    "range_model": q_range_model,
    "range_curve": q_range_curve,
    "range_thresholds": q_range_thresholds,
    "range_hourly_local": q_range_hourly_local,
    "range_expected_local": q_range_expected_local,
    "range_expected_half_hours": q_range_expected_half_hours,
    "range_models": q_range_models,
    "hourly_residency_strict": q_hourly_residency_strict,
    "resident_hours_of_events": q_resident_hours_of_events,
    "bins_with_events": q_bins_with_events,
    "station_geojson": q_station_geojson,
}


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: detections -> tidy -> station residency events."""
    return events.residency_events(tidy_for(spark, sf_dir, ENTRY_STATIONS), min_days=MIN_DAYS,
                                   max_gap_secs=STATION_GAP_SECS)

