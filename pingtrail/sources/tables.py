"""Adapter from the driver's test tables to telemetry-shaped tables.

The reference reads three CSV files (detections, receiver info, tag info) and a
range-test CSV.  Here the same shapes are derived by Spark from the given
tables, so the work grows with them:

* detections: ``events`` (one row per ping, tag ``user_id``) joined to
  ``customer`` for species; stations are the nations (``props`` number modulo
  their number);
* receivers: ``nation`` x ``region``;
* tags: all customers (one with a non-numeric code);
* multi-year detections: ``lineitem`` (tag ``l_suppkey``; ship dates span several years);
* range test: ``events`` with a distance text derived from ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrail.functions.time import floor_time, to_ntz

# Fixed values of the test adapter.
TRANSMITTER_PREFIX = "A69-1602-"
SYNC_TRANSMITTER = "A69-1602-SYNC"
RANGE_PREFIX = "A69-1602-RANGE-"
SUBSTRATES = ["rock", "sand", "kelp"]
STATION_LAT0, STATION_LON0 = -33.5, -71.6
SYNC_TAG_KEY = 7
N_STATIONS = 25  # rows of nation, at every scale

# The columns read from each table: declared, so that opening one starts no job.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "lineitem": "l_orderkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _transmitter(code: F.Column) -> F.Column:
    return F.when(code == SYNC_TAG_KEY, F.lit(SYNC_TRANSMITTER)).otherwise(
        F.concat(F.lit(TRANSMITTER_PREFIX), (F.lit(10000) + code).cast("string")))


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receiver metadata in the shape of the receiver-info CSV."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    k = F.col("n_nationkey").cast("double")
    return (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("n_name").alias("station_name"),
            (F.lit(STATION_LAT0) - k / 100).alias("station_latitude"),
            (F.lit(STATION_LON0) - k / 100).alias("station_longitude"),
            F.col("r_name").alias("installation_name"),
            F.element_at(F.array(*[F.lit(s) for s in SUBSTRATES]),
                         (F.col("n_nationkey") % len(SUBSTRATES) + 1).cast("int")).alias("substrate_general"),
        )
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag metadata in the shape of the (cleaned) tag-info CSV."""
    c = table(spark, sf_dir, "customer")
    return (
        c.select(
            _transmitter(F.col("c_custkey")).alias("transmitter"),
            F.concat(F.lit("CAP_"), (F.col("c_nationkey") % 3).cast("string")).alias("sitio_captura"),
            F.concat(F.lit("LIB_"), (F.col("c_nationkey") % 4).cast("string")).alias("sitio_liberacion"),
        )
    )


def detections(spark: SparkSession, sf_dir: str, n_stations: int = N_STATIONS) -> DataFrame:
    """Raw detections (``row_id`` keeps file order): one row per ``events`` row
    whose tag code has a customer row."""
    ev = table(spark, sf_dir, "events")
    code = F.col("user_id")
    species = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("__code"), F.col("c_mktsegment").alias("scientific_name"))
    station_no = F.regexp_extract(F.col("props"), "[0-9]+", 0).try_cast("int") % n_stations
    raw = ev.select(
        F.col("event_id").alias("row_id"),
        floor_time(F.col("ts"), 60_000_000).alias("date_time"),
        _transmitter(code).alias("transmitter"),
        F.col("event_type").alias("receiver"),
        F.concat(F.lit("NATION_"), station_no.cast("string")).alias("station_name"),
        code.alias("__code"),
    )
    return (
        raw.join(species, "__code", "inner")
        .select("row_id", "date_time", "transmitter", "receiver", "station_name", "scientific_name")
    )


def detections_multi_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections spanning several years, from ``lineitem`` ship dates:
    tag ``l_suppkey``, station ``l_linenumber``."""
    li = table(spark, sf_dir, "lineitem")
    code = F.col("l_suppkey")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        to_ntz(F.col("l_shipdate")).alias("date_time"),
        F.concat(F.lit(TRANSMITTER_PREFIX), (F.lit(10000) + code).cast("string")).alias("transmitter"),
        F.concat(F.lit("RX_"), F.col("l_linenumber").cast("string")).alias("receiver"),
        F.concat(F.lit("NATION_"), F.col("l_linenumber").cast("string")).alias("station_name"),
        F.concat(F.lit("SPECIES_"), (code % 4).cast("string")).alias("scientific_name"),
    )


def range_raw(spark: SparkSession, sf_dir: str, bin_m: int = 20) -> DataFrame:
    """Range-test rows in the shape of the range-test CSV (text date and time,
    distance as "<n> metros"); the transmitter is the user's, so the cells of an
    hour, receiver, transmitter and distance grow with the table."""
    ev = table(spark, sf_dir, "events")
    ts = to_ntz(F.col("ts"))
    return ev.select(
        F.format_string("%02d-%02d-%02d", F.dayofmonth(ts), F.month(ts), F.year(ts) % 100).alias("date_utc"),
        F.format_string("%02d:%02d:%02d", F.hour(ts), F.minute(ts), F.second(ts)).alias("time_utc"),
        F.col("event_type").alias("receiver"),
        F.concat(F.lit(RANGE_PREFIX), F.col("user_id").cast("string")).alias("transmitter"),
        F.concat((F.floor(F.col("value") / bin_m) * bin_m).cast("int").cast("string"), F.lit(" metros")).alias("distance"),
    )


# Expected pings per hour of the range-test adapter (closed windows).
RANGE_SCHEDULE = [
    ("2024-01-01 00:00:00", "2024-01-15 23:00:00", 24.0),
    ("2024-01-16 00:00:00", "2024-01-30 22:00:00", 6.0),
]
# A schedule that starts and ends at any minute, with an overlap (the first window wins) and a gap.
HALF_HOUR_SCHEDULE = [
    ("2024-01-01 10:30:00", "2024-01-04 09:30:00", 12.0),
    ("2024-01-04 08:45:00", "2024-01-09 17:15:00", 3.0),
    ("2024-01-10 00:30:00", "2024-01-24 23:29:59", 6.0),
]
# A schedule in local time.
LOCAL_SCHEDULE = [
    ("2023-12-31 21:00:00", "2024-01-15 16:30:00", 24.0),
    ("2024-01-15 17:00:00", "2024-01-30 18:00:00", 6.0),
]
LOCAL_ZONE = "America/Santiago"


def range_schedule(spark: SparkSession, rows=RANGE_SCHEDULE) -> DataFrame:
    """Schedule table: ``window_start``, ``window_end`` (closed, NTZ), ``expected``,
    ``priority`` (first matching window wins)."""
    values = ", ".join(f"(timestamp_ntz'{a}', timestamp_ntz'{b}', {float(e)!r}D, {i})" for i, (a, b, e) in enumerate(rows))
    # a local relation: its size is known to the planner
    return spark.sql(f"SELECT * FROM VALUES {values} AS schedule(window_start, window_end, expected, priority)")
