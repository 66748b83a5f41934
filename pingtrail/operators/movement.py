"""Movements between consecutive detections of a tag (lead-based legs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.operators.tidy import _complete, station_counts
from pingtrail.plans.sequence import DEFAULT_CHUNK_ROWS, lead_columns

LEAD_COLUMNS = {
    "next_location": "station_name",
    "next_time": "datetime",
    "next_station_name": "station_name",
    "next_latitude": "latitude",
    "next_longitude": "longitude",
}


def movement_base(tidy: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Per tag, in time order: the next station, time and position, and a
    ``movement_id`` (row number).  ``minute``, ``hour``, ``transmitter`` and
    ``receiver`` are dropped first and rows with any NULL (e.g. a NULL tag id)
    are removed.  Ties on time break by station, then transmitter.

    One plan serves all tags: time chunks of about ``chunk_rows`` rows at most
    (:func:`pingtrail.plans.sequence.lead_columns`).  ``tidy`` is read three
    times, so pass a stage."""
    d = tidy.drop("minute", "hour", "receiver")
    d = _complete(d, [c for c in d.columns if c != "transmitter"])
    order = ["datetime", "station_name", "transmitter"]
    out = lead_columns(d, ["tag_id"], order, LEAD_COLUMNS, row_number="movement_id",
                       chunk_rows=chunk_rows)
    return out.drop("transmitter")


def movement_legs(base: DataFrame, only_moves: bool = False) -> DataFrame:
    """Two rows per base row: the departure (this detection) and the arrival
    (the next one; NULL on a tag's last row).  One pass over ``base``: each row
    emits both legs through a generator, no union.  ``only_moves`` keeps only
    legs whose next detection is at another station."""
    b = base
    if only_moves:
        b = b.where(F.col("next_location").isNotNull() & (F.col("station_name") != F.col("next_location")))

    def leg(kind, t, s, la, lo):
        return F.struct(
            F.col(t).alias("datetime"), F.col(s).alias("station_name"),
            F.col(la).alias("latitude"), F.col(lo).alias("longitude"), F.lit(kind).alias("movement"))

    legs = F.array(
        leg("departure", "datetime", "station_name", "latitude", "longitude"),
        leg("arrival", "next_time", "next_station_name", "next_latitude", "next_longitude"),
    )
    return b.select("tag_id", "movement_id", F.inline(legs)).select(
        "tag_id", "datetime", "station_name", "latitude", "longitude", "movement", "movement_id")


def movement_station_counts(legs: DataFrame) -> DataFrame:
    """Legs per station point, rows with a NULL removed (the open arrival)."""
    return station_counts(legs, drop_incomplete=True)


def sorted_legs(legs: DataFrame) -> DataFrame:
    """Display order of the legs: tag, movement, "arrival" before "departure",
    time; NULLs last.  A global sort: use only for output/inspection."""
    return legs.orderBy(*[F.asc_nulls_last(c) for c in ("tag_id", "movement_id", "movement", "datetime")])
