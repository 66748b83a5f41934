"""Hour-of-day (diel) counts: the tables behind rose charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.sources.stages import write_partitioned


def hour_bin(hour_col: str, closed: str = "left"):
    """Start of the one-hour bin (breaks 0..24) holding an integer hour.

    ``left``: [h, h+1).  ``right``: (h-1, h] with the first bin closed, [0, 1],
    so hours 0 and 1 share bin 0 and the last bin (23, 24] stays empty."""
    h = F.col(hour_col)
    if closed == "left":
        return h
    if closed == "right":
        return F.greatest(h - 1, F.lit(0))
    raise ValueError("closed must be 'left' or 'right'")


def hour_label(col) -> F.Column:
    """Clock label of an hour of day: 7 -> "07:00"."""
    return F.format_string("%02d:00", F.col(col) if isinstance(col, str) else col)


def rose_counts(df: DataFrame, keys: Sequence[str], hour_col: str = "hour", closed: str = "left") -> DataFrame:
    """Rows per ``keys`` and hour bin: ``bin_start``, ``bin_end``, ``n`` and the
    clock label of the bin start (``"07:00"``)."""
    b = hour_bin(hour_col, closed)
    return (
        df.groupBy(*keys, b.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"bin_end": F.col("bin_start") + 1, "bin_label": hour_label("bin_start")})
    )


def rose_detections(tidy: DataFrame) -> DataFrame:
    """Detections per species, capture site, management zone and hour [h, h+1)."""
    return rose_counts(tidy, ["scientific_name", "sitio_captura", "protection"], "hour", "left")


def rose_resident_hours(hours: DataFrame) -> DataFrame:
    """Resident hours per species, zone and hour bin (right-closed)."""
    return rose_counts(hours, ["scientific_name", "protection"], "hour_of_day", "right")


def tag_roses(hours: DataFrame) -> DataFrame:
    """Per tag: resident hours per zone and hour bin (right-closed), with the
    tag's species label (its smallest species name).  One aggregate; the label
    is a window over the aggregated rows (at most 24 per tag and zone)."""
    r = hours.groupBy("tag_id", "protection", hour_bin("hour_of_day", "right").alias("bin_start")).agg(
        F.count(F.lit(1)).alias("n"), F.min("scientific_name").alias("__sp"))
    return r.withColumns({
        "bin_end": F.col("bin_start") + 1,
        "bin_label": hour_label("bin_start"),
        "species": F.min("__sp").over(Window.partitionBy("tag_id")),
    }).drop("__sp")


def write_roses(rose: DataFrame, path: str, key: str = "scientific_name") -> str:
    """One folder per species (or tag): the per-group chart exports."""
    return write_partitioned(rose, path, key)
