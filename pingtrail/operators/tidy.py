"""Enrich, clean and de-duplicate detections; data checks and simple summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pingtrail.functions.text import trailing_digits
from pingtrail.functions.time import epoch_us, from_epoch_us, parse_dmy_hm, to_ntz
from pingtrail.plans.quantiles import exact_quantiles

RECEIVER_RENAMES = {
    "station_latitude": "latitude",
    "station_longitude": "longitude",
    "installation_name": "protection",
    "substrate_general": "substrate",
}


def _complete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without NULL (or NaN) in any of ``cols`` (default: all)."""
    kinds = {c: df.schema[c].dataType.typeName() for c in cols or df.columns}
    known = [f"`{c}` IS NOT NULL" + (f" AND NOT isnan(`{c}`)" if k in ("double", "float") else "") for c, k in kinds.items()]
    return df.where(" AND ".join(known)) if known else df


def tidy_detections(det: DataFrame, receivers: DataFrame, tags: DataFrame, *,
                    datetime_col: str = "date_time", row_order: str | None = "row_id",
                    drop: Sequence[str] = ("date_time_utc",)) -> DataFrame:
    """Detections joined to receiver and tag metadata, cleaned and de-duplicated.

    * receivers (``station_name``, ``station_latitude``, ``station_longitude``,
      ``installation_name``, ``substrate_general``) join by ``station_name``;
      tags (``transmitter``, ``sitio_captura``, ``sitio_liberacion``) by
      ``transmitter``.  Rows with any NULL are dropped afterwards, so both joins
      are inner joins; adaptive execution broadcasts a lookup by its measured size.
    * ``datetime`` is parsed from day-month-year text if it is a string;
      ``hour`` and ``minute`` are added.
    * one row is kept per (``transmitter``, ``datetime``, ``station_name``): the
      first in ``row_order`` (file order), which is dropped afterwards.
    * ``tag_id`` = the 4-5 trailing digits of the transmitter code, or NULL.

    Extra detection columns pass through (and take part in the NULL filter).
    """
    rx_rows = receivers.select("station_name", *RECEIVER_RENAMES)
    tg_rows = tags.select("transmitter", "sitio_captura", "sitio_liberacion")
    # identical metadata rows would only repeat detections
    rx, tg = rx_rows.dropDuplicates(), tg_rows.dropDuplicates()
    d = det.drop(*[c for c in drop if c in det.columns]).withColumnRenamed(datetime_col, "datetime")
    d = d.join(rx, "station_name", "inner").withColumnsRenamed(RECEIVER_RENAMES)
    checked = [c for c in d.columns if c != row_order]
    d = _complete(d, checked)
    d = d.join(tg, "transmitter", "inner")
    parsed = parse_dmy_hm("datetime") if isinstance(d.schema["datetime"].dataType, StringType) else to_ntz("datetime")
    d = d.withColumn("datetime", parsed)
    d = d.withColumns({"hour": F.hour("datetime"), "minute": F.minute("datetime")})
    d = _complete(d, [c for c in d.columns if c != row_order])
    keys = ["transmitter", "datetime", "station_name"]
    others = [c for c in d.columns if c not in keys]
    # file order decides; the other columns break ties (a station or tag with two different
    # metadata rows makes copies of a detection, without a row index there is no file order)
    order = [F.col(c) for c in ([row_order] if row_order else []) + [c for c in others if c != row_order]]
    w = Window.partitionBy(*keys).orderBy(*order)
    d = d.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
    if row_order:
        d = d.drop(row_order)
    d = d.withColumn("tag_id", trailing_digits("transmitter"))
    front = ["datetime", "transmitter", "receiver", "station_name", "scientific_name", "latitude", "longitude",
             "protection", "substrate", "sitio_captura", "sitio_liberacion", "hour", "minute", "tag_id"]
    front = [c for c in front if c in d.columns]
    return d.select(*front, *[c for c in d.columns if c not in front])


def missing_cells(df: DataFrame) -> DataFrame:
    """(``column_name``, ``n_missing``): NULL (or NaN) cells per column, one pass."""
    counts = []
    for c in df.columns:
        miss = F.col(c).isNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            miss = miss | F.isnan(F.col(c))
        counts.append(F.sum(miss.cast("long")).alias(c))
    agg = df.agg(*counts)
    pairs = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n_missing"))
             for c in df.columns]
    return agg.select(F.inline(F.array(*pairs)))


def any_missing(df: DataFrame) -> bool:
    """True when any cell is NULL (runs one aggregate job)."""
    return missing_cells(df).where(F.col("n_missing") > 0).limit(1).count() > 0


def distinct_values(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*cols).distinct()


def frequency(df: DataFrame, col: str) -> DataFrame:
    """(``col``, ``n``) for non-NULL values, as a frequency table."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def six_number(df: DataFrame, col: str) -> DataFrame:
    """Min, quartiles (linear interpolation), mean and max of a timestamp column.

    Exact and distributed (:func:`pingtrail.plans.quantiles.exact_quantiles`);
    quantiles and the mean are floored to whole microseconds, the mean is
    summed exactly in decimal."""
    q = exact_quantiles(df.select(epoch_us(col).alias("__us")), "__us", [0.25, 0.5, 0.75])
    return q.select(
        from_epoch_us("min").alias("min"),
        from_epoch_us(F.floor("q_0")).alias("q1"),
        from_epoch_us(F.floor("q_1")).alias("median"),
        from_epoch_us(F.expr("sum div n")).alias("mean"),
        from_epoch_us(F.floor("q_2")).alias("q3"),
        from_epoch_us("max").alias("max"),
    )


def numeric_summary(df: DataFrame, col: str) -> DataFrame:
    """Min, quartiles (linear interpolation), mean and max of a numeric column
    (NULL and NaN ignored), exact and distributed like :func:`six_number`."""
    q = exact_quantiles(df.select(F.col(col).cast("double").alias("__v")), "__v", [0.25, 0.5, 0.75])
    return q.select(
        F.col("min").alias("min"), F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
        (F.col("sum") / F.col("n")).alias("mean"), F.col("q_2").alias("q3"), F.col("max").alias("max"))


def station_counts(df: DataFrame, count_col: str = "num_det", drop_incomplete: bool = False) -> DataFrame:
    """Rows per (``station_name``, ``latitude``, ``longitude``)."""
    out = df.groupBy("station_name", "latitude", "longitude").agg(F.count(F.lit(1)).alias(count_col))
    return _complete(out) if drop_incomplete else out


def as_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude", out: str = "geometry") -> DataFrame:
    """Add a point geometry (``struct<lon, lat>``, WGS84) for map layers."""
    return df.withColumn(out, F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")))
