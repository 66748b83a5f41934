"""Residency events expanded to days, monthly presence and its summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.functions.time import month_label

DAY_KEYS = ["tag_id", "station_name", "scientific_name", "protection"]


def expand_days(events: DataFrame, keep: Sequence[str] = DAY_KEYS) -> DataFrame:
    """One row per calendar day an event covers (start and end days included),
    with ``month`` (1-12), ``month_label`` and ``year``.  A generator: no shuffle."""
    d = events.select(
        *keep,
        F.explode(F.sequence(F.to_date("start_datetime"), F.to_date("end_datetime"))).alias("date"),
    )
    return d.withColumns({"month": F.month("date"), "year": F.year("date")}).withColumn(
        "month_label", month_label("month"))


MONTH_KEYS = ["tag_id", "station_name", "protection", "scientific_name"]


def monthly_days(days: DataFrame, years: str = "distinct") -> DataFrame:
    """:func:`monthly_presence` from a table of days (:func:`expand_days`)."""
    keys = [*MONTH_KEYS, "month", "year"]
    return _per_year(days.groupBy(*keys).agg(F.count_distinct("date").alias("n_days_present")), years)


def monthly_presence(events: DataFrame, years: str = "distinct") -> DataFrame:
    """Days present per (tag, station, zone, species, month, year), the number of
    years seen for that tag, station and month, and ``days_per_year``.  A day that
    several events cover counts once.

    ``years='distinct'``: ``n_years`` = distinct years of the (tag, station,
    month); ``years='rows'``: the number of monthly rows of it (the older
    variant, which also splits by zone and species).  NULL tags form one group.

    Interval arithmetic by month: an event is cut at the ends of months, and the
    days of a month that it covers are a run of bits.  The union of overlapping
    events is the OR of their bits, a partial aggregate, so neither days nor the
    events of one key meet in a task, and the days are the bits set."""
    first, last = F.to_date("start_datetime"), F.to_date("end_datetime")
    d = events.select(*MONTH_KEYS, first.alias("__a"), last.alias("__b")).where("__a <= __b")
    d = d.withColumn("__m", F.explode(F.sequence(F.trunc("__a", "month"), F.trunc("__b", "month"), F.expr("interval 1 month"))))
    low = F.when(F.col("__a") > F.col("__m"), F.dayofmonth("__a")).otherwise(1)
    high = F.when(F.col("__b") < F.last_day("__m"), F.dayofmonth("__b")).otherwise(F.dayofmonth(F.last_day("__m")))
    d = d.withColumns({"month": F.month("__m"), "year": F.year("__m"), "__low": low, "__high": high})
    bits = F.expr("shiftleft(1L, __high + 1) - shiftleft(1L, __low)")
    md = d.groupBy(*MONTH_KEYS, "month", "year").agg(F.bit_or(bits).alias("__days"))
    return _per_year(md.withColumn("n_days_present", F.bit_count("__days").cast("long")).drop("__days"), years)


def _per_year(md: DataFrame, years: str) -> DataFrame:
    if years not in ("distinct", "rows"):
        raise ValueError("years must be 'distinct' or 'rows'")
    w = Window.partitionBy("tag_id", "station_name", "month")
    n_years = F.size(F.collect_set("year").over(w)) if years == "distinct" else F.count(F.lit(1)).over(w)
    md = md.withColumn("n_years", n_years.cast("long"))
    return md.withColumns({
        "days_per_year": F.col("n_days_present") / F.col("n_years"),
        "month_label": month_label("month"),
    })


def _n_distinct_with_null(col: str):
    """Distinct values counting NULL as one value."""
    return F.count_distinct(col) + F.max(F.col(col).isNull().cast("int"))


def mean_residency(monthly: DataFrame, keys: Sequence[str], se: str = "tags") -> DataFrame:
    """Mean and sample SD of ``days_per_year`` per ``keys`` (SD NULL for one
    row), ``n_tags`` (distinct tags, NULL counted), standard error
    ``sd / sqrt(n_tags)`` (``se='tags'``) or ``sd / sqrt(rows)`` (``se='rows'``),
    and the ``lower``/``upper`` band mean -/+ SD."""
    if se not in ("tags", "rows"):
        raise ValueError("se must be 'tags' or 'rows'")
    g = monthly.groupBy(*keys).agg(
        F.avg("days_per_year").alias("mean_days_present"),
        F.stddev_samp("days_per_year").alias("sd_days_present"),
        _n_distinct_with_null("tag_id").cast("long").alias("n_tags"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    denom = F.col("n_tags") if se == "tags" else F.col("n_rows")
    g = g.withColumn("se_days_present", F.try_divide(F.col("sd_days_present"), F.sqrt(denom)))
    g = g.withColumns({
        "lower": F.col("mean_days_present") - F.col("sd_days_present"),
        "upper": F.col("mean_days_present") + F.col("sd_days_present"),
    })
    if "month" in keys:
        g = g.withColumn("month_label", month_label("month"))
    return g.drop("n_rows")


def unique_tags(days: DataFrame, keys: Sequence[str] = ("station_name", "protection", "scientific_name", "month"),
                count_col: str = "unique_tags") -> DataFrame:
    """Distinct tags (NULL counted as one) per ``keys``; ``days`` is a table of days
    or of months (:func:`monthly_presence`)."""
    keys = list(keys)
    return days.select("tag_id", *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))


def stacked_totals(counts: DataFrame, keys: Sequence[str] = ("protection", "scientific_name", "month"),
                   value: str = "unique_tags") -> DataFrame:
    """Column totals of a stacked chart: ``sum(value)`` per ``keys``."""
    return counts.groupBy(*keys).agg(F.sum(value).alias(f"total_{value}"))
