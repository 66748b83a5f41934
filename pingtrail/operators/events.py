"""Gap-and-island residency events: station residency (daily gap) and hourly
residency (per tag and management zone, hour bins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.functions.time import US_PER_DAY, US_PER_HOUR, diff_us, floor_time, from_epoch_us, round_ratio_half_up
from pingtrail.plans.sequence import DEFAULT_CHUNK_ROWS, number_events, sessionize

EVENT_CARRIED = ["scientific_name", "protection", "substrate"]


def event_ids(df: DataFrame, keys, max_gap_secs: float = 3600, *, first_gap: str = "null",
              tie_break=("station_name", "transmitter")) -> DataFrame:
    """Add ``gap_secs``, ``new_event`` and ``event_id`` per group ``keys`` in
    time order; a gap strictly above ``max_gap_secs`` starts a new event.
    ``first_gap='null'`` numbers events from 1, ``'zero'`` from 0."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = ["datetime", *[c for c in tie_break if c in df.columns and c not in keys]]
    return sessionize(df, keys, order, max_gap_secs, first_gap=first_gap)


def residency_events(df: DataFrame, *, min_detections: int = 2, min_days: float, max_gap_secs: float = 86_400,
                     per: str = "event", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Station residency events per (``tag_id``, ``station_name``).

    Event ids start at 0 (first gap counts as 0).  Each event gets
    ``start_datetime``, ``end_datetime``, ``n_detections`` and
    ``duration_days`` (rounded half-up to 2 places *before* the filter), plus
    the carried columns ``scientific_name``, ``protection``, ``substrate``.
    Events are kept when ``n_detections >= min_detections`` and
    ``duration_days >= min_days``.

    ``per='event'``: one row per event and carried-value combination;
    ``per='detection'``: one row per detection of a kept event (the shape a
    summary that carries whole columns produces).

    Plan: rows are numbered by :func:`pingtrail.plans.sequence.number_events`
    (one shuffle by tag and station, in chunks of about ``chunk_rows`` rows at
    most); rows that are an event alone are dropped there if events need more;
    the rest is summed up per chunk and event before the shuffle by event.
    ``df`` is read more than once, so pass a stage.
    """
    if per not in ("event", "detection"):
        raise ValueError("per must be 'event' or 'detection'")
    keys = ["tag_id", "station_name"]
    carried = [c for c in EVENT_CARRIED if c in df.columns]
    rows = number_events(df.select(*keys, "datetime", *carried), keys, ["datetime"], max_gap_secs, first_gap="zero",
                         chunk_rows=chunk_rows)
    several = rows.where("NOT __alone") if min_detections > 1 else rows
    # the rows are partitioned by tag, station and chunk: no shuffle
    parts = several.groupBy(*keys, "__chunk", "__eid", *carried).agg(
        F.expr("min(__us) AS __lo"), F.expr("max(__us) AS __hi"), F.expr("count(1) AS __n"))
    event = "OVER (PARTITION BY tag_id, station_name, __eid)"
    ev = parts.selectExpr(*keys, "__eid", *carried, f"min(__lo) {event} AS __lo", f"max(__hi) {event} AS __hi",
                          f"sum(__n) {event} AS n_detections")
    ev = ev.withColumn("__dur_us", F.col("__hi") - F.col("__lo"))
    ev = ev.withColumn("duration_days", round_ratio_half_up("__dur_us", US_PER_DAY, 2))
    ev = ev.where(f"n_detections >= {min_detections} AND duration_days >= {float(min_days)!r}D")
    ev = ev.select(*keys, F.col("__eid").alias("event_id"), from_epoch_us("__lo").alias("start_datetime"),
                   from_epoch_us("__hi").alias("end_datetime"), "n_detections", "duration_days", *carried)
    ev = ev.distinct()  # an event's parts in several chunks
    if per == "event":
        return ev
    # per detection: every detection of a kept event
    kept = ev.drop(*carried).distinct().withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = rows.join(kept, [*same, F.col("__eid") == F.col("event_id")])
    return both.select(*keys, *[c for c in kept.columns if not c.startswith("__")], *carried)


def hourly_bins(df: DataFrame, keys=("tag_id", "protection"), max_gap_secs: float = 3600) -> DataFrame:
    """Hour bins of hourly residency events straight from detections: the same
    table as ``hour_bins(event_ids(df, keys, max_gap_secs))``, for any ``keys``.
    ``df`` is read more than once, so pass a stage."""
    keys = list(keys)
    d = df.select(*dict.fromkeys([*keys, "scientific_name", "datetime"]))
    d = sessionize(d, keys, ["datetime"], max_gap_secs, first_gap="null").withColumn(
        "hour_bin", floor_time("datetime", US_PER_HOUR))
    return d.groupBy(*dict.fromkeys([*keys, "scientific_name", "event_id", "hour_bin"])).agg(
        F.count(F.lit(1)).alias("dets_in_hour"),
        F.min("datetime").alias("hour_start"),
        F.max("datetime").alias("hour_end"))


def hour_bins(events: DataFrame) -> DataFrame:
    """Detections per event and clock hour: ``dets_in_hour``, ``hour_start``,
    ``hour_end`` per (tag, species, zone, event, ``hour_bin``)."""
    return (
        events.withColumn("hour_bin", floor_time("datetime", US_PER_HOUR))
        .groupBy("tag_id", "scientific_name", "protection", "event_id", "hour_bin")
        .agg(F.count(F.lit(1)).alias("dets_in_hour"),
             F.min("datetime").alias("hour_start"),
             F.max("datetime").alias("hour_end"))
    )


def _event_rollup(bins: DataFrame) -> DataFrame:
    g = bins.groupBy("tag_id", "scientific_name", "protection", "event_id").agg(
        F.min("hour_start").alias("start_datetime"),
        F.max("hour_end").alias("end_datetime"),
        F.sum("dets_in_hour").alias("n_detections"),
        F.count(F.lit(1)).alias("hours_covered"),
        F.min("dets_in_hour").alias("min_dets_per_hour"),
    )
    return g.withColumn("duration_hours", diff_us("end_datetime", "start_datetime") / F.lit(float(US_PER_HOUR)))


def hourly_residency(bins: DataFrame, *, min_hours: float = 1, min_per_hour: int = 2) -> DataFrame:
    """Events whose span is at least ``min_hours`` and whose every hour bin
    (first and last partial hours included) has at least ``min_per_hour``
    detections."""
    r = _event_rollup(bins)
    return r.where((F.col("duration_hours") >= F.lit(float(min_hours))) &
                   (F.col("min_dets_per_hour") >= min_per_hour)).select(
        "tag_id", "scientific_name", "protection", "event_id", "start_datetime", "end_datetime",
        "n_detections", "duration_hours", "hours_covered", "min_dets_per_hour")


EVENT_KEYS = ["tag_id", "scientific_name", "protection", "event_id"]


def resident_hours(bins: DataFrame, *, min_per_hour: int = 2, event_filter: str | DataFrame = "none",
                   min_hours: float = 1) -> DataFrame:
    """Hour bins with at least ``min_per_hour`` detections, with ``hour_of_day``.

    ``event_filter='none'`` keeps every such bin; ``'semi'`` keeps only bins of
    events that pass :func:`hourly_residency` (the semi-join intent, computed
    as window aggregates over each event's bins); a table of events (with
    ``EVENT_KEYS``, such as a saved :func:`hourly_residency`) keeps only their
    bins, by a semi join in which NULL keys are equal."""
    b = bins
    if isinstance(event_filter, DataFrame):
        b = b.where(F.col("dets_in_hour") >= min_per_hour)
        wanted = event_filter.select(*[F.col(k).alias(f"__{k}") for k in EVENT_KEYS])
        b = b.join(wanted, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in EVENT_KEYS], "left_semi")
    elif event_filter == "semi":
        # the event test of hourly_residency, as window aggregates over each
        # event's bins: the bins are read once, no join back
        ew = Window.partitionBy(*EVENT_KEYS)
        b = b.withColumns({"__end": F.max("hour_end").over(ew), "__start": F.min("hour_start").over(ew),
                           "__min": F.min("dets_in_hour").over(ew)})
        span_h = diff_us("__end", "__start") / F.lit(float(US_PER_HOUR))
        b = b.where((span_h >= F.lit(float(min_hours))) & (F.col("__min") >= min_per_hour))
    elif event_filter != "none":
        raise ValueError("event_filter must be 'none', 'semi' or a table of events")
    b = b.where(F.col("dets_in_hour") >= min_per_hour)
    return b.select(*EVENT_KEYS, "hour_bin", F.hour("hour_bin").alias("hour_of_day"), "dets_in_hour")


def bins_with_events(bins: DataFrame, events: DataFrame, *, min_per_hour: int = 2) -> DataFrame:
    """The right join of saved events to the bins with at least ``min_per_hour``
    detections: every such bin, with the ``start_datetime``, ``end_datetime`` and
    ``duration_hours`` of its event (NULL if that is not among ``events``); NULL
    keys are equal."""
    spans = ["start_datetime", "end_datetime", "duration_hours"]
    kept = bins.where(F.col("dets_in_hour") >= min_per_hour)
    ev = events.select(*[F.col(k).alias(f"__{k}") for k in EVENT_KEYS], *spans)
    both = ev.join(kept, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in EVENT_KEYS], "right")
    return both.select(*EVENT_KEYS, "hour_bin", F.hour("hour_bin").alias("hour_of_day"), "dets_in_hour", *spans)


def sorted_events(ev: DataFrame) -> DataFrame:
    """Display order of events: tag, then start time; NULLs last.  A global
    sort: use only for output/inspection."""
    return ev.orderBy(F.asc_nulls_last("tag_id"), F.asc_nulls_last("start_datetime"))
