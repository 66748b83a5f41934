"""Time expressions on ``timestamp_ntz`` wall-clock values.

Spark's ``date_trunc``/``unix_micros`` go through the session time zone (and
``date_trunc`` on an NTZ value even returns a zoned timestamp), so flooring and
differences are done on epoch microseconds instead: exact integer arithmetic,
identical in every session zone.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

US_PER_SEC = 1_000_000
US_PER_HOUR = 3_600 * US_PER_SEC
US_PER_DAY = 86_400 * US_PER_SEC

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_EPOCH_DATE = datetime.date(1970, 1, 1)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_ntz(col) -> Column:
    """Cast to ``timestamp_ntz`` (a no-op for NTZ input)."""
    return _c(col).cast("timestamp_ntz")


def _utc_session() -> bool:
    """Whether the session's zone, which a cast keeps from the moment it is written, is UTC."""
    spark = SparkSession.getActiveSession()
    return spark is not None and spark.conf.get("spark.sql.session.timeZone").upper() in ("UTC", "ETC/UTC", "GMT", "Z")


def epoch_us(col) -> Column:
    """Microseconds since 1970-01-01 00:00 of an NTZ wall-clock timestamp.

    In a session in UTC the value as it is stored.  Elsewhere built from calendar fields (days since the epoch, hour, minute, second),
    which are read without any zone; ``timestamp_diff`` on NTZ values goes
    through the session zone and is off across DST gaps.  Only the fraction of
    the second is taken through it: zones differ by whole seconds."""
    t = to_ntz(col)
    if _utc_session():
        return F.unix_micros(t.cast("timestamp"))
    days = F.datediff(F.to_date(t), F.lit(_EPOCH_DATE)).cast("long")
    hm = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long")
    fraction = F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(US_PER_SEC))
    return days * US_PER_DAY + (hm + F.second(t)) * US_PER_SEC + fraction


def from_epoch_us(col) -> Column:
    """Inverse of :func:`epoch_us`; returns ``timestamp_ntz`` (adding to an NTZ
    value involves no zone)."""
    if _utc_session():
        return F.timestamp_micros(_c(col).cast("long")).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", _c(col).cast("long"), F.expr(_EPOCH))


def diff_us(end, start) -> Column:
    """Exact difference ``end - start`` in microseconds (long)."""
    return epoch_us(end) - epoch_us(start)


def floor_time(col, unit_us: int) -> Column:
    """Floor to a multiple of ``unit_us`` (hour: ``US_PER_HOUR``), as NTZ."""
    us = epoch_us(col)
    return from_epoch_us(us - F.pmod(us, F.lit(unit_us)))


def round_ratio_half_up(num_us_col: str, unit_us: int, places: int = 2) -> Column:
    """``round(num / unit_us, places)`` half-up, for a non-negative long column.

    Done in integers so that a value on a tie (e.g. 0.025 days) rounds the same
    way everywhere: ``(num*10^p + unit/2) div unit / 10^p``.
    """
    scale = 10**places
    q = F.expr(f"(CAST(`{num_us_col}` AS BIGINT) * {scale} + {unit_us // 2}) div {unit_us}")
    return q / F.lit(float(scale))


def shift_zone(col, zone: str) -> Column:
    """UTC wall clock -> wall clock in ``zone`` (both NTZ); identity for UTC."""
    if zone.upper() in ("UTC", "GMT", "Z", "ETC/UTC"):
        return to_ntz(col)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), to_ntz(col))


def local_bounds(col, zone: str) -> tuple[Column, Column]:
    """The first instant (UTC wall clock, NTZ) whose clock in ``zone`` shows at least the
    wall-clock value, and the last whose clock shows at most that.

    Both offsets around the value are probed.  They agree on most days.  A
    repeated value has two instants: the first and the second.  A skipped one has
    none: the instant of the change, and the microsecond before it."""
    t = to_ntz(col)
    if zone.upper() in ("UTC", "GMT", "Z", "ETC/UTC"):
        return t, t

    def instant(shift_days):  # by the offset of the day before or after
        near = F.convert_timezone(F.lit(zone), F.lit("UTC"), t) + F.make_dt_interval(F.lit(shift_days))
        offset = epoch_us(shift_zone(near, zone)) - epoch_us(near)
        return from_epoch_us(epoch_us(t) - offset)

    a, b = instant(-1), instant(1)
    minutes = F.sequence(F.least(a, b), F.greatest(a, b), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1)))
    first = F.array_min(F.filter(minutes, lambda x: shift_zone(x, zone) >= t))
    later = F.array_min(F.filter(minutes, lambda x: shift_zone(x, zone) > t))
    skipped = (shift_zone(a, zone) != t) & (shift_zone(b, zone) != t)
    return first, F.when(skipped, from_epoch_us(epoch_us(later) - 1)).otherwise(F.array_max(
        F.filter(F.array(a, b), lambda x: shift_zone(x, zone) == t)))


def _year_from_text(y: Column) -> Column:
    # two-digit years follow the POSIX %y rule: 00-68 -> 20xx, 69-99 -> 19xx
    yi = y.try_cast("int")
    return (
        F.when(F.length(y) > 2, yi)
        .when(yi < 69, yi + 2000)
        .otherwise(yi + 1900)
    )


def _digit_runs(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit("[0-9]+"), 0)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a one-element ``transform``
    binds it to a lambda variable, so repeated uses inside ``body`` (and copies
    of the whole expression that the optimizer pushes into filters) do not
    re-run it."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_dmy_hm(col) -> Column:
    """Day-month-year hour:minute text -> NTZ timestamp; NULL when it does not parse.

    Any run of non-digits separates fields ("03/01/2024 10:05", "3-1-24 10.05").
    """
    def build(parts):
        ts = F.try_make_timestamp_ntz(
            _year_from_text(F.get(parts, 2)),
            F.get(parts, 1).try_cast("int"),
            F.get(parts, 0).try_cast("int"),
            F.get(parts, 3).try_cast("int"),
            F.get(parts, 4).try_cast("int"),
            F.lit(0),
        )
        return F.when(F.size(parts) == 5, ts)
    return _bind(_digit_runs(col), build)


def parse_date_time(date_col, time_col) -> Column:
    """``dd-mm-yy`` + ``HH:MM:SS`` text -> NTZ timestamp (NULL when invalid)."""
    def build(parts):
        d, t = parts.getField("d"), parts.getField("t")
        ts = F.try_make_timestamp_ntz(
            _year_from_text(F.get(d, 2)),
            F.get(d, 1).try_cast("int"),
            F.get(d, 0).try_cast("int"),
            F.get(t, 0).try_cast("int"),
            F.get(t, 1).try_cast("int"),
            F.get(t, 2).try_cast("int"),
        )
        return F.when((F.size(d) == 3) & (F.size(t) == 3), ts)
    return _bind(F.struct(_digit_runs(date_col).alias("d"), _digit_runs(time_col).alias("t")), build)


# English month abbreviations, January first (locale-free labels).
MONTH_ABBREVIATIONS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_label(month_col) -> Column:
    """Month number 1-12 -> "Jan".."Dec"."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS]), _c(month_col))
