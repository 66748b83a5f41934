"""Detection-range test: hourly detection rates against a ping schedule, a
grouped binomial logit model of rate by distance, its confidence band and the
distances at given detection probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.functions.text import parse_number
from pingtrail.functions.time import (US_PER_HOUR, epoch_us, floor_time, from_epoch_us, local_bounds, parse_date_time,
                                      shift_zone)


def range_detections(raw: DataFrame, zone: str = "America/Santiago", bin_us: int = US_PER_HOUR) -> DataFrame:
    """Range-test rows with ``datetime_utc`` (``date_utc`` ``dd-mm-yy`` +
    ``time_utc`` ``HH:MM:SS``, read as UTC), ``datetime`` (shown in ``zone``),
    ``hour_time`` (local clock hour, or bin of ``bin_us``) and numeric ``distance`` ("150 metros")."""
    d = raw.withColumn("datetime_utc", parse_date_time("date_utc", "time_utc"))
    d = d.withColumn("datetime", shift_zone("datetime_utc", zone))
    return d.withColumns({
        "hour_time": floor_time("datetime", bin_us),
        "distance": parse_number("distance"),
    })


def range_hourly(raw: DataFrame, zone: str = "America/Santiago", *, bin_us: int = US_PER_HOUR,
                 keep_instant: bool = False) -> DataFrame:
    """Detections per hour (or bin of ``bin_us``), receiver, transmitter and distance;
    ``hour_time`` is the hour's local clock label.  Hours are instants: the two
    that share a label when clocks go back are two rows.  ``keep_instant`` adds
    ``hour_utc``, the instant (the local clock's bin in UTC)."""
    d = range_detections(raw, zone, bin_us)
    # the start of the local bin as an instant: as far before the detection as the label is before its local time
    d = d.withColumn("hour_utc", from_epoch_us(epoch_us("datetime_utc") - (epoch_us("datetime") - epoch_us("hour_time"))))
    h = d.groupBy("hour_utc", "hour_time", "receiver", "transmitter", "distance").agg(F.count(F.lit(1)).alias("n_det"))
    return h if keep_instant else h.drop("hour_utc")


# Join key for rows without a time: never equal to a bucket of a window.
_NO_BUCKET = -(2**62)


def window_lookup(df: DataFrame, time_col: str, windows: DataFrame, value: str, out: str, *,
                  bucket_us: int = US_PER_HOUR) -> DataFrame:
    """``df`` with ``out``: the ``value`` of the closed window (``window_start``,
    ``window_end``, ``priority``) that holds ``time_col``; of several, the one with
    the smallest ``priority``; NULL if there is none.

    A bucketed interval join: windows are cut into the time buckets that they
    touch and listed per bucket, rows meet the list of their own bucket by an
    equi-join, and the bounds are checked there.  Every row meets at most one
    list, so no row is repeated.  The key is never NULL, so the optimizer adds no
    NULL filter that would copy the time parsing into the scan."""
    def bucket(us):
        return ((us - F.pmod(us, F.lit(bucket_us))) / F.lit(float(bucket_us))).cast("long")

    w = windows.select(epoch_us("window_start").alias("__a"), epoch_us("window_end").alias("__b"),
                       F.col("priority").alias("__p"), F.col(value).alias("__v"))
    # a window that ends before it starts holds nothing (a sequence would count down)
    w = w.where(F.col("__a") <= F.col("__b")).withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__a")), bucket(F.col("__b")))))
    lists = w.groupBy("__bucket").agg(F.array_sort(F.collect_list(F.struct("__p", "__a", "__b", "__v"))).alias("__list"))
    us = epoch_us(time_col)
    both = df.withColumn("__bucket", F.coalesce(bucket(us), F.lit(_NO_BUCKET))).join(lists, "__bucket", "left")
    holds = F.filter("__list", lambda x: (x["__a"] <= us) & (us <= x["__b"]))
    return both.withColumn(out, F.get(holds, 0).getField("__v")).drop("__bucket", "__list")


def local_schedule(schedule: DataFrame, zone: str) -> DataFrame:
    """A schedule in the wall clock of ``zone`` as instants (UTC): a window starts
    with the first instant whose clock shows its start and ends with the last
    whose clock shows its end (:func:`pingtrail.functions.time.local_bounds`)."""
    return schedule.withColumns({"window_start": local_bounds("window_start", zone)[0],
                                 "window_end": local_bounds("window_end", zone)[1]})


def schedule_hours(schedule: DataFrame) -> DataFrame:
    """The whole hours that closed schedule windows cover: (``__h`` hour index,
    ``expected``); where windows overlap the first one wins."""
    first = F.ceil(epoch_us("window_start") / F.lit(float(US_PER_HOUR))).cast("long")
    last = F.floor(epoch_us("window_end") / F.lit(float(US_PER_HOUR))).cast("long")
    # a window without a whole hour covers none (a sequence would count down)
    s = schedule.where(first <= last).select(F.explode(F.sequence(first, last)).alias("__h"), "expected", "priority")
    best = s.groupBy("__h").agg(F.min_by("expected", "priority").alias("expected"))
    return best.select("__h", "expected")


def with_expected(hourly: DataFrame, schedule: DataFrame, *, require_rows: bool = False, zone: str | None = None) -> DataFrame:
    """Hourly counts with the expected pings of their hour (``detec_esperadas``)
    and the rate ``tasa_detec``; hours outside the schedule, with no positive
    expectation, or with more detections than expected are dropped.

    The schedule's windows may start and end at any instant
    (:func:`window_lookup`).  Without ``zone`` they are compared with
    ``hour_time``; with it they are that zone's wall clock, resolved to instants
    and compared with ``hour_utc`` (see :func:`range_hourly`).

    ``require_rows``: an action on the result fails if no row is left."""
    if zone is None:
        found = window_lookup(hourly, "hour_time", schedule, "expected", "detec_esperadas")
    else:
        found = window_lookup(hourly, "hour_utc", local_schedule(schedule, zone), "expected", "detec_esperadas")
    out = (
        found.where(F.col("detec_esperadas").isNotNull() & (F.col("detec_esperadas") > 0))
        .where(F.col("n_det") <= F.col("detec_esperadas"))
        .withColumn("tasa_detec", F.col("n_det") / F.col("detec_esperadas"))
    )
    return _assert_rows(out, "no hourly rows left after the schedule filter") if require_rows else out


def _assert_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, whose execution fails if it has no row: the check is a branch of the
    plan (a count of one row that is never returned), so no job runs here."""
    n = df.agg(F.count(F.lit(1)).alias("__n")).where(
        F.when(F.col("__n") == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(n.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def range_by_distance(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Successes and trials per distance (and the columns ``by``), and their ratio."""
    g = rates.groupBy(*by, "distance").agg(
        F.sum("n_det").alias("total_detections"),
        F.sum("detec_esperadas").alias("total_expected"),
    )
    return g.withColumn("tasa_detec", F.try_divide(F.col("total_detections"), F.col("total_expected"))).where(
        (F.col("total_expected") > 0) & (F.col("total_detections") <= F.col("total_expected")))


_STEP = "struct<b0:double,b1:double,d0:double,d1:double,s:double,sx:double,sxx:double>"


def fit_range(by_distance: DataFrame, *, by: Sequence[str] = (), max_iter: int = 25, tol: float = 1e-8) -> DataFrame:
    """Binomial GLM (logit link) of successes out of trials on distance, by
    Newton's method, for each group of the columns ``by`` at once (none: one
    model, one row even for an empty table).

    Returns per group ``b0``, ``b1``, covariance ``v00``, ``v01``, ``v11`` (the inverse
    Fisher information) and ``max_distance``.  A group that determines no finite
    model has NULLs: no rows, one distance, or rates that a step at some distance
    separates (the iteration does not settle).

    Aggregates only: sums per (group, distance) first, so a group holds one row
    per distance, and then one array of them in which every iteration is a sum.
    No job runs here."""
    x, y, n = F.col("distance").cast("double"), F.col("tasa_detec").cast("double"), F.col("total_expected").cast("double")
    d = by_distance.where(x.isNotNull() & y.isNotNull() & (n > 0)).groupBy(*by, x.alias("x")).agg(
        F.sum(y * n).alias("k"), F.sum(n).alias("n"))
    g = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "k", "n"))).alias("rows"), F.max("x").alias("max_distance"))

    def sums(state):
        """Score and information at the state's coefficients, summed over the distances."""
        def add(acc, r):
            m = F.lit(1.0) / (F.lit(1.0) + F.exp(-(state["b0"] + state["b1"] * r["x"])))
            w = r["n"] * m * (F.lit(1.0) - m)
            e = r["k"] - r["n"] * m
            return F.struct((acc["g0"] + e).alias("g0"), (acc["g1"] + e * r["x"]).alias("g1"), (acc["s"] + w).alias("s"),
                            (acc["sx"] + w * r["x"]).alias("sx"), (acc["sxx"] + w * r["x"] * r["x"]).alias("sxx"))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("g0", "g1", "s", "sx", "sxx")])
        return F.aggregate("rows", zero, add)

    def step(state, _):
        def move(t):
            det = t["s"] * t["sxx"] - t["sx"] * t["sx"]
            d0 = F.try_divide(t["sxx"] * t["g0"] - t["sx"] * t["g1"], det)
            d1 = F.try_divide(t["s"] * t["g1"] - t["sx"] * t["g0"], det)
            return F.struct((state["b0"] + d0).alias("b0"), (state["b1"] + d1).alias("b1"), d0.alias("d0"), d1.alias("d1"),
                            t["s"].alias("s"), t["sx"].alias("sx"), t["sxx"].alias("sxx"))
        return F.get(F.transform(F.array(sums(state)), move), 0)

    start = F.struct(F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.lit(1.0).alias("d0"), F.lit(1.0).alias("d1"),
                     *[F.lit(0.0).alias(c) for c in ("s", "sx", "sxx")]).cast(_STEP)
    g = g.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), start, lambda s, i: step(s, i).cast(_STEP)))
    g = g.withColumn("at", F.get(F.transform(F.array("fit"), sums), 0))
    det = F.col("at.s") * F.col("at.sxx") - F.col("at.sx") * F.col("at.sx")
    moved = F.greatest(F.abs("fit.d0") / (F.abs("fit.b0") + 0.1), F.abs("fit.d1") / (F.abs("fit.b1") + 0.1))
    settled = (F.size("rows") > 1) & F.coalesce(moved <= F.lit(tol), F.lit(False)) & (det > 0)
    value = lambda c: F.when(settled, c)
    return g.select(
        *by, value(F.col("fit.b0")).alias("b0"), value(F.col("fit.b1")).alias("b1"),
        value(F.try_divide(F.col("at.sxx"), det)).alias("v00"),
        value(F.try_divide(-F.col("at.sx"), det)).alias("v01"),
        value(F.try_divide(F.col("at.s"), det)).alias("v11"),
        "max_distance")


_MODEL = ("b0", "b1", "v00", "v01", "v11", "max_distance")


def _plogis(c):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def range_curve(model: DataFrame, n: int = 200, z: float = 1.96) -> DataFrame:
    """Predicted detection probability with a ``z``-standard-error band on the
    link scale, on ``n`` evenly spaced distances from 0 to the largest
    observed distance.  The grid is generated from the one-row model table."""
    by = [c for c in model.columns if c not in _MODEL]
    g = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    x = F.col("max_distance") * F.col("i") / F.lit(float(max(n - 1, 1)))
    g = g.withColumn("distance", x)
    fit = F.col("b0") + F.col("b1") * F.col("distance")
    se = F.sqrt(F.col("v00") + F.lit(2.0) * F.col("distance") * F.col("v01") + F.col("distance") ** 2 * F.col("v11"))
    g = g.withColumns({"fit_link": fit, "se_link": se})
    g = g.withColumns({
        "lwr_link": F.col("fit_link") - F.lit(z) * F.col("se_link"),
        "upr_link": F.col("fit_link") + F.lit(z) * F.col("se_link"),
    })
    return g.select(
        *by, "i", "distance", "fit_link", "se_link", "lwr_link", "upr_link",
        _plogis(F.col("fit_link")).alias("predicted_prob"),
        _plogis(F.col("lwr_link")).alias("lwr"),
        _plogis(F.col("upr_link")).alias("upr"),
    )


def range_thresholds(model: DataFrame, probs: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Distance at which the fitted detection probability equals each ``p``:
    ``(logit(p) - b0) / b1``."""
    by = [c for c in model.columns if c not in _MODEL]
    t = model.select(*by, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"), "b0", "b1")
    logit = F.log(F.col("p") / (F.lit(1.0) - F.col("p")))
    return t.select(*by, "p", F.try_divide(logit - F.col("b0"), F.col("b1")).alias("distance"))
