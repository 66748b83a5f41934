import math

import numpy as np

from pingtrail.operators.range_test import (
    fit_range, range_by_distance, range_curve, range_hourly, range_thresholds, with_expected,
)
from pingtrail.sources import tables


def test_schedule_windows_closed_hole_and_excess(spark):
    raw = spark.createDataFrame([
        ("01-01-24", "00:10:00", "R", "T", "100 metros"),   # first hour of window 1
        ("15-01-24", "23:59:59", "R", "T", "100 metros"),   # last hour of window 1 (closed end)
        ("30-01-24", "23:30:00", "R", "T", "100 metros"),   # the hole after window 2
        ("16-01-24", "00:00:00", "R", "T", "200 metros"),
    ] + [("16-01-24", "01:00:00", "R", "T", "200 metros")] * 7,   # 7 > 6 expected: dropped
        "date_utc string, time_utc string, receiver string, transmitter string, distance string")
    hourly = range_hourly(raw, zone="UTC")
    rates = with_expected(hourly, tables.range_schedule(spark))
    got = sorted((str(r.hour_time), r.distance, r.n_det, r.detec_esperadas) for r in rates.collect())
    assert got == [("2024-01-01 00:00:00", 100.0, 1, 24.0), ("2024-01-15 23:00:00", 100.0, 1, 24.0),
                   ("2024-01-16 00:00:00", 200.0, 1, 6.0)]


def _newton(x, s, n, steps=30):
    b = np.zeros(2)
    X = np.column_stack([np.ones_like(x), x])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-(X @ b)))
        w = n * mu * (1 - mu)
        H = X.T @ (X * w[:, None])
        g = X.T @ (s - n * mu)
        b = b + np.linalg.solve(H, g)
    mu = 1 / (1 + np.exp(-(X @ b)))
    H = X.T @ (X * (n * mu * (1 - mu))[:, None])
    return b, np.linalg.inv(H)


def test_glm_matches_newton_and_curve(spark):
    sf = "/root/testdata/sf0.001"
    hourly = range_hourly(tables.range_raw(spark, sf), zone="UTC")
    bd = range_by_distance(with_expected(hourly, tables.range_schedule(spark)))
    pdf = bd.toPandas()
    x, s, n = pdf.distance.to_numpy(float), pdf.total_detections.to_numpy(float), pdf.total_expected.to_numpy(float)
    b, cov = _newton(x, s, n)
    m = fit_range(bd).collect()[0]
    assert abs(m.b0 - b[0]) < 1e-7 and abs(m.b1 - b[1]) < 1e-9
    assert abs(m.v00 - cov[0, 0]) < 1e-9 * abs(cov[0, 0]) + 1e-12
    assert abs(m.v01 - cov[0, 1]) < 1e-6 * abs(cov[0, 1]) + 1e-15
    curve = range_curve(fit_range(bd), n=200).orderBy("i").collect()
    assert len(curve) == 200 and curve[0].distance == 0.0 and abs(curve[-1].distance - x.max()) < 1e-9
    for r in (curve[0], curve[137]):
        assert r.lwr <= r.predicted_prob <= r.upr
        assert abs(r.predicted_prob - 1 / (1 + math.exp(-(m.b0 + m.b1 * r.distance)))) < 1e-12
    th = {round(r.p, 2): r.distance for r in range_thresholds(fit_range(bd)).collect()}
    assert abs(th[0.5] - (-m.b0 / m.b1)) < 1e-6 * abs(th[0.5])


def test_local_hours_after_zone_shift(spark):
    from pingtrail.operators.range_test import range_detections
    raw = spark.createDataFrame([("16-12-21", "20:00:05", "R", "T", "150 metros"),
                                 ("16-12-21", "20:59:59", "R", "T", "150 metros"),
                                 ("21-06-21", "03:30:00", "R", "T", "0 metros")],
                                "date_utc string, time_utc string, receiver string, transmitter string, distance string")
    got = sorted((str(r.datetime), str(r.hour_time), r.distance)
                 for r in range_detections(raw, zone="America/Santiago").collect())
    # summer time (UTC-3) in December, standard time (UTC-4) in June
    assert got == [("2021-06-20 23:30:00", "2021-06-20 23:00:00", 0.0),
                   ("2021-12-16 17:00:05", "2021-12-16 17:00:00", 150.0),
                   ("2021-12-16 17:59:59", "2021-12-16 17:00:00", 150.0)]
    hourly = range_hourly(raw, zone="America/Santiago")
    assert sorted(r.n_det for r in hourly.collect()) == [1, 2]
