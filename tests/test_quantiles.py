import random

import numpy as np

from pingtrail.plans.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(11)
    for n, chunks in ((1, 10), (2, 10), (7, 3), (500, 50), (500, 1), (500, 65_536)):
        vals = [rnd.choice([rnd.randint(-1000, 1000), 5, 5, 5]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x long")
        probs = [0.0, 0.25, 0.5, 0.75, 1.0, 0.1]
        r = exact_quantiles(df, "x", probs, chunks).collect()[0]
        assert r.n == n and r["min"] == min(vals) and r["max"] == max(vals) and int(r["sum"]) == sum(vals)
        for i, p in enumerate(probs):
            assert abs(r[f"q_{i}"] - float(np.quantile(np.array(vals, dtype=float), p))) < 1e-6, (n, p)


def test_numeric_summary_ignores_null_and_nan(spark):
    from pingtrail.operators.tidy import numeric_summary
    vals = [0.5, 2.25, 2.25, 7.0, 10.125, -3.5]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "x double")
    r = numeric_summary(df, "x").collect()[0]
    a = np.array(vals)
    assert r["min"] == a.min() and r["max"] == a.max() and abs(r["mean"] - a.mean()) < 1e-12
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(r[name] - float(np.quantile(a, p))) < 1e-12
