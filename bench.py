"""Benchmark: prints one JSON line.

Like the reference's timed steps, movement_base and residency_events run on a
saved tidy stage: at the given scale, and replicated 25 times with shifted
tags (the baseline's 2.5 M-row size).  Further headline queries run end to end
from the raw tables (``abacus`` from the session's tidy stage).  Warm session, median of 5 runs, results written to the
``noop`` sink (everything is computed, nothing is kept).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 5).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pingtrail import catalog  # noqa: E402
from pingtrail.operators import events, movement  # noqa: E402
from pingtrail.session import local_session, scratch_path  # noqa: E402
from pingtrail.sources.stages import load_stage, save_stage  # noqa: E402

COPIES = 25
HOT_CHUNK_ROWS = 100_000


def _noop(df):
    df.write.format("noop").mode("overwrite").save()


def _time(fn, repeat):
    fn()  # warm-up
    runs = []
    for _ in range(repeat):
        t = time.perf_counter()
        fn()
        runs.append(time.perf_counter() - t)
    return round(statistics.median(runs), 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="pingtrail-bench",
                          memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")

    tidy = catalog.tidy_for(spark, sf_dir)
    stage = save_stage(tidy, scratch_path(spark, "bench-tidy"))
    tidy_stage = load_stage(spark, stage, tidy.schema)
    copies = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("__copy")
    big = tidy_stage.select("*", copies).withColumns({
        "tag_id": F.concat(F.col("tag_id"), F.lit("-"), F.col("__copy").cast("string")),
        "transmitter": F.concat(F.col("transmitter"), F.lit("-"), F.col("__copy").cast("string")),
    }).drop("__copy")
    big_path = save_stage(big, scratch_path(spark, "bench-tidy-x25"))
    big_stage = load_stage(spark, big_path, tidy.schema)
    n_rows = tidy_stage.count()
    n_big = big_stage.count()

    q = {}
    q["movement_base"] = _time(lambda: _noop(movement.movement_base(tidy_stage)), repeat)
    q["residency_events"] = _time(
        lambda: _noop(events.residency_events(tidy_stage, min_days=catalog.MIN_DAYS, max_gap_secs=catalog.STATION_GAP_SECS)), repeat)
    q["movement_base_x25"] = _time(lambda: _noop(movement.movement_base(big_stage)), repeat)
    q["residency_events_x25"] = _time(
        lambda: _noop(events.residency_events(big_stage, min_days=catalog.MIN_DAYS, max_gap_secs=catalog.STATION_GAP_SECS)), repeat)
    # a third of the rows in one tag, windowed in chunks of HOT_CHUNK_ROWS at most
    hot = big_stage.withColumn("tag_id", F.when(F.abs(F.hash("transmitter", "datetime")) % 3 == 0, F.lit("HOT"))
                               .otherwise(F.col("tag_id")))
    hot_stage = load_stage(spark, save_stage(hot, scratch_path(spark, "bench-tidy-hot")), tidy.schema)
    q["movement_base_x25_hot"] = _time(
        lambda: _noop(movement.movement_base(hot_stage, chunk_rows=HOT_CHUNK_ROWS)), repeat)
    for name in ("tidy_detections", "hourly_residency", "monthly_days", "abacus", "range_model"):
        fn = catalog.QUERIES[name]
        q[name] = _time(lambda fn=fn: _noop(fn(spark, sf_dir)), repeat)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "movement_base + residency_events on the x25 tidy stage (baseline: 2.5M rows, 1.978 + 2.165 s)",
        "value": round(q["movement_base_x25"] + q["residency_events_x25"], 3),
        "unit": "sec",
        "queries": q,
        "sf": float(m.group(1)) if m else sf_dir,
        "rows": {"tidy_stage": n_rows, "tidy_stage_x25": n_big},
        "cpus": int(cpus),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
