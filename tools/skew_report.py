"""Hot-tag report: one tag gets a third of the detections; movement_base runs on
chunks too large to cut anything and on small chunks, residency_events on its bucket
plan; Spark's event log (written to a fresh scratch folder) gives the largest
number of shuffle records one task read.

Usage: python tools/skew_report.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _max_task_records(log_dir: str) -> tuple[int, int]:
    """(largest shuffle-read record count of one task, number of tasks)."""
    best, tasks = 0, 0
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                if '"SparkListenerTaskEnd"' not in line:
                    continue
                ev = json.loads(line)
                m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                best = max(best, int(m.get("Total Records Read", 0)))
                tasks += 1
    return best, tasks


def _session(name: str, extra: dict) -> SparkSession:
    b = (SparkSession.builder.master("local[8]").appName(name).config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", CKPT))
    for k, v in extra.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


CKPT = tempfile.mkdtemp(prefix="pingtrail-ckpt-")


def prepare(sf_dir: str) -> tuple[str, object, int, int]:
    """Tidy detections with a third of them moved to one tag, saved as a stage."""
    from pingtrail import catalog
    from pingtrail.session import scratch_path
    from pingtrail.sources.stages import save_stage

    spark = _session("skew-prepare", {"spark.sql.shuffle.partitions": "8"})
    tidy = catalog.tidy_for(spark, sf_dir)
    hot = tidy.withColumn("tag_id", F.when(F.abs(F.hash("transmitter", "datetime")) % 3 == 0, F.lit("HOT"))
                          .otherwise(F.col("tag_id")))
    path = save_stage(hot, scratch_path(spark, "hot"))
    schema = hot.schema
    n = spark.read.parquet(path).count()
    n_hot = spark.read.parquet(path).where("tag_id = 'HOT'").count()
    spark.stop()
    return path, schema, n, n_hot


def run(path: str, schema, plan: str, partitions: int = 32) -> dict:
    """movement_base on the stage; shuffle partitions are not coalesced, so the
    event log shows how rows are spread over tasks."""
    log_dir = tempfile.mkdtemp(prefix=f"pingtrail-eventlog-{plan}-")
    spark = _session(f"skew-{plan}", {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"})
    from pingtrail.operators import events, movement

    stage = spark.read.schema(schema).parquet(path)
    t = time.perf_counter()
    bounds = {"whole-group": 10**12, "chunked": 5_000}
    if plan == "residency-buckets":
        out = events.residency_events(stage, min_days=1.0)
    else:
        out = movement.movement_base(stage, chunk_rows=bounds[plan])
    out.write.format("noop").mode("overwrite").save()
    secs = time.perf_counter() - t
    spark.stop()
    best, tasks = _max_task_records(log_dir)
    return {"plan": plan, "max_task_shuffle_records": best, "tasks": tasks, "sec": round(secs, 3)}


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    path, schema, n, n_hot = prepare(sf)
    print(json.dumps({"rows": n, "hot_tag_rows": n_hot}))
    for plan in ("whole-group", "chunked", "residency-buckets"):
        print(json.dumps(run(path, schema, plan)))
