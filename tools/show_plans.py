"""Write the physical plans of the headline operators to docs/PLANS.md:
the operator tree (formatted explain, node lines) plus the scan details
(pushed filters, read schema).  Usage: python tools/show_plans.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pingtrail import catalog  # noqa: E402
from pingtrail.operators import events, movement  # noqa: E402
from pingtrail.session import local_session, scratch_path  # noqa: E402
from pingtrail.sources.stages import load_stage, save_stage  # noqa: E402


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def outline(text: str) -> str:
    keep = []
    tree, details = text.split("\n\n", 1) if "\n\n" in text else (text, "")
    keep.append(tree.strip())
    for block in (b.strip() for b in details.split("\n\n")):
        if block.startswith("(") and ("Scan parquet" in block.splitlines()[0]):
            lines = [block.splitlines()[0]] + [ln for ln in block.splitlines()
                                                 if re.match(r"(PushedFilters|ReadSchema|Location)", ln)]
            keep.append("\n".join(lines))
    return "\n\n".join(keep)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    tidy = catalog.tidy_for(spark, sf)
    stage = load_stage(spark, save_stage(tidy, scratch_path(spark, "plans-tidy")), tidy.schema)
    items = [
        ("tidy_detections (from the raw tables)", catalog.QUERIES["tidy_detections"](spark, sf)),
        ("residency_events (on a tidy stage)", events.residency_events(stage, min_days=1.0)),
        ("movement_base (on a tidy stage)", movement.movement_base(stage)),
        ("hour_bins (from the raw tables)", catalog.QUERIES["hour_bins"](spark, sf)),
        ("range_expected (from the raw tables)", catalog.QUERIES["range_expected"](spark, sf)),
    ]
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `python tools/show_plans.py {sf}` (Spark {spark.version}, AQE on; initial plans).", ""]
    for title, df in items:
        out += [f"## {title}", "", "```", outline(formatted(df)), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
