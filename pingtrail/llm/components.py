"""Connected components of a link table by alternating large and small stars.

Every step is a group-by with partial aggregation and a join that adaptive
execution may split, so a component (or a node) with a third of all links is no
one task's work.  Each round is written to the shared folder; the driver sees
two numbers of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.llm.shared import stored


def _smallest(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for all nodes
    of ``links`` (``a``, ``b``; equal ones, NULLs and repeats are ignored) but
    the roots themselves.  No links give an empty table."""
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(now.distinct(), "links")
    state = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _smallest(large)
        now = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                             F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = stored(now.select("x.u", "x.v").where("u > v").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"no end after {max_rounds} rounds")
