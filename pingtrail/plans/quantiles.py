"""Exact quantiles of a numeric column without holding its values in one task.

``percentile`` keeps a map of every distinct value in the final task, which
grows with the data for microsecond timestamps.  Here the values are found by
descent: their range (a scalar subquery of the same query) is cut into 65,536
cells of equal width, counts per cell come from a partial aggregate, a
running count over the cell table locates the cells of the wanted ranks, and
only those are opened and cut again, between their own smallest and largest
value.  What a level hands to the next is a scalar of at most two cells per
probability.  No task holds more than the cells of one opened cell.  Three
levels leave at most 65,536 distinct values in a cell of 64-bit integers, which
are then counted one by one; for doubles the same holds unless they crowd
within 1e-14 of the range at every rank that is wanted.
Interpolation is linear between the values at ranks floor((n-1)p) and
ceil((n-1)p) (0-based).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


_NO_CELL = -1
MAX_CELLS, LEVELS = 65_536, 3


def _cell(low: Column, high: Column, max_cells: int) -> Column:
    """The cell of ``v`` between two bounds: monotone in ``v``, so cells are disjoint ranges."""
    width = (high.cast("double") - low.cast("double")) / max_cells
    at = F.floor((F.col("v").cast("double") - low.cast("double")) / width)
    return F.when(width > 0, F.greatest(F.least(at, F.lit(max_cells - 1)), F.lit(0))).otherwise(0).cast("long")


def _within(targets: Column) -> Column:
    """The targets (number and rank) whose rank is in the row's cell, ranked within it."""
    here = F.filter(targets, lambda x: (x["pos"] >= F.col("off")) & (x["pos"] < F.col("off") + F.col("n")))
    return F.transform(here, lambda x: F.struct(x["t"].alias("t"), (x["pos"] - F.col("off")).alias("pos")))


def _opened(cells: DataFrame, targets: Column) -> DataFrame:
    """One value: the list of the cells that hold wanted ranks (at most two per probability)."""
    hit = cells.select("low", "high", _within(targets).alias("targets")).where(F.size("targets") > 0)
    return hit.agg(F.collect_list(F.struct("low", "high", "targets")).alias("nodes"))


def _inside(src: DataFrame, nodes: DataFrame) -> DataFrame:
    """``v`` and its ``node``, for the values in one of the ``nodes``."""
    mine = F.filter("nodes", lambda x: (x["low"] <= F.col("v")) & (F.col("v") <= x["high"]))
    return src.select("v", nodes.scalar().alias("nodes")).select("v", F.explode(mine).alias("node"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], max_cells: int = MAX_CELLS) -> DataFrame:
    """One row: ``n``, ``min``, ``max``, ``sum`` of the numeric column ``col``
    (integers summed exactly in decimal) and a double ``q_<i>`` per
    probability (NULLs and NaN ignored).

    ``df`` is read once for the range of its values, once per level and once to
    count the values of the last cells (pass a stage)."""
    integral = isinstance(df.schema[col].dataType, IntegralType)
    # NULL/NaN handled as values, not filters: a filter on a computed column
    # would be pushed below the projection and copy the whole expression
    v = F.col(col) if integral else F.when(~F.isnan(F.col(col)), F.col(col))
    src = df.select(v.alias("v"))
    ends = src.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = _cell(ends.select("lo").scalar(), ends.select("hi").scalar(), max_cells)
    weighted = F.col("v").cast("decimal(20,0)") if integral else F.col("v")
    cells = src.withColumn("cell", F.when(F.col("v").isNull(), _NO_CELL).otherwise(cell)).groupBy("cell").agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(weighted).alias("s"))
    # drop the cell of NULLs by its count (a filter on the key would be pushed
    # below the aggregate and copy the value expression into the scan)
    cells = cells.where(F.col("n") > 0)
    # running counts over the cell table (one row per non-empty cell, max_cells at most)
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"off": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(every)})
    totals = cells.agg(F.max("all").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("s").alias("sum"))
    # wanted 0-based ranks: floor and ceil of (n-1)p
    ranks = F.array(*[
        F.struct(F.lit(2 * i + j).alias("t"),
                 F.least(F.floor((F.col("all") - 1) * F.lit(float(p))).cast("long") + F.lit(j), F.col("all") - 1).alias("pos"))
        for i, p in enumerate(probs) for j in (0, 1)])
    nodes = _opened(cells, ranks)
    per_node = Window.partitionBy("node")
    for _ in range(LEVELS - 1):
        cut = _inside(src, nodes).groupBy("node", _cell(F.col("node.low"), F.col("node.high"), max_cells).alias("cell"))
        cells = cut.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = per_node.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
        nodes = _opened(cells, F.col("node.targets"))
    values = _inside(src, nodes).groupBy("node", "v").agg(F.count(F.lit(1)).alias("n"))
    before = per_node.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = values.select("v", F.explode(_within(F.col("node.targets"))).alias("target")).select("target.t", "v")
    # one row: totals plus the two neighbours of every quantile, through a union (no join)
    vtype = df.schema[col].dataType
    none_l, none_v = F.lit(None).cast("long"), F.lit(None).cast(vtype)
    rows = totals.select("n", "min", "max", "sum", F.lit(-1).alias("t"), none_v.alias("v")).unionByName(
        found.select(none_l.alias("n"), none_v.alias("min"), none_v.alias("max"),
                     F.lit(None).cast(totals.schema["sum"].dataType).alias("sum"), "t", "v"))
    one = rows.agg(F.max("n").alias("n"), F.max("min").alias("min"), F.max("max").alias("max"), F.max("sum").alias("sum"),
                   *[F.max(F.when(F.col("t") == t, F.col("v"))).alias(f"v_{t}") for t in range(2 * len(probs))])
    qs = {}
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"v_{2 * i}").cast("double"), F.col(f"v_{2 * i + 1}").cast("double")
        qs[f"q_{i}"] = lo + (hi - lo) * (pos - F.floor(pos))
    return one.withColumns(qs).drop(*[f"v_{t}" for t in range(2 * len(probs))])
