"""Per-tag timeline (abacus chart table): tags ranked by first detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.plans.sequence import number_rows


def tag_ranks(df: DataFrame) -> DataFrame:
    """(``tag_id``, ``first_det``, ``tag_rank``): rank 1 = earliest first
    detection, ties by tag id.  NULL tags get no rank (they are no level).
    Ranked without a global single-task window: time chunks of ``first_det``
    are numbered in parallel and offset by the counts of earlier chunks."""
    first = df.where(F.col("tag_id").isNotNull()).groupBy("tag_id").agg(F.min("datetime").alias("first_det"))
    return number_rows(first, [], ["first_det", "tag_id"], out="tag_rank")


def abacus(df: DataFrame) -> DataFrame:
    """Every detection with its tag's rank: ``datetime``, ``tag_id``,
    ``protection``, ``tag_rank`` (NULL for a NULL tag).  The detections are read
    more than once (ranks, rows), so pass a stage."""
    # The rank table is derived from them, so its size is only known at run
    # time: AQE measures it and broadcasts it when small (no extra pass).
    ranks = tag_ranks(df).select("tag_id", "tag_rank")
    return df.select("datetime", "tag_id", "protection").join(ranks, "tag_id", "left").select(
        "datetime", "tag_id", "protection", "tag_rank")
