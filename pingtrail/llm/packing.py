"""Best-fit packing of documents into training sequences by large-item matching.

A document's ids (with its end id) are one piece, or pieces of ``capacity``
ids if it is longer.  Only lengths matter for a packing, and there are at most
``capacity`` of them, so the plan is made from the number of pieces of each
length, never from the pieces: the driver holds at most ``capacity`` counts.

1. Pieces longer than a third of the capacity go two to a sequence at most:
   from the longest on, each is matched with the longest one left that fits.
2. The smaller pieces, from the longest on, go to the sequence with the
   smallest gap that takes them (best fit), else to a new one.

All sequences with the same pieces are one *class* with a count.  A length
either uses up a class or splits it in three at most, so there are fewer than
4 * capacity classes, whatever the number of documents.

The pieces then find their places: each is numbered among those of its length
(in salted groups, so that a length that a third of all pieces share is not
one task's work), and its number falls into one entry of the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.llm.encoding import encoder
from pingtrail.llm.shared import materialize, texts

CAPACITY = 4096
#: Groups that the pieces of one length are dealt to for numbering.
SALTS = 256
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, *,
                  with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``)
    of each piece.  A NULL text is an empty one: a piece with the end id alone."""
    def cut(batches):
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            encode = encoder(tokenizer).encode
            out = ([], [], [], [], [], [])
            whole = batch.column("text").to_pylist()
            for key, got in zip(batch.column("doc_id").to_pylist(), encode(whole)):
                ids = got.tobytes() + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (key, n, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in out[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts(docs).mapInArrow(cut, _PIECE + (", ids array<int>" if with_ids else ""))


def plan_classes(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes ``(sequences, [(length, pieces of it in each sequence), ...])``
    for ``counts`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    done: list[tuple[int, list]] = []
    gaps: list[int] = []  # sorted, those that have classes
    classes: dict[int, list[tuple[int, list]]] = {}

    def put(count, items, gap):
        if gap == 0:
            done.append((count, items))
            return
        if gap not in classes:
            classes[gap] = []
            insort(gaps, gap)
        classes[gap].append((count, items))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        # the longest one left that fits beside it; itself if there are two of it
        k = bisect_left(large, capacity - n + 1) - 1
        if k >= 0 and large[k] == n and left[n] < 2:
            k -= 1
        if k < 0:
            put(left.pop(n), [(n, 1)], capacity - n)
            large.pop()
            continue
        m = large[k]
        pairs = left[n] // 2 if m == n else min(left[n], left[m])
        put(pairs, [(n, 2)] if m == n else [(n, 1), (m, 1)], capacity - n - m)
        for x in (n, m):
            left[x] -= pairs
        for x in {n, m}:
            if not left[x]:
                del left[x]
                large.remove(x)

    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                bins, items, gap = -(-c // (capacity // n)), [], capacity
            else:
                gap = gaps[k]
                bins, items = classes[gap].pop()
                if not classes[gap]:
                    del classes[gap]
                    gaps.pop(k)
            each = gap // n
            full = min(bins, c // each)
            if full:
                put(full, [*items, (n, each)], gap - n * each)
                bins, c = bins - full, c - full * each
            if bins and c:  # fewer pieces are left than one sequence takes
                put(1, [*items, (n, c)], gap - n * c)
                bins, c = bins - 1, 0
            if bins and items:
                put(bins, items, gap)
    return done + [x for gap in gaps for x in classes[gap]]


def places(classes) -> dict[str, np.ndarray]:
    """The plan as sorted arrays, an element per class and length: pieces of
    ``length`` from number ``first`` on go to sequences from ``sequence`` on,
    ``each`` to a sequence, from ``offset`` on."""
    rows, used, sequence = [], {}, 0
    for count, items in classes:
        offset = 0
        for length, each in items:
            rows.append((length, used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + count * each
            offset += length * each
        sequence += count
    rows.sort()
    columns = np.array(rows, "i8").reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "each", "offset"), columns))


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``doc_id``, ``piece``,
    ``length`` at most ``capacity``).  Equal rows get places of their own; an
    empty table stays empty.  ``pieces`` should be a stored table: it is read
    three times."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = places(plan_classes(counts, capacity))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    numbered = (salted.withColumn("_own", F.row_number().over(own)).join(groups, ["length", "_salt"])
                .withColumn("_no", F.col("_base") + F.col("_own") - 1).drop("_salt", "_base", "_own"))

    def place(batches):
        for batch in batches:
            length, no = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_no"))
            # the plan is sorted by (length, first): the last element at or before (length, no)
            low, high = np.searchsorted(plan["length"], length), np.searchsorted(plan["length"], length, "right")
            while (high - low > 1).any():
                mid = (low + high) // 2
                up = (high - low > 1) & (plan["first"][mid] <= no)
                down = (high - low > 1) & ~up
                low, high = np.where(up, mid, low), np.where(down, mid, high)
            within = no - plan["first"][low]
            sequence = plan["sequence"][low] + within // plan["each"][low]
            offset = plan["offset"][low] + within % plan["each"][low] * length
            names = [n for n in batch.schema.names if n != "_no"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in numbered.drop("_no").dtypes)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, *,
                   with_ids: bool = False) -> DataFrame:
    """Cut and pack ``docs``: a row per piece with its place."""
    return pack(materialize(cut_documents(docs, tokenizer, end_id, capacity, with_ids=with_ids)), capacity)
