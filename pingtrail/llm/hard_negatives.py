"""Hard-negative mining by LEMP-style coordinate pruning.

Rows are sorted by label and vector length and packed into length buckets, runs
of rows with one label and similar lengths, stored in files of the shared
folder.  A task takes a block of anchors and walks the buckets from the
longest on, so it holds one block and one bucket at a time:

* a score of at least s needs a vector of length s / |anchor|: shorter buckets
  are not read;
* within a bucket, a score between two bounds is a cosine between two bounds, so
  each component of the unit vector must lie in a feasible range around the
  anchor's own component.  For the anchor's focus coordinates, the largest
  ones, the bucket's sorted coordinate lists give the rows in that range; these
  candidate sets are intersected;
* the integer scores of the candidates are computed exactly.  (Where the ranges
  hold most of a bucket, as for short or random vectors, that is one exact
  matrix product of the bucket and the block.)

The bounds tighten as a block finds its best rows.  Every bound is valid for
the rows not yet seen, so the result is exact.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.llm.shared import filesystem, scratch_path, stored
from pingtrail.llm.vectors import exact_products, integer_vectors, matrix

#: Rows of a bucket, anchors of a block, blocks of a task, focus coordinates.
BUCKET, BLOCK, TASK_BLOCKS, FOCUS = 8192, 64, 4, 3
#: Candidate sets above this share of a bucket are not gathered row by row.
DENSE = 0.25
#: Allowance for rounding of lengths and cosines.
_EPS = 1e-6
ROW = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# --- the index: buckets in files -------------------------------------------------

def write_buckets(vectors: DataFrame, dim: int, folder: str, rows: int = BUCKET) -> DataFrame:
    """Packs ``vectors`` into buckets of at most ``rows`` rows and returns a row per
    bucket: ``file``, ``at`` (byte offset), ``label``, ``n``, ``longest``, ``shortest``.

    A file name is of one attempt, and only the names of finished tasks are returned."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    order = ["label", F.desc("square"), "vec_id", "tie"]
    ranged = vectors.withColumns({"square": squares, "tie": F.xxhash64("v")}).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        name, store, out, path, ids, held, label = "", None, None, "", [], [], None

        def close():  # one bucket of what is held
            nonlocal name, store, out, path
            if out is None:
                name = f"{folder}/{os.urandom(16).hex()}"
                store, path = filesystem(name)
                store.create_dir(os.path.dirname(path), recursive=True)
                out = store.open_output_stream(path)
            x = np.concatenate(held)
            length = np.sqrt((x.astype("f8") ** 2).sum(axis=1))
            row = (name, out.tell(), label, len(x), float(length.max()), float(length.min()))
            out.write(np.concatenate(ids).astype("<i8").tobytes())
            out.write(x.astype("<i4").tobytes())
            ids.clear()
            held.clear()
            return row

        made, count = [], 0
        for batch in batches:
            own, labels, x = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), dim)
            at = 0
            while at < len(own):
                if count and (count == rows or labels[at] != label):
                    made.append(close())
                    count = 0
                label = int(labels[at])
                same = np.flatnonzero(labels[at:at + rows - count] != label)
                to = at + (int(same[0]) if len(same) else min(rows - count, len(own) - at))
                ids.append(own[at:to])
                held.append(x[at:to])
                count += to - at
                at = to
        if count:
            made.append(close())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "at", "label", "n", "longest", "shortest"), m)) for m in made], BUCKETS)

    return ranged.select("vec_id", "label", "v").mapInArrow(run, "file string, at long, label long, n long, longest double, shortest double")


BUCKETS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("label", pa.int64()), ("n", pa.int64()),
                     ("longest", pa.float64()), ("shortest", pa.float64())])


class Bucket:
    """A bucket read from its file, with its unit vectors and sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, label: int, longest: float, shortest: float):
        self.ids, self.x, self.label, self.longest, self.shortest = ids, x, label, longest, shortest
        self._unit, self._lists = None, {}

    @classmethod
    def read(cls, row: dict, dim: int) -> "Bucket":
        store, path = filesystem(row["file"])
        with store.open_input_file(path) as f:
            f.seek(row["at"])
            raw = f.read(row["n"] * (8 + 4 * dim))
        ids = np.frombuffer(raw, "<i8", row["n"])
        x = np.frombuffer(raw, "<i4", row["n"] * dim, offset=8 * row["n"]).reshape(-1, dim).astype("i8")
        return cls(ids, x, row["label"], row["longest"], row["shortest"])

    def unit(self) -> np.ndarray:
        if self._unit is None:
            length = np.sqrt((self.x.astype("f8") ** 2).sum(axis=1, keepdims=True))
            self._unit = self.x / np.where(length > 0, length, 1.0)
        return self._unit

    def coordinate_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows in the order of coordinate ``f``, its values in that order)."""
        if f not in self._lists:
            order = np.argsort(self.unit()[:, f], kind="stable")
            self._lists[f] = order, self.unit()[order, f]
        return self._lists[f]


# --- pruning ---------------------------------------------------------------------

def cosines(low: float, high: float, length: float, bucket: Bucket) -> tuple[float, float]:
    """Bounds of the cosine of an anchor of ``length`` and a row of the bucket with a score from
    ``low`` to ``high`` (the first above the second: there is none)."""
    if not length or not bucket.shortest:
        return -1.0, 1.0  # zero vectors have no direction: all rows are verified
    least, most = 1 / (length * bucket.longest), 1 / (length * bucket.shortest)
    a = min(low * least, low * most) - _EPS
    b = max(high * least, high * most) + _EPS
    return (a, b) if a > 1 or b < -1 else (max(a, -1.0), min(b, 1.0))


def feasible(own: float, low: float, high: float) -> tuple[float, float]:
    """The range of a unit vector's component whose cosine with a unit vector that has ``own`` there is
    from ``low`` to ``high``: cos of the sum and difference of the two angles."""
    angle, first, last = np.arccos(np.clip(own, -1, 1)), np.arccos(high), np.arccos(low)
    most = 1.0 if first <= angle <= last else max(np.cos(angle - first), np.cos(angle - last))
    turned = angle + first <= np.pi <= angle + last
    least = -1.0 if turned else min(np.cos(angle + first), np.cos(angle + last))
    return least - _EPS, most + _EPS


def candidates(anchor: np.ndarray, low: float, high: float, bucket: Bucket, focus: int = FOCUS) -> np.ndarray | None:
    """Rows of the bucket that may score from ``low`` to ``high``; None for all of them."""
    length = float(np.sqrt((anchor.astype("f8") ** 2).sum()))
    bounds = cosines(low, high, length, bucket)
    if bounds[0] > 1 or bounds[1] < -1:
        return np.zeros(0, "i8")
    if not length or not bucket.shortest:
        return None
    unit = anchor / length
    ranges = []
    for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
        least, most = feasible(unit[f], *bounds)
        order, values = bucket.coordinate_list(int(f))
        ranges.append((order, int(f), np.searchsorted(values, least, "left"), np.searchsorted(values, most, "right"), least, most))
    ranges.sort(key=lambda r: r[3] - r[2])
    order, _, begin, end, *_ = ranges[0]
    if end - begin > DENSE * len(bucket.ids):
        return None
    found = order[begin:end]
    for _, f, _, _, least, most in ranges[1:]:
        values = bucket.unit()[found, f]
        found = found[(values >= least) & (values <= most)]
    return found


# --- the search ------------------------------------------------------------------

class Best:
    """The ``k`` rows with the highest scores from ``low`` to ``high``, ties by the smaller id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids, self.rows = np.zeros(0, "i8"), np.zeros(0, "i8"), []

    def bounds(self) -> tuple[float, float]:
        """What a row must score to enter."""
        low = -np.inf if self.low is None else self.low
        if len(self.scores) == self.k:
            low = max(low, int(self.scores[-1]))
        return low, np.inf if self.high is None else self.high

    def add(self, scores: np.ndarray, ids: np.ndarray, x: np.ndarray | None = None) -> None:
        low, high = self.bounds()
        keep = np.flatnonzero((scores >= low) & (scores <= high))
        if not len(keep):
            return
        all_scores, all_ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((all_ids, -all_scores))[:self.k]
        if x is not None:
            held = [*self.rows, *(keep.tolist())]
            known = len(self.rows)
            self.rows = [held[n] if n < known else x[held[n]] for n in order]
        self.scores, self.ids = all_scores[order], all_ids[order]


def _scores(block: np.ndarray, spans: list, bucket: Bucket, focus: int):
    """For each anchor of ``block`` with its span of scores (None: none wanted): (anchor, rows, scores)."""
    dense, sparse = [], []
    for n, span in enumerate(spans):
        if span is not None:
            found = candidates(block[n], *span, bucket, focus)
            if found is None:
                dense.append(n)
            elif len(found):
                sparse.append((n, found))
    if dense:
        every = np.arange(len(bucket.ids))
        for n, row in zip(dense, exact_products(block[dense], bucket.x)):
            yield n, every, row
    for n, found in sparse:
        yield n, found, exact_products(block[n:n + 1], bucket.x[found])[0]


def _walk(block: np.ndarray, spans, buckets: list[dict], dim: int, take, focus: int) -> None:
    """Hands the rows that may fit to ``take(anchor, bucket, rows, scores)``, bucket by bucket;
    ``spans(label)`` are the anchors' present spans."""
    lengths = np.sqrt((block.astype("f8") ** 2).sum(axis=1))
    for row in buckets:
        now = spans(row["label"])
        reach = [s is not None and s[0] <= s[1] and s[0] <= n * row["longest"] * (1 + _EPS) + _EPS for s, n in zip(now, lengths)]
        if any(reach):
            bucket = Bucket.read(row, dim)
            for n, found, scores in _scores(block, [s if r else None for s, r in zip(now, reach)], bucket, focus):
                take(n, bucket, found, scores)


def mine_block(ids: np.ndarray, labels: np.ndarray, block: np.ndarray, buckets: list[dict], dim: int, positives: int, negatives: int,
               band: tuple[int, int], focus: int = FOCUS) -> list[tuple]:
    """Rows of the result for a block of anchors; ``buckets`` from the longest on."""
    best = [Best(positives + 1) for _ in ids]  # and the anchor itself
    for label in np.unique(labels):
        own = [b for b in buckets if b["label"] == label]
        _walk(block, lambda at, label=label: [b.bounds() if mine == label else None for b, mine in zip(best, labels)], own, dim,
              lambda n, bucket, found, scores: best[n].add(scores, bucket.ids[found], bucket.x[found]), focus)
    wanted = []
    for n, b in enumerate(best):
        rows = list(zip(b.ids.tolist(), b.scores.tolist()))
        itself = [i for i, r in enumerate(rows) if r[0] == ids[n] and (b.rows[i] == block[n]).all()]
        if itself:
            del rows[itself[0]]
        wanted.append([(i, s, Best(negatives, -(-band[0] * s // 100), band[1] * s // 100)) for i, s in rows[:positives]])

    def spans(label):
        out = []
        for n, mine in enumerate(labels):
            now = [b.bounds() for _, _, b in wanted[n]] if mine != label else []
            now = [s for s in now if s[0] <= s[1]]
            out.append((min(s[0] for s in now), max(s[1] for s in now)) if now else None)
        return out

    def take(n, bucket, found, scores):
        for _, _, b in wanted[n]:
            b.add(scores, bucket.ids[found])

    _walk(block, spans, buckets, dim, take, focus)
    return [(int(ids[n]), i, rank, int(neg), s, int(score)) for n in range(len(ids)) for i, s, b in wanted[n]
            for rank, (neg, score) in enumerate(zip(b.ids, b.scores), 1)]


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90),
         bucket: int = BUCKET, block: int = BLOCK, focus: int = FOCUS) -> DataFrame:
    """For each of ``anchors`` and each of its ``positives`` best other rows of its
    label, the first ``negatives`` rows of ``vectors`` with another label whose
    score is from ``band[0]`` to ``band[1]`` percent of the positive's.

    Both tables have ``vec_id``, ``label`` and ``v``; ``anchors`` are rows of
    ``vectors``.  Higher scores come first, ties go by the smaller id.  Rows with a
    NULL id or label take no part; repeated rows are rows of their own (an anchor
    leaves out one row equal to itself); shorter vectors end with zeros; an empty
    table gives none.  Scores beyond 64 bits are an error."""
    spark = vectors.sparkSession
    known = "vec_id IS NOT NULL AND label IS NOT NULL"
    vectors, anchors = vectors.where(known), anchors.where(known)
    dim = max(vectors.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    index = stored(write_buckets(vectors, dim, scratch_path(spark, "buckets"), bucket), "bucket-list")
    listed = index.inputFiles()
    tasks = -(-anchors.count() // (block * TASK_BLOCKS)) or 1

    def run(batches):
        rows = []
        for path in listed:
            from pyarrow import parquet

            store, own = filesystem(path)
            rows += parquet.read_table(own, filesystem=store, partitioning=None).to_pylist()
        rows.sort(key=lambda r: (-r["longest"], r["file"], r["at"]))
        for batch in batches:
            x, ids, labels = matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for at in range(0, len(ids), block):
                cut = slice(at, at + block)
                found = mine_block(ids[cut], labels[cut], x[cut], rows, dim, positives, negatives, band, focus)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, _TYPES)], names=_NAMES)

    return anchors.select("vec_id", "label", "v").repartition(tasks).mapInArrow(run, ROW)


_NAMES = [c.split()[0] for c in ROW.split(", ")]
_TYPES = [pa.int32() if c.endswith(" int") else pa.int64() for c in ROW.split(", ")]


def labelled_vectors(rows: DataFrame, relabel: int = 7, labels: int = 10) -> DataFrame:
    """Integer vectors whose label moves on by one, modulo ``labels``, where the id is divisible by ``relabel``."""
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return integer_vectors(rows).withColumn("label", moved)


def mine_table(rows: DataFrame, every: int = 100) -> DataFrame:
    """:func:`mine` for ``rows`` (``vec_id``, ``label``, ``embedding``), after
    :func:`labelled_vectors`; the rows whose id is divisible by ``every`` are the anchors."""
    vectors = stored(labelled_vectors(rows), "vectors")
    return mine(vectors, vectors.where(F.col("vec_id") % every == 0))
