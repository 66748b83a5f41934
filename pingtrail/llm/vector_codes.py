"""Vector code compression: product quantisation in exact integers.

Vectors are cut into equal parts, and a part is coded as the number of the
nearest entry of its position's codebook.  Squared distances come from dot
products: components are split into limbs whose float64 BLAS products stay
below 2**53, dot products are recombined in int64, and the first smallest
distance wins.  Every sum is an integer, so results don't depend on the order or
the number of tasks.

A round reads the vectors once: each task sums its parts by entry, and as many
rows as there are entries, summed again, come to the driver for the new
codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.llm.shared import stored
from pingtrail.llm.vectors import exact_products, integer_vectors, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose distances a task holds at a time.
BLOCK = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of ``book`` (the first of equally near ones)
    and the squared distance to it, for each row of ``x``."""
    dim = max(x.shape[1], 1)
    size = max(int(np.abs(m).max()) if m.size else 0 for m in (x, book))
    if 4 * dim * size * size >= 2 ** 63:
        raise ValueError("squared distances do not fit 64 bits")
    away = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    at = away.argmin(axis=1)
    return at, away[np.arange(len(x)), at] + (x * x).sum(axis=1)


def _blocks(batches, dim: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, matrix(part.column("v"), dim)


def first_codebooks(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the ``entries`` smallest ids (fewer rows: fewer entries):
    an array by part, entry and component.  Ties go by the vector; rows without
    an id come last."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    out = np.zeros((len(rows), dim), "i8")
    for n, row in enumerate(rows):
        out[n, :len(row.v)] = row.v
    return out.reshape(len(rows), parts, dim // parts).swapaxes(0, 1)


def next_codebooks(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the floor of the mean of each entry's parts (unused entries stay)."""
    parts, entries, width = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, "i8"), np.zeros((parts, entries), "i8")
        for _, x in _blocks(batches, parts * width):
            for p in range(parts):
                own = x[:, p * width:(p + 1) * width]
                at, _ = nearest(own, books[p])
                np.add.at(sums[p], at, own)
                counts[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(counts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(sums[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), flat],
                                         names=["part", "entry", "n", "total"])

    found = vectors.select("v").mapInArrow(run, "part long, entry long, n long, total array<long>")
    whole = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    out = books.copy()
    for row in whole.collect():  # at most parts x entries rows
        out[row.part, row.entry] = [t // row.n for t in row.total]
    return out


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over all ``vectors``."""
    books = first_codebooks(vectors, dim, parts, entries)
    if books.size:
        for _ in range(rounds):
            books = next_codebooks(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits per part) and ``error`` (squared distance to the coded vector)."""
    parts, _, width = books.shape
    digits = np.array([f"{n:02x}" for n in range(max(books.shape[1], 1))])

    def run(batches):
        for batch, x in _blocks(batches, parts * width):
            codes, error = [], np.zeros(len(x), "i8")
            for p in range(parts):
                at, away = nearest(x[:, p * width:(p + 1) * width], books[p])
                codes.append(digits[at])
                error += away
            text = ["".join(c) for c in zip(*codes)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, "vec_id long, label long, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id`` and ``v``, the coded vector, of rows with ``vec_id`` and ``code``."""
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            at = np.array([[int(c[2 * p:2 * p + 2], 16) for p in range(parts)] for c in batch.column("code").to_pylist()], "i8").reshape(-1, parts)
            found = np.concatenate([books[p][at[:, p]] for p in range(parts)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], names=["vec_id", "v"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, v array<long>")


def digest(books: np.ndarray) -> str:
    """SHA-256 of the components by part, entry and place, in decimal with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (``vec_id``, ``label``, ``embedding``) as ``vec_id``, ``code``,
    ``error``, ``label_error`` (the errors of all rows with that label; NULL
    labels together) and ``codebooks_sha256``.

    Rows with a NULL vector or a NULL or non-finite component are left out;
    shorter vectors end with zeros; NULL and repeated ids are ordinary rows; with
    fewer rows than entries the codebooks are shorter; an empty table gives none.
    Components beyond 2**31 or distances beyond 64 bits are an error."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    vectors = stored(integer_vectors(rows), "vectors")
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(-(-dim // parts), 1) * parts
    books = train(vectors, dim, parts, entries, rounds)
    coded = stored(encode(vectors, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

