"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Equal fingerprints are one row first.  Every distinct fingerprint then emits
all variants within half the radius, and the variants are shuffled: two
fingerprints within the radius meet at a variant between them.  At most as many
distinct fingerprints as a ball holds (65 for a radius of 2) meet at a variant,
and any two of them are within the radius of each other, so each is linked to
the smallest one there, and no pairs are listed.  Every link is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.llm.components import connected_components
from pingtrail.llm.shared import column_safe, stored, utf8

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Bytes of a text whose words are held at a time.
BLOCK = 1 << 20


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (A-Z lower-cased, between ASCII white space), in blocks."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the UTF-8 text's shingles, repeats included (fewer
    words: the whole sequence; none: 0)."""
    from xxhash import xxh64_intdigest

    counts, total, held = np.zeros(BITS, "i8"), 0, []
    for block in _words(text):
        held += block
        if len(held) < shingle:
            continue
        joined = map(b" ".join, zip(*(held[k:] for k in range(shingle))))
        hashes = np.array([xxh64_intdigest(s, SEED) for s in joined], "<u8")
        counts += _bits(hashes)
        total += len(hashes)
        held = held[len(held) - shingle + 1:]
    if not total:
        if not held:
            return 0
        counts, total = _bits(np.array([xxh64_intdigest(b" ".join(held), SEED)], "<u8")), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit."""
    return np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """``doc_id``, long columns ``more`` of ``docs`` and ``fp`` (the fingerprint as
    a signed long) of each row; a NULL text is an empty one."""
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column("_text"))], "<u8")
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view("<i8"))],
                                             names=[*names, "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more,
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*own.columns, "fp")))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` that join all of ``distinct`` (``fp``, no repeats) that
    chains of at most ``radius`` differing bits connect."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: variants within half of it meet")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(BITS), n)]
    ball = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m) for m in masks])
    met = distinct.select("fp", F.explode(ball).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    first = F.first("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = met.select("fp", first.alias("other")).where("fp != other")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(
        F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def _components(prints: DataFrame, radius: int, first: Column, name: str) -> DataFrame:
    """``fp`` and ``name``: the smallest ``first`` that links reach from it."""
    own = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    roots = connected_components(links(own.select("fp"), radius))
    named = own.join(roots, own.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return named.join(named.groupBy("root").agg(F.min("first").alias(name)), "root").select("fp", name)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the
    smallest doc_id that links reach) of each row of ``docs``.

    Rows without words have the fingerprint zero and are linked like others.
    A NULL doc_id never names a component; a component of such rows alone has
    none.  An empty table gives no rows."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    found = _components(prints, radius, F.col("doc_id"), "component_id")
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                           "component_id")


@column_safe
def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component of ``docs``, all columns kept: the one with the
    smallest doc_id (NULL comes last; of equal ids the smallest hash of the
    text, of equal rows any)."""
    row = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1)),
           F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    prints = stored(fingerprints(docs, shingle, row[1].alias("hash")), "fingerprints")
    one = F.struct(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("id"), "hash")
    kept = _components(prints, radius, one, "kept").select("kept.*").distinct()
    kept = stored(kept.select(F.col("id").alias("_id"), F.col("hash").alias("_hash")), "kept")
    own = docs.join(kept, (row[0] == kept["_id"]) & (row[1] == kept["_hash"]))
    number = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash"))
    return own.withColumn("_number", number).where("_number = 1")
