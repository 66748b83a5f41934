"""Token ids as flat binary files that a trainer memory-maps.

Layout of a folder (one set of files per range of ``doc_id``):

* ``ids-<shard>.bin``      token ids, unsigned 16-bit if the vocabulary fits, else 32-bit, little-endian, no header;
* ``offsets-<shard>.bin``  signed 64-bit: where each document begins in the shard, and the shard's end (n + 1 values);
* ``docs-<shard>.bin``     signed 64-bit: each document's id;
* ``manifest/``            JSON lines, one per shard: shard, n_docs, n_ids, base (ids of all shards before it), id_bytes.

Documents are dealt out by ranges of ``doc_id`` and sorted within each, so the
shards in order hold them in ascending order.  Each task writes its shard in
one pass with bounded memory; only a shard's two counts go to the driver, where
prefix sums give the bases.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrail.llm.encoding import encoder
from pingtrail.llm.shared import commit_file, filesystem, local_path, texts

_SHARD = "shard int, n_docs long, n_ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of ids that a task gathers before it writes them out.
BLOCK = 8 << 20
#: The doc_id written for a row whose doc_id is NULL.
NULL_ID = -(2 ** 63)


def _file(folder: str, kind: str, shard: int) -> str:
    return f"{folder}/{kind}-{shard:06d}.bin"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> str:
    """Encode ``docs`` (``doc_id``, ``text``) with the tokenizer file, append
    ``end_id`` to each document and write the files into ``folder`` (a path or
    URI of a store that driver and executors share).  Returns ``folder``.

    A NULL text is an empty one (its only id is ``end_id``), a NULL ``doc_id``
    comes first, rows with equal ids are ordered by their texts, extra columns
    are ignored, and an empty table gives an empty manifest."""
    spark = docs.sparkSession
    wide = _vocabulary(tokenizer, end_id) > 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")
    end = np.array([end_id], kind).tobytes()

    def write(batches):
        at, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        offsets, ids = [0], []

        def blocks():
            held, size = [], 0
            for batch in batches:
                keys = batch.column("doc_id").to_pylist()
                for key, got in zip(keys, encode(batch.column("text").to_pylist())):
                    ids.append(NULL_ID if key is None else key)
                    offsets.append(offsets[-1] + len(got) + 1)
                    held += [got.astype(kind).tobytes(), end]
                    size += len(held[-2])
                    if size > BLOCK:
                        yield b"".join(held)
                        held, size = [], 0
            yield b"".join(held)

        first = next(batches, None)
        if first is None:
            return
        batches = _chain(first, batches)
        commit_file(_file(folder, "ids", at), blocks())
        commit_file(_file(folder, "offsets", at), [np.array(offsets, "<i8").tobytes()])
        commit_file(_file(folder, "docs", at), [np.array(ids, "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "n_docs": [len(ids)],
                                          "n_ids": [offsets[-1]]})

    rows = texts(docs)
    # an id, or none, may hold any share of the rows: the text's hash splits it
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.asc("text")]
    dealt = (rows.repartitionByRange(shards, *order[:2]) if shards else rows.repartitionByRange(*order[:2]))
    # a row per shard: as many as there are partitions
    counts = sorted(dealt.sortWithinPartitions(*order).mapInArrow(write, _SHARD).collect())
    base, lines = 0, []
    for shard, n_docs, n_ids in counts:
        lines.append((shard, n_docs, n_ids, base, kind.itemsize))
        base += n_ids
    spark.createDataFrame(lines, "shard int, n_docs long, n_ids long, base long, id_bytes int").coalesce(1).write.json(
        f"{folder}/manifest")
    return folder


def _chain(first, rest):
    yield first
    yield from rest


def _vocabulary(tokenizer: str, end_id: int) -> int:
    return max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard (none for an empty table)."""
    return spark.read.schema("shard int, n_docs long, n_ids long, base long, id_bytes int").json(f"{folder}/manifest")


def open_array(folder: str, kind: str, shard: int, dtype: str):
    """A shard's file as an array: memory-mapped where the store is a file
    system, else read whole."""
    uri = _file(folder, kind, shard)
    path = local_path(uri)
    if path:
        import os

        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, step: int = 4096, piece: int = 10_000) -> DataFrame:
    """Read the files back: per document ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens`` and ``ids_crc32`` (crc32 of its ids as
    little-endian unsigned 32-bit integers).  Shards are read in pieces of
    ``piece`` documents, dealt over as many tasks."""
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard, kind = row["shard"], "<u4" if row["id_bytes"] == 4 else "<u2"
                ids = open_array(folder, "ids", shard, kind)
                offsets = open_array(folder, "offsets", shard, "<i8")
                docs = open_array(folder, "docs", shard, "<i8")
                last = min(row["at"] + piece, len(docs))
                for at in range(row["at"], last, step):
                    ends = np.asarray(offsets[at:min(at + step, last) + 1])
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends[:-1], ends[1:])]
                    key = np.asarray(docs[at:min(at + step, last)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key, pa.int64(), mask=key == NULL_ID), pa.array(ends[:-1] + row["base"]),
                        pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = manifest(spark, folder).where("n_docs > 0").withColumn(
        "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(piece).cast("long"))))
    return pieces.repartition(max(pieces.count(), 1)).mapInArrow(read, _DOCS)
