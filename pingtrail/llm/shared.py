"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingtrail.session import materialize, scratch_path  # noqa: F401
from pingtrail.sources.stages import setting

FOLDS = 5


#: Rows that an operator's Python worker gets at a time, where the session has Spark's default (texts are long).
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH_KEY) == "10000":
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` only, a NULL text read as an empty one.  Other
    columns, whatever their names, never reach an operator's own columns."""
    return df.select(F.col(key).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def held_out(key: Column) -> Column:
    """True on the fold that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes (no decoding)."""
    return column.cast(pa.large_binary()).to_pylist()


def release_unused() -> None:
    """Give memory that Arrow and the C library keep for later back to the system:
    a Python worker lives on after a task, and what it keeps adds to that of the next steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return None if "://" in uri else uri


def filesystem(uri: str):
    """(pyarrow file system, path in it) for a folder of the shared store."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def commit_file(uri: str, chunks) -> None:
    """Write ``chunks`` of bytes to ``uri`` under a name of this attempt, then
    rename: a retried or speculative task replaces a file by an equal one."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{os.getpid()}.{os.urandom(6).hex()}.tmp"
    with store.open_output_stream(tmp) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(tmp, path)


#: Spark removes the shuffle files of a query when it ends.
_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once,
    and a lost executor costs no more than the rows that it was working on.  Its shuffle
    files go when it is written, so steps that follow one another need not fit the disk together."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, _CLEAN_KEY, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sample_texts(docs: DataFrame, bound: int, ids: DataFrame | None = None) -> DataFrame:
    """At most ``bound`` different rows (``doc_id``, ``text``) of ``docs`` and the other
    columns of ``ids`` (``doc_id`` is its key; none: all rows with an id): those whose id
    and text have the smallest hashes.  Rows are drawn, not ids, and equal rows
    are one, so an id with any number of rows stays within the bound."""
    if bound > 100_000:
        raise ValueError("too many keys to send to all tasks")
    rows = texts(docs).where("doc_id is not null").withColumn("_hash", F.xxhash64("text"))
    key = ["doc_id", "_hash"]
    # the draw shuffles ids and hashes; only the rows drawn are shuffled with their texts
    named = rows.select(*key)
    named = named.join(ids, "doc_id") if ids is not None else named
    drawn = named.dropDuplicates(key).orderBy(F.xxhash64(*key, F.lit(17)), *key).limit(bound)
    return rows.join(F.broadcast(drawn), key).dropDuplicates(key).drop("_hash")


def column_safe(operator):
    """``operator(docs, ...)`` for an operator that returns the columns of
    ``docs``: it sees those it does not read under names that no other has."""
    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        read = {"doc_id", "text"}
        names = [c if c in read else f"other{n}" for n, c in enumerate(docs.columns)]
        return operator(docs.toDF(*names), *args, **options).select(*names).toDF(*docs.columns)
    return run
