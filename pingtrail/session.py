"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "pingtrail",
                  memory: str = "8g") -> SparkSession:
    """Session used by tests and the bench.  On a cluster, build your own session;
    every operator works on whatever session its inputs belong to."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def _context_checkpoint_dir(spark: SparkSession) -> str | None:
    try:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
    except Exception:  # Spark Connect or no JVM access
        pass
    return None


def _master(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.master
    except Exception:  # Spark Connect: no context; the server is a cluster
        return spark.conf.get("spark.master", "connect")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session (or the context's checkpoint directory).  Only a
    ``local[...]`` session, where driver and executors are one process, gets a
    temporary folder when the setting is missing; on a cluster a missing
    setting is an error, because each executor would write to its own disk.
    """
    found = _context_checkpoint_dir(spark)
    if found:
        return found
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        except Exception:  # Spark Connect: no context
            conf = None
    if not conf:
        master = _master(spark)
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(
                f"spark.checkpoint.dir is not set and the master is {master!r}: "
                "set it to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="pingtrail-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    try:
        spark.sparkContext.setCheckpointDir(conf)
    except Exception:  # Spark Connect: the server reads the conf
        return conf
    return _context_checkpoint_dir(spark) or conf


def materialize(df):
    """Reliable checkpoint of ``df`` in the shared folder: cuts the lineage (a
    lost executor re-reads it instead of re-running the plan) and lets several
    branches of a plan read one computed result.  Never ``localCheckpoint``:
    its blocks die with the executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/pingtrail/{name}-{uuid.uuid4().hex[:12]}"


def files_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and modification times of the files at ``path`` (a file, or a folder
    of files), by the session's file systems; no job.  Changes when a table is rewritten."""
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return ()
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)))
    except AttributeError:  # Spark Connect: no JVM access
        return ("unknown", uuid.uuid4().hex)
