"""Session helpers: a local session for tests/bench, and the shared folder.

Library code never invents a machine-local folder on a cluster: it reads
``spark.checkpoint.dir`` from the session and raises if that is unset.  Only a
``local`` master (tests) gets a scratch folder of its own.  What the library
writes there is kept until ``clean_up`` is called.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pricelab") -> SparkSession:
    """Local session used by tests and bench.py (the driver supplies its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: the session's ``spark.checkpoint.dir``.

    With a ``local`` master and no such setting, a fresh scratch folder is
    registered; on a cluster a missing setting is an error, as executors do not
    share a machine-local folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        # getCheckpointDir returns a per-application sub-folder of the setting
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="pricelab-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_WRITTEN: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder; it stays until ``clean_up``."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clean_up(spark: SparkSession) -> int:
    """Delete the intermediate folders that this application wrote; returns how many.

    Frames that still read them are invalid afterwards.
    """
    n = 0
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        hadoop, fs = _file_system(spark, path)
        n += bool(fs.delete(hadoop, True))
    return n


def input_version(spark: SparkSession, path: str) -> tuple | None:
    """(name, size, modification time) of the files at ``path`` in whatever store holds
    it; None if there is nothing."""
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop):
        return None
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime())
                        for f in fs.listStatus(hadoop)))


@contextmanager
def bounded_splits(spark: SparkSession, most: int):
    """Files scanned inside come in splits of at most ``most`` bytes (or the session's own bound, if that is less).

    For a step whose memory in a task grows with the rows of its split.  A row group of
    parquet is never split.  The session's setting is put back at the end.
    """
    key = "spark.sql.files.maxPartitionBytes"
    own = spark.conf.get(key)
    n_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own)
    spark.conf.set(key, str(min(most, n_bytes)))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialize(df, name: str):
    """Write ``df`` as parquet to a fresh path in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads the files instead of
    recomputing the inputs) and gives the optimizer real statistics.
    """
    return df.sparkSession.read.parquet(write_shared(df, name))


def write_shared(df, name: str) -> str:
    """Write ``df`` as parquet to a fresh path in the shared folder; return the path."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path
