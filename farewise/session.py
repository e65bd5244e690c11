"""Session helpers: a local session for tests / bench and the shared scratch folder.

Operators never create sessions; the caller passes ``spark``. Scratch tables
live below the shared checkpoint folder; ``scratch_scope`` removes those made
inside it. Paths are reached through the Hadoop file system only, so any store
that Spark reads will do.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Open scopes, innermost last; report jobs run in threads, so this is not per thread.
_SCOPES: list[list[str]] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g",
                  app_name: str = "farewise") -> SparkSession:
    """A local session configured like the tests and bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from the session. Only a local-mode session without one (tests) gets
    a private folder; on a cluster a machine-local folder would not be shared
    by the executors, so the setting is required there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="farewise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _file_system(spark, path)
    return fs.exists(hadoop_path)


def path_stamp(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """Qualified path, bytes and modification time; an absent path has -1 for both."""
    hadoop_path, fs = _file_system(spark, path)
    name = fs.makeQualified(hadoop_path).toString()
    if not fs.exists(hadoop_path):
        return name, -1, -1
    return name, fs.getContentSummary(hadoop_path).getLength(), fs.getFileStatus(hadoop_path).getModificationTime()


def remove_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder; False if there is none."""
    hadoop_path, fs = _file_system(spark, path)
    return fs.delete(hadoop_path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Own the scratch tables made inside the block and remove them at its end, also after an error.

    DataFrames read their scratch tables when they run, so results must be
    written or collected inside the block. Scopes nest: a table belongs to the
    innermost one.
    """
    owned: list[str] = []
    _SCOPES.append(owned)
    try:
        yield owned
    finally:
        _SCOPES[:] = [scope for scope in _SCOPES if scope is not owned]
        for path in owned:
            remove_path(spark, path)


def materialize(df, name: str):
    """Cut lineage: write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Columnar and compressed (smaller than a serialized RDD checkpoint), and a
    lost executor never recomputes the plan above it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
