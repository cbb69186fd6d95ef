"""Session defaults, the shared folder, and tables written there to go on from."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: str | None = None
_made: list[str] = []
_inside: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def local_session(cores: str = "*", app: str = "lexframe", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir`` or what ``setCheckpointDir`` was given.

    A folder of this machine is used in local mode only; on a cluster executors would each write
    to a disk of their own, so an unset folder is an error there. A local folder is removed when
    Python ends.
    """
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = given.get() if given.isDefined() else None
    if shared:
        return shared
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="lexframe-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")
    _made.append(path)
    if (inside := _inside.get()) is not None:
        inside.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote under the shared folder; for the end of a job, when no result
    that reads it is needed any more. Returns how many paths went."""
    gone = 0
    while _made:
        gone += _deleted(spark, _made.pop())
    return gone


def _deleted(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one path of :func:`scratch_path`, which no result reads any more."""
    _made.remove(path)
    _deleted(spark, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What this thread writes under the shared folder inside is deleted at the end, when no result reads it any more."""
    outer, paths = _inside.get(), []
    _inside.set(paths)
    try:
        yield
    finally:
        _inside.set(outer)
        for path in paths:
            if path in _made:
                discard(spark, path)


def pin(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a written table in the shared folder.

    Later steps reuse it without recomputing, survive lost executors, and Spark knows its size
    when it decides whether to broadcast it. ``zstd`` is for texts that stay for a whole job.
    """
    return pin_at(df, scratch_path(df.sparkSession, name), codec)


def pin_at(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """:func:`pin` to a path of :func:`scratch_path`, for tables that are discarded before the others."""
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
