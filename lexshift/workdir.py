"""The shared folder for checkpoints and intermediate tables, and helpers that use it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The setting of our own under which a folder is remembered that a local session was given.
OWN = "spark.lexshift.workdir"
#: Paths made within ``scope`` blocks, innermost last.
_scopes: list[list[str]] = []
#: The folders made so far, by the folder they are in and the application.
_bases: dict[tuple[str, str], str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder of this application below the one named by ``spark.checkpoint.dir``; it is deleted when the JVM ends.

    Only a local session that names none (tests, notebooks) gets a folder of its own, recorded in the session so that
    later calls agree. On any other master the setting must name a folder that all executors share: without it this raises,
    as each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="lexshift-")
        spark.conf.set(OWN, base)
    key = base, spark.sparkContext.applicationId
    if key not in _bases:
        path = f"{base.rstrip('/')}/lexshift-{key[1]}"
        fs = _filesystem(spark, path)
        fs.mkdirs(_hadoop(spark, path))
        fs.deleteOnExit(_hadoop(spark, path))
        _bases[key] = fs.makeQualified(_hadoop(spark, path)).toString()
    return _bases[key]


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):  # noqa: ANN202
    return _hadoop(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows.

    The lineage ends there, and the files outlive any executor. They are deleted at the end of the ``scope`` block around
    the call, or else with the application.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """What Spark takes for the size of ``df``: that of the files for a table that ``cut`` wrote; very much if it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` of the shared folder, whatever its file system."""
    _filesystem(spark, path).delete(_hadoop(spark, path), True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``cut`` writes inside, also after an error. Results that are lazy must be used up inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
