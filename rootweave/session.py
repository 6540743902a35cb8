"""Session helpers: the shared folder of the cluster and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes: list[list[str]] = []
_applications: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the session's ``spark.checkpoint.dir``.

    A session on one machine (master ``local`` or ``local[...]``) without that setting gets a temporary folder,
    removed when the process ends. On any other master the setting is required.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="rootweave-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def run_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one. It is removed when the process ends; what a killed
    application leaves there can be removed by hand, as no other application uses it."""
    app = spark.sparkContext.applicationId
    place = f"{shared_dir(spark).rstrip('/')}/rootweave/{app}"
    if app not in _applications:
        _applications.add(app)
        sc = spark.sparkContext  # JVM and configuration outlive a session that is stopped before the process ends
        atexit.register(_delete, sc._jvm, sc._jsc.hadoopConfiguration(), place)
    return place


def _delete(jvm, conf, place: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - at the end of a process there may be no JVM any more
        pass


def remove(spark: SparkSession, place: str) -> None:
    """Delete a file or folder on any file system Spark knows; nothing if it isn't there."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), place)


def exists(spark: SparkSession, place: str) -> bool:
    """Whether there is a file or folder at ``place``, on any file system Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside the block are removed at its end, so results must be written or collected there."""
    _scopes.append([])
    try:
        yield
    finally:
        for place in _scopes.pop():
            remove(spark, place)


def new_place(spark: SparkSession, name: str) -> str:
    """An unused path below the application's folder."""
    place = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(place)
    return place


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage and survives the loss of executors. Reading back costs one scan, so it is
    used where a plan would otherwise be computed more than once. ``scratch`` or the end of the process
    removes the table.
    """
    spark = df.sparkSession
    place = new_place(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over all shuffle partitions of the session, by ``columns``. For few bytes that cost much work each (wide
    products, long loops): adaptive execution sizes tasks by bytes and would put them into one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def utc(c: str) -> Column:
    """A timestamp whose calendar fields read as UTC, whatever the session's time zone is."""
    return F.to_utc_timestamp(F.col(c), F.current_timezone())
