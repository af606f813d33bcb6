"""Session helpers: the settings the operators rely on and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# All instants are UTC. The adaptive features are Spark's own, switched on by name so
# that a cluster default cannot silently turn them off. A task that lists folders decodes
# the whole Hadoop configuration first, which costs more than a folder: instead of up to
# 10,000 tasks with a folder each, at most 200 share the folders.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}

# Scratch folders of local sessions that name no shared folder.
_scratch: dict[str, str] = {}
# Paths handed out inside each open :func:`scratch` block, the innermost last. A thread
# has blocks of its own, so a stream's batches and other jobs never share one.
_open_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("open_blocks", default=())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage. Only a local session may
    leave it unset; it then gets a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        _scratch[application] = tempfile.mkdtemp(prefix="newsflow-")
    return _scratch[application]


def shared_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A fresh path below the shared folder.

    An open :func:`scratch` block removes it when it ends; one that ``outlives`` the
    block belongs to the block around it, if there is one.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _open_blocks.get()
    owners = blocks[:-1] if outlives else blocks
    if owners:
        owners[-1].append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store Spark reads is there."""
    system, place = _file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder this library has written."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables written inside the block when it ends.

    What the block returns must not read them any more: it is :func:`settled` as
    something that outlives the block, or :func:`kept`.
    """
    paths: list[str] = []
    around = _open_blocks.set((*_open_blocks.get(), paths))
    try:
        yield
    finally:
        _open_blocks.reset(around)
        for path in paths:
            remove(spark, path)


def kept(report: DataFrame) -> DataFrame:
    """A report of a few rows as a local table, independent of what it was computed from."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def settled(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    It is then computed once, survives the loss of executors, and has a known
    size, so Spark broadcasts it when it is small enough and joins it by shuffle
    when it is not. Meant for narrow tables that a wide one is joined with.
    """
    path = shared_path(df.sparkSession, name, outlives)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
