"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_MASTER = re.compile(r"local(\[[^\[\]]*\])?")  # not local-cluster, whose executors are other processes
_open_scopes: list[list[str]] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "seqwarden") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by the session.

    Only a local master may fall back to a folder of its own, because there
    driver and executors are the same process.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not LOCAL_MASTER.fullmatch(spark.sparkContext.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are stored inside the block, through the file system that holds them.

    What is returned from the block must not read them any more: store it elsewhere first.
    """
    stored: list[str] = []
    _open_scopes.append(stored)
    try:
        yield
    finally:
        _open_scopes.remove(stored)
        for path in stored:
            remove_table(spark, path)


def remove_table(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside the block leave no shuffle files: Spark removes those of each as soon as it has ended.

    Otherwise they stay until the driver happens to collect its garbage. A later query that still wanted them would run their stage again.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def materialize_at(df: DataFrame, label: str = "step", outlives: bool = False, **options: str) -> tuple[DataFrame, str]:
    """``materialize``, and where the table is, for one that is removed before the others, or ``outlives`` the innermost ``tables_of``.

    ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    scopes = _open_scopes[:-1] if outlives else _open_scopes
    if scopes:
        scopes[-1].append(path)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and read it back, cutting its lineage.

    A written table survives lost executors, is read with column pruning, and
    carries its true size, so later joins are broadcast only if it really is small.
    The shuffle files of its making are removed once it is written.
    """
    return materialize_at(df, label)[0]
