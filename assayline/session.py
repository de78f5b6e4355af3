"""Session settings shared by tests, benchmark and jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "assayline", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of this machine only where all tasks run in it."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/assayline-{context.applicationId}"
    return folder.rstrip("/")


# Removes the shuffle files of a query as soon as it has ended; unknown to releases before 4.1, which ignore it.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Paths written inside open ``scratch`` blocks, the innermost last.
_WRITTEN: list[list[str]] = []


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that start and end inside leave no shuffle files; for writes, whose plans nothing reads again."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that later steps read several times, and read it back.

    It cuts the lineage: a lost executor costs a read, not the steps before. Parquet keeps
    column pruning and sizes for the steps after. The shuffle files of the write go with its end.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/assayline-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialise`` and the number of rows, observed while they are written: ``df`` runs once."""
    seen = Observation()
    table = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return table, seen.get["rows"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose materialised tables are removed at its end.

    It yields ``keep``: what the block leaves behind is written by it, and lasts as long as the block
    around this one, if any. Plans built inside and not kept must not be used after the block.
    """
    _WRITTEN.append([])

    def keep(df: DataFrame) -> DataFrame:
        mine = _WRITTEN.pop()
        try:
            return materialise(df)
        finally:
            _WRITTEN.append(mine)

    try:
        yield keep
    finally:
        for path in _WRITTEN.pop():
            remove(spark, path)
