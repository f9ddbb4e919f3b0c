"""Session settings the transformations rely on."""

from __future__ import annotations

import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# All of these are runtime settings, so they also apply to a session that a
# cluster has already started.
RUNTIME = {
    # Naive dates are UTC, and so is the day a feed date is cut to.
    "spark.sql.session.timeZone": "UTC",
    # Joins are left unhinted: measured shuffle sizes decide between broadcast
    # and sort-merge, and oversized partitions of a hot key are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Work after a shuffle is parsing and pattern search, so even small shuffles
    # keep all cores busy.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # The JVM does not compile methods beyond this size; larger generated ones
    # (the figure patterns give such) are then split up instead of fused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # HTML bodies are wide, so fewer of them go into one Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out evenly; any other as it is.

    For narrow work that costs far more than reading, such as pattern search
    over a few small files. Large inputs have splits enough and are never
    shuffled by this. ``scan`` has to be a plain scan, so that counting its
    splits runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local run may leave it unset; a temporary folder is then made, once per
    process. On a cluster each executor would have a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidings-")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder.

    A boundary behind parsing: what comes after it may use the rows several times,
    and none of it starts the parsing over.
    """
    path = work_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@functools.cache
def _shipped(application: str, context) -> str:
    folder = tempfile.mkdtemp(prefix="tidings-")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(f"{folder}/tidings", "zip", root, "tidings")
    context.addPyFile(archive)
    return archive


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Needed where it is not installed on them, for the HTML jobs.
    """
    _shipped(spark.sparkContext.applicationId, spark.sparkContext)
    return spark
