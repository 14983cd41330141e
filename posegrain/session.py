"""Session helpers: table readers, the folder shared by all executors, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where none is set, a local master makes and sets one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="posegrain-")
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


ENDS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, end_shuffles: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: the lineage ends there and an executor loss costs nothing.

    Unlike a cache, the written table survives executors; unlike checkpoint(), it is columnar, so later
    readers prune columns and push filters.  ``end_shuffles``: the shuffle files of this write go with it instead of
    staying until the driver collects garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if end_shuffles:
        before = spark.conf.get(ENDS_SHUFFLES)
        spark.conf.set(ENDS_SHUFFLES, "true")
    try:
        writer.parquet(path)
    finally:
        if end_shuffles:
            spark.conf.set(ENDS_SHUFFLES, before)
    return spark.read.schema(spark.read.parquet(path).schema if partition_by else df.schema).parquet(path)


def open_shared(uri: str) -> pa.NativeFile:
    """A file of the shared folder, opened on an executor without the JVM.  Names come from ``DataFrame.inputFiles``."""
    where, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), unquote(uri.removeprefix("file:")))
    return where.open_input_file(path)
