"""Files that tasks write and read themselves, in a folder all machines share."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI with its file system, as Spark itself understands it on the driver.

    A plain path belongs to the cluster's default file system, not to the disk of the machine that happens
    to run a task. A ``file:`` folder on a cluster must be one that all machines mount.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, for pyarrow. s3a is the same store as s3."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    for hadoop in ("s3a://", "s3n://"):
        if uri.startswith(hadoop):
            uri = "s3://" + uri[len(hadoop) :]
    return fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """A file by its URI, for random access."""
    system, path = open_folder(uri)
    return system.open_input_file(path)
