"""Spark session settings and the shared scratch location."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are designed for. Every one can be overridden by the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Look-ups join a wide row stream with one row per key, so a hot key is
    # skewed on the stream side only and AQE can split it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "claimsieve", master: str | None = None, **conf: str) -> SparkSession:
    """Create or get a session with :data:`SESSION_CONF` and the given overrides."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, so its functions run where only the driver has it installed."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    target = Path(SparkFiles.getRootDirectory()) / f"{package.name}-package.zip"
    if any(name.endswith(target.name) for name in context.listFiles):
        return
    # The driver serves this file from its own Spark folder, which goes when the session ends.
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))


def scratch_root(spark: SparkSession) -> str:
    """This session's scratch folder, below ``spark.checkpoint.dir`` or else below the warehouse; executors share either."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/claimsieve-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this session has stored; frames that read it can't be used afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, spread_by: str | None = None) -> DataFrame:
    """Write a frame to the scratch folder and read it back.

    Used where a frame is read many times: later passes plan from a plain scan and
    a lost executor costs no recomputation of what came before. ``spread_by`` hashes
    rows evenly over files first, which pays off when every pass is compute-bound.
    """
    path = scratch_path(df.sparkSession, name)
    df = df if spread_by is None else df.repartition(spread_by)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def range_buckets(spark: SparkSession) -> int:
    """How many value ranges a global ordering is split into (bounded)."""
    return max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
