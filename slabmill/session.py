"""Session helpers: building a tuned session and finding shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "slabmill", cpus: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benches; a cluster passes its own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.driver.memory", os.environ.get("SLABMILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Runtime settings the operators rely on; safe to apply to a session passed in.

    Skewed join keys are split even where that costs one more shuffle, and all
    timestamps are one UTC type, so filters on them reach the parquet scan. A plan
    may have dozens of joins, and each table that Spark broadcasts passes the driver
    as a hash table of ten times its size, so only small ones go that way; a task
    takes few enough rows for its sorts and windows to fit in memory.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.autoBroadcastJoinThreshold": "1m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    }.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only where the session names none (tests, a laptop) is a temporary one made.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = tempfile.mkdtemp(prefix="slabmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, of whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_stored(spark: SparkSession, path: str) -> bool:
    files, where = hadoop_path(spark, path)
    return files.exists(where)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one, grouped by application so it can be purged."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/slabmill/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to shared storage and read it back.

    Later steps then start from a short plan with known sizes, and losing an
    executor costs nothing that is already written.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint on shared storage: survives losing any executor."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def reuse(df: DataFrame) -> DataFrame:
    """Keep a frame that several branches of one plan read.

    Lineage is kept, so partitions lost with an executor are recomputed.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)
