"""Session helpers: builder defaults, UTC time zone, reliable checkpoint directory."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folder of the intermediate tables, inside the session's checkpoint directory.
TABLES = "adyield-tables"


def build_session(master: str | None = None, app_name: str = "adyield",
                  shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the library assumes.

    On a cluster, ``master`` is left to spark-submit; locally pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if driver_memory or (master or "").startswith("local"):
        # Local mode runs every task inside the driver JVM.
        builder = builder.config("spark.driver.memory", driver_memory or "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


# Bytes of a batch between the JVM and Python workers: the row limit alone lets long texts fill a worker's memory.
ARROW_BATCH = "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every query relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``: a folder that the driver and all executors share.

    Only a ``local`` master, whose executors run in the driver's own process, may go without: it gets a
    temporary folder that is removed when the process ends. Any other master must name a shared folder,
    because tables written to one machine's own disk cannot be read back by the others.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="adyield-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object: the way that Spark itself reaches any store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Length and modification time of tables (files, or folders of part files): changes when their data does."""
    out = []
    for path in paths:
        fs, where = file_system(spark, path)
        if fs.exists(where):
            out += sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(where))
    return "|".join(out)


def drop_intermediates(spark: SparkSession) -> None:
    """Remove the session's intermediate tables from the shared folder, once no plan reads them any more."""
    fs, where = file_system(spark, os.path.join(ensure_checkpoint_dir(spark), TABLES))
    fs.delete(where, True)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint directory and read it back.

    The result has a one-step lineage (a file scan), survives executor loss,
    and keeps column pruning and filter pushdown for the plans that read it.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), TABLES, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
