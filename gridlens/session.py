"""Session helpers: construction, scale limits, lineage cuts and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows one window group or one collected bracket may hold
#: before an operator switches to its split plan.
GROUP_ROWS_KEY = "spark.gridlens.maxGroupRows"
GROUP_ROWS_DEFAULT = 4_000_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benches. On a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("GRIDLENS_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where it is set; on one machine a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/gridlens/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least: int = 4096) -> DataFrame:
    """Rows written anew in even partitions where one holds more than ``least`` and twice its share: a row group of a file is one partition."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return cut_lineage(df.repartition(tasks)) if max(held, default=0) > max(least, 2 * sum(held) / tasks) else df


#: Rows of a narrow lookup table that may be broadcast.
LOOKUP_ROWS = 200_000


def lookup(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """A narrow table to join with: written once, counted, and broadcast only if it is small.

    Aggregates and local tables have no size the optimizer knows, so without this a large table
    would be shuffled, on a possibly skewed key, to meet a list of a few rows. A larger lookup keeps
    the ordinary join, where skewed keys are split at run time.
    """
    held = cut_lineage(df)
    return F.broadcast(held) if held.count() <= rows else held
