"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a written table of contracts or cases may be broadcast; beyond, Spark joins it by shuffling.
BROADCAST_ROWS = 100_000


def local_session(cores: str = "8", app: str = "bridgeflow") -> SparkSession:
    """A local session for tests and the benchmark, with a checkpoint folder of its own; a cluster brings both."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")  # one machine, so its folder is shared
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage; rows, partitions and their order are then fixed."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked to be joined by sorting, never sent whole to the driver.

    Spark's estimate starts from the sizes of files, which are packed: a large table of nodes or
    ids made from a few columns passes for one that is small enough to broadcast.
    """
    return df.hint("merge")


def counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once, and marked for broadcast if it has at most ``limit`` rows."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= limit else df
