"""Session settings that the jobs are written for. A session that already exists is used as it is, but for `fit_session`."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SPARK_DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": "65535", "spark.sql.requireAllClusterKeysForCoPartition": "true"}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Inputs partitioned by stock_id may join on (stock_id, month) without another exchange: the
    # rows of one stock are bounded by the calendar, so the coarser key is safe.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # HotSpot interprets methods above 8000 bytes of code; plain operators are faster than that.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Checkpoint files go away with the DataFrame they belong to.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Recording the Python line of every column expression more than doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("marketloom")
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS, **extra)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fit_session(spark: SparkSession) -> None:
    """Gives a session that was not built here the two runtime settings that the plans depend on most: no generated code that HotSpot
    would interpret, and no exchange by (stock_id, month) of what lies by stock_id. Neither changes a result, and a value that somebody
    has set stays."""
    for name, default in SPARK_DEFAULTS.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, SETTINGS[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Only a session in local mode may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marketloom-"))
    return spark.sparkContext.getCheckpointDir()
