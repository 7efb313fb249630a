"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ticketlens") -> SparkSession:
    """A local session for tests and the bench (clusters bring their own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in _LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TICKETLENS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: timestamps are UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Rows and bytes that go to a Python worker at once, so its memory does not follow the size of a task's input.
PYTHON_BATCH_ROWS = 256
PYTHON_BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keep the Arrow batches of Python functions small; a smaller setting of the cluster stands."""
    for key, most in (("maxRecordsPerBatch", PYTHON_BATCH_ROWS), ("maxBytesPerBatch", PYTHON_BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Without the setting only a local session, where driver and executors are one
    machine, gets a folder of its own; on a cluster there is no safe default.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "_scratch")
        spark.sparkContext.setCheckpointDir(current)
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
