"""Session settings the operators rely on."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results depend on, and leave cluster sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cpus: int = 8, name: str = "alertloom") -> SparkSession:
    """A local session for tests and for the benchmark."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_dir(spark: SparkSession, own: str | None = None) -> str:
    """Set the folder for reliable checkpoints: the shared one the cluster names, else the caller's own, else (only in
    local mode, as in tests) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or own
    if found is None:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        found = tempfile.mkdtemp(prefix="alertloom-checkpoints-")
    spark.sparkContext.setCheckpointDir(found)
    return found
