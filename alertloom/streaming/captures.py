"""Raw captures as a stream: read, normalised, split into alerts and rejects, and counted, once per batch and restartable.

A batch writes its alerts, its rejects and then one row of counts under its number. The counts are the commit: readers take
only batches that have them, and a batch that runs again after a failure replaces all it wrote. The position is the checkpoint of
the query, which knows the files that were read; ``position`` tells how far they reach in time.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alertloom.operators import normalize
from alertloom.settings import Settings

REASONS = "batch BIGINT, elements BIGINT, accepted BIGINT, rejected BIGINT, below_threshold BIGINT, oldest TIMESTAMP, newest TIMESTAMP"


def stream_captures(spark: SparkSession, path: str, files_per_batch: int | None = None, lines: bool = False) -> DataFrame:
    """Captured JSON as ``value, origin``: an array per file, or with ``lines`` an element per line, as files arrive."""
    reader = spark.readStream.format("text").option("wholetext", str(not lines).lower())
    files = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)
    value = F.concat(F.lit("["), "value", F.lit("]")) if lines else F.col("value")
    return files.select(value.alias("value"), F.col("_metadata.file_path").alias("origin"))


def problems(cfg: Settings = Settings()) -> Callable[[DataFrame], DataFrame]:
    """Normalisation of problems for ``land``. A recovery without a time is given that of the batch."""
    return lambda items: normalize.normalize_problems(items, F.current_timestamp(), cfg)


def security_alerts(cfg: Settings = Settings()) -> Callable[[DataFrame], DataFrame]:
    return lambda items: normalize.normalize_security(items, cfg)


def land(captures: DataFrame, normalise: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start the query that lands captures below ``out``; it takes all files that are there and ends."""
    def write(batch: DataFrame, number: int) -> None:
        rows = normalise(normalize.explode_captures(batch)).persist()
        good, bad = normalize.split_rejects(rows)
        good.write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        usable = F.col("reject_reason").isNull()
        counts = rows.agg(F.count("*").alias("elements"), F.count_if(usable).alias("accepted"), F.count_if(~usable).alias("rejected"),
                          F.count_if(usable & ~F.col("analyzable")).alias("below_threshold"), F.min(F.when(usable, F.col("started_at"))).alias("oldest"),
                          F.max(F.when(usable, F.col("started_at"))).alias("newest"))
        counts.write.mode("overwrite").parquet(f"{out}/quality/batch={number}")
        rows.unpersist()
    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quality(spark: SparkSession, out: str) -> DataFrame:
    """One row of counts per finished batch."""
    wanted = StructType.fromDDL(REASONS)
    return spark.read.schema(wanted).parquet(f"{out}/quality").select(*wanted.names)


def landed(spark: SparkSession, out: str, kind: str = "alerts") -> DataFrame:
    """Alerts or rejects of the finished batches, with the number of the batch."""
    return spark.read.parquet(f"{out}/{kind}").join(quality(spark, out).select("batch"), "batch", "left_semi")


def position(spark: SparkSession, out: str) -> DataFrame:
    """One row: the last finished batch, the newest time taken in, and the totals so far."""
    return quality(spark, out).agg(F.max("batch").alias("batch"), F.max("newest").alias("newest"), *[
        F.sum(c).alias(c) for c in ("elements", "accepted", "rejected", "below_threshold")])
