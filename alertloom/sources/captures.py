"""Readers: captured alerts, manuals, and the selections a source applies before it hands rows over."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.times import seconds
from alertloom.operators.normalize import explode_captures
from alertloom.settings import Settings

MAX_FILE = 5 * 1024 * 1024


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Elements of captured JSON arrays, one array per file; ``origin`` is the file. Arrays are read whole, so large captures
    should come as many files."""
    return explode_captures(spark.read.text(path, wholetext=True).withColumn("origin", F.col("_metadata.file_path")))


def read_capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for JSON lines: splittable, so files may be of any size."""
    lines = spark.read.text(path).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value"), F.col("_metadata.file_path").alias("origin"))
    return explode_captures(lines)


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    return read_captures(spark, path)


def read_security_alerts(spark: SparkSession, path: str) -> DataFrame:
    return read_captures(spark, path)


def read_manual(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Markdown files as (file, text, sha256), and the files that are too large or no UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    base = "/" + path.rstrip("/").rpartition("/")[2] + "/"  # files are named by their path below the folder
    below = F.when(F.contains("path", F.lit(base)), F.substr(F.col("path"), F.locate(base, F.col("path")) + len(base))).otherwise(F.regexp_replace("path", "^.*/", ""))
    named = files.select(below.alias("file"), "length", "content")
    reason = F.when(F.col("length") > MAX_FILE, "too large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    tagged = named.withColumn("reason", reason)
    good = tagged.where("reason IS NULL").select("file", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"))
    return good, tagged.where("reason IS NOT NULL").select("file", "reason")


def select_alertable(raw: DataFrame, start: Column, end: Column, cfg: Settings = Settings()) -> DataFrame:
    """Time range, and level high enough or rule named. Plain comparisons, so a Parquet scan takes them over."""
    named = F.col("rule_id").isin(*cfg.named_rules) if cfg.named_rules else F.lit(False)
    return raw.where(F.col("ts").between(start, end) & ((F.col("level") >= cfg.min_level) | named))


def select_by_severity(raw: DataFrame, fetch_min: int = 1) -> DataFrame:
    return raw.where((F.col("severity") >= fetch_min) & ~F.col("suppressed"))


def attach_trigger(problems: DataFrame, triggers: DataFrame) -> DataFrame:
    """Host and item of the trigger of each problem; without a trigger the host is ``unknown``. Spark picks the join by the
    measured size of the trigger table."""
    return problems.join(triggers, "trigger_id", "left").withColumn("host", F.coalesce("host", F.lit("unknown")))


def read_increment(alerts: DataFrame, stored: DataFrame, position: Column, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Rows from ``overlap`` before the position up to now that are not stored yet."""
    low = F.timestamp_seconds(seconds(position) - cfg.overlap)
    return alerts.where(F.col("started_at").between(low, now)).join(stored.select("source", "external_id"), ["source", "external_id"], "left_anti")


def next_position(alerts: DataFrame, position: Column, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """The position after a read: the newest time capped at now; it never moves back."""
    low = F.timestamp_seconds(seconds(position) - cfg.overlap)
    newest = F.max(F.least("started_at", now))
    return alerts.where(F.col("started_at").between(low, now)).agg(F.greatest(newest, position).alias("position"))


def reread_late(alerts: DataFrame, stored: DataFrame, mark: Column, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Rows just before the mark of an unfinished backlog that became visible late. The position stays."""
    low = F.timestamp_seconds(seconds(mark) - cfg.overlap)
    return alerts.where(F.col("started_at").between(low, F.least(mark, now))).join(
        stored.select("source", "external_id"), ["source", "external_id"], "left_anti")


def take_backlog(alerts: DataFrame, ts: Column, tie: Column, n: int) -> DataFrame:
    """The next ``n`` rows after a position in the order (ts, tie). Rows without a tie have no place in it: ``backlog_rejects`` lists them."""
    after = (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("tie") > tie))
    return alerts.where(F.col("tie").isNotNull() & after).orderBy("ts", "tie").limit(n)


def backlog_rejects(alerts: DataFrame, ts: Column, tie: Column) -> DataFrame:
    """Rows at or after a position that ``take_backlog`` can never reach, with the reason."""
    reason = F.when(F.col("ts").isNull(), "no time").when(F.col("tie").isNull(), "no tie value")
    here = F.col("ts").isNull() | (F.col("ts") >= ts)
    return alerts.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull() & here & tie.isNotNull())
