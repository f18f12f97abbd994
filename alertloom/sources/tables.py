"""Sinks and checks of whole tables: upsert, integrity, snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.settings import SOURCES, STATES, STATUSES, TYPES


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``table`` with rows replaced or added by key. With ``order``, the last of several changes of a key wins; write the
    result as a new version, never over the table it reads."""
    if order is not None:
        rest = [c for c in changes.columns if c not in keys]
        changes = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    kept = table.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def check_tables(incidents: DataFrame, refs: DataFrame, cases: DataFrame) -> DataFrame:
    """Findings: unknown codes, keys that occur twice, references to nothing, totals that do not add up."""
    def finding(name: str, df: DataFrame, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("finding"), detail.cast("string").alias("detail"))
    parts = []
    for column, allowed in (("source", SOURCES), ("analysis_state", STATES), ("problem_status", STATUSES), ("type", TYPES)):
        odd = incidents.where(~F.col(column).isin(*allowed) | F.col(column).isNull()).groupBy(column).agg(F.count("*").alias("n"))
        parts.append(finding(f"unknown {column}", odd, F.concat_ws(" ", column, F.lit("x"), F.col("n").cast("string"))))
    twice = refs.groupBy("source", "external_id").agg(F.count("*").alias("n")).where("n > 1")
    parts.append(finding("duplicate alert", twice, F.concat_ws("/", "source", "external_id")))
    cards = cases.groupBy("incident_id").agg(F.count("*").alias("n")).where("n > 1")
    parts.append(finding("several cases", cards, F.col("incident_id")))
    known = incidents.select(F.col("id").alias("incident_id"))
    parts.append(finding("orphan alert", refs.join(known, "incident_id", "left_anti"), F.concat_ws("/", "source", "external_id")))
    parts.append(finding("orphan case", cases.join(known, "incident_id", "left_anti"), F.col("id")))
    counted = refs.groupBy("incident_id").agg(F.count("*").alias("n"))
    off = incidents.where("source <> 'group' AND analysis_state <> 'skipped'").join(counted, F.col("id") == F.col("incident_id"), "left").where(
        F.col("occurrence_count") != F.coalesce("n", F.lit(0)))
    parts.append(finding("count differs", off, F.col("id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-free checksum of a table, one row."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def manifest_of(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        part = table_digest(df, name)
        out = part if out is None else out.unionByName(part)
    return out


def write_snapshot(tables: dict[str, DataFrame], path: str, stamp: str) -> str:
    """Export all tables as one generation. The manifest is written last, so a generation without one is unfinished."""
    base = f"{path}/gen={stamp}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    written = {name: spark.read.parquet(f"{base}/{name}") for name in tables}
    manifest_of(written).withColumn("taken_at", F.lit(stamp)).coalesce(1).write.mode("errorifexists").parquet(f"{base}/_manifest")
    return base


def verify_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """Tables of a generation that differ from its manifest; empty when it may be used."""
    stored = spark.read.parquet(f"{base}/_manifest").select("name", F.col("rows").alias("want_rows"), F.col("checksum").alias("want"))
    names = [r["name"] for r in stored.select("name").collect()]  # one row per table
    found = manifest_of({n: spark.read.parquet(f"{base}/{n}") for n in names})
    return stored.join(found, "name", "full").where(~(F.col("rows").eqNullSafe(F.col("want_rows")) & F.col("checksum").eqNullSafe(F.col("want"))))


def generations_to_drop(generations: DataFrame, keep: int) -> DataFrame:
    """``generations(stamp)``: all but the newest ``keep``. One row per nightly run, so the list is short."""
    nth = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("stamp")))
    return generations.withColumn("nth", nth).where(F.col("nth") > keep).select("stamp")
