"""Retention: what may be deleted, what loses its payload, and the report of a run."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.times import add_seconds
from alertloom.settings import GROUP, Settings

DAY = 86400
ENDED = ("done", "failed", "skipped", "grouped")


def _aged(now: Column, cfg: Settings) -> Column:
    last = F.coalesce("resolved_at", "last_occurrence_at")
    skipped = (F.col("analysis_state") == "skipped") & (F.col("updated_at") < add_seconds(now, -DAY * cfg.retention_skipped_days))
    return F.coalesce(skipped | (last < add_seconds(now, -DAY * cfg.retention_incident_days)), F.lit(False))


def retention_marks(incidents: DataFrame, cases: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Incidents with ``aged``, ``has_case`` and ``gone``: a single one goes when it ended, is not open, has no case and is
    old enough; a group goes with all its members, and only when it and every member may."""
    with_case = cases.select(F.col("incident_id").alias("id")).distinct().withColumn("has_case", F.lit(True))
    is_group = F.col("source") == GROUP
    finished = (F.col("problem_status") != "open") & F.col("analysis_state").isin(*ENDED) & ~F.col("has_case")
    judged = (incidents.join(with_case, "id", "left").withColumn("has_case", F.coalesce("has_case", F.lit(False)))
              .withColumn("aged", _aged(now, cfg)).withColumn("expired", finished & F.col("aged"))
              .withColumn("family", F.coalesce("group_id", F.when(is_group, F.col("id")))))
    families = judged.where("family IS NOT NULL").groupBy("family").agg(
        (F.bool_and("expired") & F.bool_or(is_group)).alias("all_expired"))
    single = F.col("family").isNull()
    return judged.join(families, "family", "left").withColumn(
        "gone", F.when(single, F.col("expired")).otherwise(F.col("all_expired")))


def expired_incidents(incidents: DataFrame, cases: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Single incidents that may go."""
    return retention_marks(incidents, cases, now, cfg).where("gone AND family IS NULL").select("id")


def expired_groups(incidents: DataFrame, cases: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Groups that may go, and their members."""
    return retention_marks(incidents, cases, now, cfg).where("gone AND family IS NOT NULL").select("id")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the incidents ``ids(id)``; the key is ``id`` in incidents, ``incident_id`` elsewhere."""
    gone = ids.select("id").distinct()
    out = {}
    for name, df in tables.items():
        key = "id" if name == "incidents" else "incident_id"
        out[name] = df.join(gone.withColumnRenamed("id", key), key, "left_anti")
    return out


def _payload_goes(now: Column, cfg: Settings) -> Column:
    old = F.coalesce("resolved_at", "last_occurrence_at") < add_seconds(now, -DAY * cfg.retention_payload_days)
    return F.coalesce((F.col("raw_json") != "{}") & (F.col("source") != GROUP) & (F.col("problem_status") != "open")
                      & F.col("analysis_state").isin(*ENDED) & old, F.lit(False))


def clear_payloads(incidents: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Payloads of ended incidents become ``{}`` after their time."""
    goes = _payload_goes(now, cfg)
    return incidents.withColumns({"cleared": goes, "raw_json": F.when(goes, "{}").otherwise(F.col("raw_json"))})


def clear_contexts(analyses: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    old = F.col("started_at") < add_seconds(now, -DAY * cfg.retention_payload_days)
    return analyses.withColumns({"cleared": F.col("context_json").isNotNull() & old,
                                 "context_json": F.when(~old, F.col("context_json"))})


def retention_report(incidents: DataFrame, refs: DataFrame, log: DataFrame, analyses: DataFrame, cases: DataFrame, now: Column,
                     cfg: Settings = Settings()) -> DataFrame:
    """Counts of what a run deletes and clears. A dry run is this report without the write."""
    marked = retention_marks(incidents, cases, now, cfg).withColumn("payload", _payload_goes(now, cfg))
    old_context = clear_contexts(analyses, now, cfg)

    def per_incident(df: DataFrame, **counts: Column) -> DataFrame:
        return df.groupBy(F.col("incident_id").alias("id")).agg(*[c.alias(n) for n, c in counts.items()])
    # every child table is counted per incident before it is joined, and the incidents are read once
    wide = marked.join(per_incident(log, events=F.count("*")), "id", "left") \
        .join(per_incident(refs, alerts=F.count("*")), "id", "left") \
        .join(per_incident(old_context, runs=F.count("*"), contexts=F.count_if("cleared")), "id", "full")
    gone = F.coalesce("gone", F.lit(False))
    none = F.lit(0)
    row = wide.agg(
        F.count_if(gone).alias("incidents_deleted"), F.coalesce(F.sum(F.when(gone, F.col("events"))), none).alias("events_deleted"),
        F.coalesce(F.sum(F.when(gone, F.col("alerts"))), none).alias("alert_refs_deleted"),
        F.coalesce(F.sum(F.when(gone, F.col("runs"))), none).alias("analyses_deleted"),
        F.count_if(~gone & F.col("payload")).alias("payloads_cleared"),
        F.coalesce(F.sum(F.when(~gone, F.col("contexts"))), none).alias("contexts_cleared"),
        F.count_if((F.col("problem_status") != "open") & F.col("aged") & F.col("has_case")).alias("kept_for_cases"))
    return row.unpivot([], row.columns, "what", "rows")
