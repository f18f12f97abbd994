"""Alerts to incidents: duplicates, sessions per fingerprint, recovery, outcomes and the lifecycle log.

Columns of ``alerts``: seq, source, external_id, fingerprint, host, type, severity, source_severity, title, started_at,
resolved_at, availability, analyzable, raw. ``seq`` is the unique arrival number; the id of an incident is the ``seq``
of its first alert.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.times import add_seconds, seconds
from alertloom.operators.scans import carry_state
from alertloom.settings import SECURITY, Settings

NEVER = 1 << 52
DAY = 86400
FIRST = ("external_id", "host", "type", "title", "raw", "availability")


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per (source, external_id): the first to arrive, with the first recovery any copy brought."""
    kept = [c for c in alerts.columns if c not in ("source", "external_id", "resolved_at")]
    first = F.min_by(F.struct(*kept), F.col("seq"))
    recovery = F.min_by("resolved_at", F.when(F.col("resolved_at").isNotNull(), F.col("seq")))
    one = alerts.groupBy("source", "external_id").agg(first.alias("a"), recovery.alias("resolved_at"))
    return one.select("source", "external_id", "a.*", "resolved_at").select(*alerts.columns)


def skip_below_threshold(alerts: DataFrame) -> DataFrame:
    """Alerts below the threshold: each is an incident of its own, skipped, and takes in no other."""
    return alerts.where(~F.col("analyzable")).select(
        F.col("seq").alias("id"), "source", "external_id", "fingerprint", "host", "type", "source_severity", "severity",
        "title", "started_at", F.col("started_at").alias("last_occurrence_at"), "resolved_at",
        F.when(F.col("source") == SECURITY, "oneshot").when(F.col("resolved_at").isNull(), "open")
        .otherwise("resolved").alias("problem_status"),
        "availability", F.lit(1).cast("bigint").alias("occurrence_count"), "raw",
        F.lit("skipped").alias("analysis_state"), F.lit("below_threshold").alias("skip_reason"))


def _busy_until() -> Column:
    s = seconds(F.col("started_at"))
    return (F.when(F.col("source") == SECURITY, s).when(F.col("resolved_at").isNull(), F.lit(NEVER))
            .otherwise(F.greatest(s, seconds(F.col("resolved_at")))))


def session_seconds(alerts: DataFrame, gap: int = 1800) -> DataFrame:
    """Alerts above the threshold folded to one row per (source, fingerprint, second), with the incident they open or
    join. Hot fingerprints are folded before any ordering, and each day of a fingerprint is ordered on its own."""
    key = ["source", "fingerprint"]
    folded = (alerts.where("analyzable").withColumn("s", seconds(F.col("started_at")))
              .groupBy(*key, "s").agg(
                  F.max(_busy_until()).alias("busy"), F.min("seq").alias("first_seq"), F.count("*").alias("n"),
                  F.count("resolved_at").alias("n_resolved"), F.max("resolved_at").alias("resolved_at"),
                  F.max("severity").alias("severity"),
                  F.max(F.struct(F.col("severity"), (-F.col("seq")).alias("o"), F.col("source_severity"))).alias("top"),
                  F.min_by(F.struct(*FIRST), "seq").alias("first"))
              .withColumn("chunk", F.floor(F.col("s") / DAY)))
    inside = W.partitionBy(*key, "chunk").orderBy("s")
    opens = lambda at, busy: busy.isNull() | (at - gap > busy)
    # a second that opens an incident as far as its day knows; of these only the last can do so against an earlier day as well
    # without the ones before it, so it is all that the next days need
    folded = folded.withColumn("_busy", F.max("busy").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    folded = folded.withColumn("_open", F.when(opens(F.col("s"), F.col("_busy")), F.struct("s", "first_seq")))
    carried = carry_state(folded, key, "chunk", {"_until": F.max("busy"), "_last": F.max("_open")}, [
        {"_busy_before": lambda before: F.max("_until").over(before)},
        {"_stands": lambda _: F.when(opens(F.col("_last.s"), F.col("_busy_before")), F.col("_last"))},
        {"_open_before": lambda before: F.max("_stands").over(before)}], ["_busy_before", "_open_before"])
    stands = F.when(opens(F.col("s"), F.col("_busy_before")), F.col("_open"))
    current = F.coalesce(F.max(stands).over(inside.rowsBetween(W.unboundedPreceding, 0)), F.col("_open_before"))
    return (carried.withColumn("_now", current).withColumn("incident_id", F.col("_now.first_seq"))
            .drop("chunk", "_busy", "_open", "_busy_before", "_open_before", "_now"))


def sessionize(alerts: DataFrame, gap: int = 1800) -> DataFrame:
    """Every alert above the threshold with its ``incident_id``. An incident takes in what starts while it is open, or
    within ``gap`` seconds of its last occurrence or recovery."""
    places = session_seconds(alerts, gap).select("source", "fingerprint", "s", "incident_id")
    tagged = alerts.where("analyzable").withColumn("s", seconds(F.col("started_at")))
    return tagged.join(places, ["source", "fingerprint", "s"]).drop("s")


def sessionize_oneshot(alerts: DataFrame, gap: int = 1800) -> DataFrame:
    """Incidents of alerts that know no recovery, by inactivity only: the built-in session window."""
    held = alerts.where("analyzable")
    # one row per second first, so a noisy fingerprint is small before its sessions are merged
    folded = held.groupBy("source", "fingerprint", "started_at").agg(
        F.count("*").alias("n"), F.min("seq").alias("seq"), F.max("severity").alias("severity"))
    window = F.session_window("started_at", f"{gap} seconds")  # a start exactly at the gap still merges
    return (folded.groupBy("source", "fingerprint", window)
            .agg(F.min_by("seq", F.struct("started_at", "seq")).alias("incident_id"),
                 F.min("started_at").alias("first_at"), F.max("started_at").alias("last_occurrence_at"),
                 F.sum("n").alias("occurrence_count"), F.max("severity").alias("severity"))
            .withColumnRenamed("first_at", "started_at").drop("session_window"))


def incident_rollup(alerts: DataFrame, gap: int = 1800) -> DataFrame:
    """Incidents of all alerts above the threshold, straight from the per-second fold: no join back to the alerts."""
    first = F.min_by("first", F.col("s"))
    top = F.max(F.struct(F.col("top.severity"), F.col("top.o"), F.col("top.source_severity"))).alias("top")
    rolled = session_seconds(alerts, gap).groupBy("source", "fingerprint", "incident_id").agg(
        first.alias("a"), top, F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("n").alias("n"),
        F.sum("n_resolved").alias("done"), F.max("resolved_at").alias("latest"))
    status = (F.when(F.col("source") == SECURITY, "oneshot").when(F.col("n") == F.col("done"), "resolved")
              .otherwise("open"))
    return rolled.select(
        F.col("incident_id").alias("id"), "source", "a.external_id", "fingerprint", "a.host", "a.type",
        F.col("top.source_severity").alias("source_severity"), F.col("top.severity").alias("severity"), "a.title",
        F.timestamp_seconds("lo").alias("started_at"), F.timestamp_seconds("hi").alias("last_occurrence_at"),
        F.when(status == "resolved", F.col("latest")).alias("resolved_at"), status.alias("problem_status"),
        "a.availability", F.col("n").alias("occurrence_count"), "a.raw")


def severity_label_of_max(assigned: DataFrame) -> DataFrame:
    """Label of the earliest arrival among the most severe alerts of an incident: it changes only on a strict rise."""
    best = F.max(F.struct(F.col("severity"), (-F.col("seq")).alias("o"), F.col("source_severity")))
    return (assigned.groupBy("incident_id").agg(best.alias("b"))
            .select("incident_id", F.col("b.severity").alias("severity"), F.col("b.source_severity").alias("source_severity")))


def alert_refs(assigned: DataFrame) -> DataFrame:
    return assigned.select("source", "external_id", "incident_id", F.col("started_at").alias("seen_at"), "resolved_at")


def incident_status(refs: DataFrame) -> DataFrame:
    """Resolved at the latest recovery once every alert recovered, else open; a oneshot source stays oneshot."""
    done = F.count("*") == F.count("resolved_at")
    status = F.when(F.first("source") == SECURITY, "oneshot").when(done, "resolved").otherwise("open")
    return (refs.groupBy("incident_id").agg(status.alias("problem_status"), F.max("resolved_at").alias("latest"),
                                            F.count("*").alias("alerts"))
            .select("incident_id", "alerts", "problem_status",
                    F.when(F.col("problem_status") == "resolved", F.col("latest")).alias("resolved_at")))


def apply_recoveries(refs: DataFrame, recoveries: DataFrame) -> DataFrame:
    """``recoveries(source, external_id, resolved_at, seq)``: the first recovery of an unresolved alert wins."""
    first = recoveries.groupBy("source", "external_id").agg(F.min_by("resolved_at", "seq").alias("_new"))
    return (refs.join(first, ["source", "external_id"], "left")
            .withColumn("resolved_at", F.coalesce("resolved_at", "_new")).drop("_new").select(*refs.columns))


def apply_reopens(refs: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed(source, external_id)`` holds alerts seen unresolved again: their recovery is withdrawn."""
    again = listed.select("source", "external_id").distinct().withColumn("_again", F.lit(True))
    return (refs.join(again, ["source", "external_id"], "left")
            .withColumn("resolved_at", F.when(F.col("_again").isNull(), F.col("resolved_at")))
            .drop("_again").select(*refs.columns))


def intake_outcomes(alerts: DataFrame, gap: int = 1800) -> DataFrame:
    """created, recurred, skipped or duplicate for every alert that arrived, copies included."""
    first = alerts.groupBy("source", "external_id").agg(F.min("seq").alias("_first"))
    places = session_seconds(dedup_alerts(alerts), gap).select("source", "fingerprint", "s", "incident_id")
    tagged = (alerts.join(first, ["source", "external_id"]).withColumn("s", seconds(F.col("started_at")))
              .join(places, ["source", "fingerprint", "s"], "left"))
    outcome = (F.when(F.col("seq") != F.col("_first"), "duplicate").when(~F.col("analyzable"), "skipped")
               .when(F.col("seq") == F.col("incident_id"), "created").otherwise("recurred"))
    return tagged.select("seq", "source", "external_id", outcome.alias("outcome"))


def severity_rises(assigned: DataFrame) -> DataFrame:
    """Alerts at which the severity of an incident strictly rose. At most one row per incident and severity is ordered."""
    firsts = assigned.groupBy("incident_id", "severity").agg(
        F.min(F.struct("started_at", "seq")).alias("at"))
    before = W.partitionBy("incident_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return (firsts.withColumn("was", F.max("severity").over(before)).where("severity > was")
            .select("incident_id", F.col("at.started_at").alias("at"), F.col("at.seq").alias("seq"), "was", "severity"))


def severity_followups(assigned: DataFrame, analyses: DataFrame) -> DataFrame:
    """First strict rise after an incident's first finished run: one follow-up per incident at most."""
    finished = (analyses.where(F.col("status").isin("done", "failed")).groupBy("incident_id")
                .agg(F.min("finished_at").alias("finished_at")))
    late = severity_rises(assigned).join(finished, "incident_id").where("at > finished_at")
    return (late.groupBy("incident_id").agg(F.min_by(F.struct("at", "seq", "severity"), F.struct("at", "seq")).alias("r"))
            .select("incident_id", "r.at", "r.seq", "r.severity"))


def hold_until(incidents: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    hold = F.when(F.col("source") == SECURITY, cfg.hold_security).otherwise(cfg.hold_problem)
    return incidents.withColumn("held_until", add_seconds(F.col("started_at"), hold))


def lifecycle_events(alerts: DataFrame, gap: int = 1800, cfg: Settings = Settings()) -> DataFrame:
    """Append-only log derived from the intake: detected, recurred, skipped, resolved."""
    unique = dedup_alerts(alerts)
    assigned = sessionize(unique, gap)
    hold = F.when(F.col("source") == SECURITY, cfg.hold_security).otherwise(cfg.hold_problem)
    born = F.col("seq") == F.col("incident_id")
    arrivals = assigned.select(
        "incident_id", F.col("started_at").alias("at"), F.when(born, "detected").otherwise("recurred").alias("type"),
        F.when(born, F.to_json(F.struct(hold.alias("held_sec"))))
        .otherwise(F.to_json(F.struct("external_id"))).alias("detail_json"))
    below = skip_below_threshold(unique).select(
        F.col("id").alias("incident_id"), F.col("started_at").alias("at"), F.lit("skipped").alias("type"),
        F.lit('{"reason":"below_threshold"}').alias("detail_json"))
    ended = incident_status(alert_refs(assigned)).where("problem_status = 'resolved'").select(
        "incident_id", F.col("resolved_at").alias("at"), F.lit("resolved").alias("type"),
        F.to_json(F.struct(F.date_format("resolved_at", "yyyy-MM-dd'T'HH:mm:ss").alias("resolved_at"))).alias("detail_json"))
    return arrivals.unionByName(below).unionByName(ended)
