"""Queries over the intake operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import intake
from alertloom.plans.oracle import over
from alertloom.plans.registry import query

INCIDENT = ("id, source, external_id, fingerprint, host, type, source_severity, severity, title, started_at, "
            "last_occurrence_at, resolved_at, problem_status, availability, occurrence_count")


@query("dedup_alerts", over("arrivals", sql="""
SELECT seq, source, external_id, host, type, severity, started_at, resolved_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY seq) AS nth,
    first_value(resolved_at IGNORE NULLS) OVER (PARTITION BY source, external_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS known
  FROM (SELECT seq, source, external_id, host, type, severity, started_at, resolved_at FROM arrivals) a) b WHERE nth = 1
""".replace("started_at, resolved_at FROM (\n  SELECT *", "started_at, known AS resolved_at FROM (\n  SELECT *")))
def _(t):
    return intake.dedup_alerts(t.arrivals).select("seq", "source", "external_id", "host", "type", "severity",
                                                  "started_at", "resolved_at")


@query("skip_below_threshold", over("below", sql=f"""
SELECT {INCIDENT}, 'skipped' AS analysis_state, 'below_threshold' AS skip_reason FROM below"""))
def _(t):
    return intake.skip_below_threshold(t.alerts).drop("raw")


@query("sessionize", over("assigned", sql="SELECT seq, source, fingerprint, started_at, incident_id FROM assigned"))
def _(t):
    return intake.sessionize(t.alerts).select("seq", "source", "fingerprint", "started_at", "incident_id")


@query("sessionize_oneshot", over("rolled", sql="""
SELECT source, fingerprint, id AS incident_id, started_at, last_occurrence_at, occurrence_count, severity
FROM rolled WHERE source = 'security'"""))
def _(t):
    return intake.sessionize_oneshot(t.alerts.where("source = 'security'"))


@query("incident_rollup", over("rolled", sql=f"SELECT {INCIDENT}, raw FROM rolled"))
def _(t):
    return intake.incident_rollup(t.alerts)


@query("severity_label_of_max", over("assigned", sql="""
SELECT incident_id, severity, source_severity FROM (SELECT *, row_number() OVER (PARTITION BY incident_id
  ORDER BY severity DESC, seq) AS rn FROM assigned) x WHERE rn = 1"""))
def _(t):
    return intake.severity_label_of_max(t.assigned)


@query("incident_status", over("assigned", sql="""
SELECT incident_id, count(*) AS alerts, CASE WHEN max(source) = 'security' THEN 'oneshot'
    WHEN count(*) = count(resolved_at) THEN 'resolved' ELSE 'open' END AS problem_status,
  CASE WHEN max(source) = 'problem' AND count(*) = count(resolved_at) THEN max(resolved_at) END AS resolved_at
FROM assigned GROUP BY incident_id"""))
def _(t):
    return intake.incident_status(intake.alert_refs(t.assigned))


@query("apply_recoveries", over("assigned", sql="""
WITH rec AS (SELECT 'problem' AS source, CAST(event_id AS VARCHAR) AS external_id,
    date_trunc('second', ts) + INTERVAL 1 HOUR AS resolved_at, event_id AS seq FROM events WHERE value < 120
  UNION ALL SELECT 'problem', CAST(event_id - 1 AS VARCHAR), date_trunc('second', ts), event_id FROM events WHERE value < 90),
fst AS (SELECT source, external_id, arg_min(resolved_at, seq) AS rec_at FROM rec GROUP BY 1, 2)
SELECT a.source, a.external_id, a.incident_id, a.started_at AS seen_at, coalesce(a.resolved_at, rec_at) AS resolved_at
FROM assigned a LEFT JOIN fst USING (source, external_id)"""))
def _(t):
    e = t.events
    at = F.date_trunc("second", "ts")
    one = e.where("value < 120").select(F.lit("problem").alias("source"), F.col("event_id").cast("string").alias(
        "external_id"), (at + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"), F.col("event_id").alias("seq"))
    two = e.where("value < 90").select(F.lit("problem").alias("source"), (F.col("event_id") - 1).cast("string").alias(
        "external_id"), at.alias("resolved_at"), F.col("event_id").alias("seq"))
    return intake.apply_recoveries(intake.alert_refs(t.assigned), one.unionByName(two))


@query("apply_reopens", over("assigned", sql="""
SELECT source, external_id, incident_id, started_at AS seen_at, CASE WHEN source = 'problem' AND external_id IN
  (SELECT CAST(event_id AS VARCHAR) FROM events WHERE value > 200) THEN NULL ELSE resolved_at END AS resolved_at
FROM assigned"""))
def _(t):
    listed = t.events.where("value > 200").select(F.lit("problem").alias("source"),
                                                  F.col("event_id").cast("string").alias("external_id"))
    return intake.apply_reopens(intake.alert_refs(t.assigned), listed)


@query("intake_outcomes", over("arrivals", "assigned", sql="""
WITH fst AS (SELECT source, external_id, min(seq) AS first_seq FROM arrivals GROUP BY 1, 2),
one AS (SELECT a.* FROM arrivals a JOIN fst ON a.seq = fst.first_seq),
known AS (SELECT a.source, a.external_id, arg_min(resolved_at, seq) FILTER (resolved_at IS NOT NULL) AS rec
  FROM arrivals a GROUP BY 1, 2),
ends2 AS (SELECT *, max(busy) OVER (PARTITION BY source, fingerprint ORDER BY started_at, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT one.seq, one.source, one.fingerprint, one.started_at, CASE WHEN one.source = 'security' THEN started_at
    WHEN rec IS NULL THEN TIMESTAMP '2999-01-01 00:00:00' ELSE greatest(started_at, rec) END AS busy
  FROM one JOIN known USING (source, external_id) WHERE analyzable) x)
SELECT a.seq, a.source, a.external_id, CASE WHEN a.seq <> first_seq THEN 'duplicate' WHEN NOT a.analyzable THEN 'skipped'
  WHEN e.before IS NULL OR e.started_at - INTERVAL 1800 SECOND > e.before THEN 'created' ELSE 'recurred' END AS outcome
FROM arrivals a JOIN fst USING (source, external_id) LEFT JOIN ends2 e ON e.seq = a.seq"""))
def _(t):
    return intake.intake_outcomes(t.arrivals)


@query("severity_rises", over("assigned", sql="""
SELECT incident_id, started_at AS at, seq, was, severity FROM (SELECT *, max(severity) OVER (PARTITION BY incident_id
  ORDER BY started_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM assigned) x
WHERE severity > was"""))
def _(t):
    return intake.severity_rises(t.assigned)


@query("severity_followups", over("assigned", sql="""
WITH fin AS (SELECT incident_id, min(started_at) + INTERVAL 600 SECOND AS finished_at FROM assigned GROUP BY 1),
rise AS (SELECT *, max(severity) OVER (PARTITION BY incident_id ORDER BY started_at, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM assigned)
SELECT incident_id, "at", seq, severity FROM (
  SELECT r.incident_id, r.started_at AS "at", r.seq, r.severity, row_number() OVER (PARTITION BY r.incident_id
    ORDER BY r.started_at, r.seq) AS rn
  FROM rise r JOIN fin USING (incident_id) WHERE severity > was AND started_at > finished_at) x WHERE rn = 1"""))
def _(t):
    runs = t.assigned.groupBy("incident_id").agg((F.min("started_at") + F.expr("INTERVAL 600 SECOND")).alias("finished_at"))
    return intake.severity_followups(t.assigned, runs.withColumn("status", F.lit("done")))


@query("hold_until", over("rolled", sql="""
SELECT id, source, started_at + CASE WHEN source = 'security' THEN INTERVAL 120 SECOND ELSE INTERVAL 60 SECOND END
  AS held_until FROM rolled"""))
def _(t):
    return intake.hold_until(t.rolled, t.cfg).select("id", "source", "held_until")


@query("lifecycle_events", over("assigned", "below", "rolled", sql="""
SELECT incident_id, started_at AS at, CASE WHEN seq = incident_id THEN 'detected' ELSE 'recurred' END AS type,
  CASE WHEN seq <> incident_id THEN '{"external_id":"' || external_id || '"}' WHEN source = 'security'
    THEN '{"held_sec":120}' ELSE '{"held_sec":60}' END AS detail_json FROM assigned
UNION ALL SELECT id, started_at, 'skipped', '{"reason":"below_threshold"}' FROM below
UNION ALL SELECT id, resolved_at, 'resolved', '{"resolved_at":"' || strftime(resolved_at, '%Y-%m-%dT%H:%M:%S') || '"}'
FROM rolled WHERE problem_status = 'resolved'"""))
def _(t):
    return intake.lifecycle_events(t.alerts, cfg=t.cfg)


@query("incidents_per_host", over("rolled", sql="""
SELECT host, source, count(*) AS incidents, CAST(sum(occurrence_count) AS BIGINT) AS occurrences,
  count(*) FILTER (problem_status = 'open') AS open_incidents, max(severity) AS severity, min(started_at) AS first_start,
  max(last_occurrence_at) AS last_seen FROM rolled GROUP BY host, source"""))
def incidents_per_host(t):
    return t.rolled.groupBy("host", "source").agg(
        F.count("*").alias("incidents"), F.sum("occurrence_count").alias("occurrences"),
        F.count_if(F.col("problem_status") == "open").alias("open_incidents"), F.max("severity").alias("severity"),
        F.min("started_at").alias("first_start"), F.max("last_occurrence_at").alias("last_seen"))
