"""Queries over readers, normalisation, selections and table checks."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from alertloom.operators import intake, normalize
from alertloom.plans import adapters
from alertloom.plans.oracle import over
from alertloom.plans.registry import ORACLES, query
from alertloom.session import checkpoint_dir
from alertloom.settings import Settings
from alertloom.sources import captures, snapshots, tables

NOW = f"TIMESTAMP '{adapters.NOW}'"
PER_TASK = 50_000  # captured arrays that one task parses


def problem_captures(t):
    """Every event as a captured array: a scalar that is not usable, and the problem, mistyped in one of nine."""
    return t._view(r"""SELECT CAST(event_id AS STRING) AS origin, concat('[7, {"eventid": ', CASE WHEN event_id % 9 = 3 THEN 'true' ELSE concat('"', event_id, '"') END, ', "objectid": ', user_id,
  ', "severity": "', event_id % 6, '", "clock": "', unix_timestamp(ts), '", "name": "load \\ud800 on host", "r_eventid": "', CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id + 1 END,
  '", "r_clock": "', CASE WHEN event_id % 4 = 1 THEN unix_timestamp(ts) + 60 ELSE 0 END, '", "tags": [{"tag": "component", "value": "', CASE WHEN event_id % 2 = 0 THEN 'cpu' ELSE 'x' END,
  '"}, 5], "hosts": [{"host": "host-', user_id % 10, '"}], "items": [{"itemid": "1", "key_": "', CASE WHEN event_id % 5 = 0 THEN 'icmpping[]' ELSE 'vm.memory.size' END, '"}]}]') AS value FROM events""", events=t.spread(t.events, PER_TASK))


def security_captures(t):
    return t._view(r"""SELECT CAST(event_id AS STRING) AS origin, concat('[{"_id": "a', event_id, '", "_source": {"timestamp": "', CASE WHEN event_id % 8 = 5 THEN 'never' ELSE
  date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") END, '", "agent": {"id": "1", "name": "host-', user_id % 10, '"}, "rule": {"id": "', event_id % 1000 + 5000, '", "level": ', event_id % 16,
  ', "description": "', CASE WHEN event_id % 3 = 0 THEN '' ELSE 'login' END, '", "groups": ["', CASE event_type WHEN 'view' THEN 'sshd' WHEN 'click' THEN 'syscheck' ELSE 'web' END,
  '"]}, "data": {"srcip": "10.0.0.', user_id % 5, '"}, "full_log": "line"}}]') AS value FROM events""", events=t.spread(t.events, PER_TASK))


def security_of(t):
    return normalize.normalize_security(normalize.explode_captures(security_captures(t)), t.cfg)


def problems_of(t):
    return normalize.normalize_problems(normalize.explode_captures(problem_captures(t)), t.now, t.cfg)


@query("normalize_problems", f"""
SELECT CAST(event_id AS VARCHAR) AS external_id, 'host-' || CAST(user_id % 10 AS VARCHAR) AS host, CASE WHEN event_id % 2 = 0 THEN 'cpu' WHEN event_id % 5 = 0 THEN 'net' ELSE 'mem' END AS type,
  greatest(1, event_id % 6) AS severity, 'load  on host' AS title, date_trunc('second', ts) AS started_at, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN date_trunc('second', ts) + INTERVAL 60 SECOND
  ELSE {NOW} END AS resolved_at, substr(sha256('problem|host-' || CAST(user_id % 10 AS VARCHAR) || '|' || CAST(user_id AS VARCHAR)), 1, 16) AS fingerprint, event_id % 6 >= 2 AS analyzable,
  event_id % 5 = 0 AS availability FROM events WHERE event_id % 9 <> 3""")
def _(t):
    good, _ = normalize.split_rejects(problems_of(t))
    return good.select("external_id", "host", "type", "severity", "title", "started_at", "resolved_at", "fingerprint", "analyzable", "availability")


@query("normalize_security", """
SELECT 'a' || CAST(event_id AS VARCHAR) AS external_id, 'host-' || CAST(user_id % 10 AS VARCHAR) AS host, CASE event_type WHEN 'view' THEN 'auth' WHEN 'click' THEN 'file' ELSE 'other' END AS type,
  CASE WHEN event_id % 16 >= 15 THEN 5 WHEN event_id % 16 >= 12 THEN 4 WHEN event_id % 16 >= 10 THEN 3 WHEN event_id % 16 >= 7 THEN 2 ELSE 1 END AS severity,
  CASE WHEN event_id % 3 = 0 THEN 'Security rule ' || CAST(event_id % 1000 + 5000 AS VARCHAR) ELSE 'login' END AS title, date_trunc('second', ts) AS started_at,
  substr(sha256('security|host-' || CAST(user_id % 10 AS VARCHAR) || '|' || CAST(event_id % 1000 + 5000 AS VARCHAR) || '|10.0.0.' || CAST(user_id % 5 AS VARCHAR)), 1, 16) AS fingerprint,
  event_id % 16 >= 10 OR event_id % 1000 + 5000 IN (5710, 5712, 5716, 5720, 5402, 5901, 5902) AS analyzable FROM events WHERE event_id % 8 <> 5""")
def _(t):
    good, _ = normalize.split_rejects(security_of(t))
    return good.select("external_id", "host", "type", "severity", "title", "started_at", "fingerprint", "analyzable")


@query("keep_fields", """
SELECT 'a' || CAST(event_id AS VARCHAR) AS external_id, 'host-' || CAST(user_id % 10 AS VARCHAR) AS agent, event_id % 16 AS level, '10.0.0.' || CAST(user_id % 5 AS VARCHAR) AS srcip, 'line' AS full_log
FROM events WHERE event_id % 8 <> 5""")
def _(t):
    good, _ = normalize.split_rejects(security_of(t))
    j = lambda p: F.get_json_object("raw", f"$._source.{p}")
    return good.select("external_id", j("agent.name").alias("agent"), j("rule.level").cast("bigint").alias("level"), j("data.srcip").alias("srcip"), j("full_log").alias("full_log"))


@query("split_rejects", """
SELECT CAST(event_id AS VARCHAR) AS origin, CAST(0 AS INTEGER) AS pos, 'not an object' AS reject_reason FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), 1, 'eventid missing or mistyped' FROM events WHERE event_id % 9 = 3""")
def _(t):
    _, rejects = normalize.split_rejects(problems_of(t))
    return rejects.select("origin", "pos", "reject_reason")


@query("first_rejects", """
SELECT 'problem' AS source, '' AS external_id, 'not an object' AS reject_reason, count(*) AS times FROM events
UNION ALL SELECT 'problem', 'true', 'eventid missing or mistyped', count(*) FROM events WHERE event_id % 9 = 3""")
def _(t):
    _, rejects = normalize.split_rejects(problems_of(t))
    return normalize.first_rejects(rejects)


@query("select_alertable", """
SELECT event_id, level, rule_id FROM (SELECT event_id, date_trunc('second', ts) AS ts, CAST(floor(value / 20) AS INTEGER) AS level, CAST(540 + event_id % 20 AS VARCHAR) AS rule_id FROM events) e
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND (level >= 10 OR rule_id IN ('550', '553', '554'))""")
def _(t):
    raw = t._view("SELECT event_id, date_trunc('second', ts) AS ts, CAST(floor(value / 20) AS INT) AS level, CAST(540 + event_id % 20 AS STRING) AS rule_id FROM events")
    cut = [F.lit(f"2024-01-{d} 00:00:00").cast("timestamp") for d in (10, 20)]
    return captures.select_alertable(raw, *cut, Settings()).drop("ts")


@query("select_by_severity", "SELECT event_id, event_id % 6 AS severity FROM events WHERE event_id % 6 >= 1 AND event_type <> 'view'")
def _(t):
    raw = t.events.select("event_id", (F.col("event_id") % 6).alias("severity"), (F.col("event_type") == "view").alias("suppressed"))
    return captures.select_by_severity(raw, t.cfg.fetch_min_severity).drop("suppressed")


@query("attach_trigger", """
SELECT event_id, user_id AS trigger_id, coalesce('trigger of ' || c_name, 'unknown') AS host FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = user_id""")
def _(t):
    problems = t.events.select("event_id", F.col("user_id").alias("trigger_id"))
    triggers = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("trigger_id"), F.concat(F.lit("trigger of "), "c_name").alias("host"))
    return captures.attach_trigger(problems, triggers)


POSITION = "2024-01-15 12:00:00"
STORED = "CAST(seq % 3 AS INTEGER) = 0"


def position():
    return F.lit(POSITION).cast("timestamp")


@query("read_increment", over("alerts", sql=f"""
SELECT source, external_id, started_at FROM alerts WHERE started_at BETWEEN TIMESTAMP '{POSITION}' - INTERVAL 120 SECOND AND {NOW} AND seq % 3 <> 0"""))
def _(t):
    return captures.read_increment(t.alerts, t.alerts.where("seq % 3 = 0"), position(), t.now, t.cfg).select("source", "external_id", "started_at")


@query("next_position", over("alerts", sql=f"""
SELECT greatest(max(CASE WHEN started_at < {NOW} THEN started_at ELSE {NOW} END), TIMESTAMP '{POSITION}') AS position FROM alerts
WHERE started_at BETWEEN TIMESTAMP '{POSITION}' - INTERVAL 120 SECOND AND {NOW}"""))
def _(t):
    return captures.next_position(t.alerts, position(), t.now, t.cfg)


@query("reread_late", over("alerts", sql=f"""
SELECT source, external_id, started_at FROM alerts WHERE started_at BETWEEN TIMESTAMP '{POSITION}' - INTERVAL 86400 SECOND AND TIMESTAMP '{POSITION}' AND seq % 3 <> 0"""))
def _(t):
    return captures.reread_late(t.alerts, t.alerts.where("seq % 3 = 0"), position(), t.now, Settings(overlap=86400)).select("source", "external_id", "started_at")


@query("take_backlog", """
SELECT event_id, "ts", tie FROM (SELECT event_id, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 10 <> 0 THEN lpad(CAST(event_id AS VARCHAR), 9, '0') END AS tie FROM events) e
WHERE tie IS NOT NULL AND (ts > TIMESTAMP '2024-01-15 12:00:00' OR (ts = TIMESTAMP '2024-01-15 12:00:00' AND tie > '000000500')) ORDER BY ts, tie LIMIT 200""")
def _(t):
    rows = t._view("SELECT event_id, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 10 <> 0 THEN lpad(CAST(event_id AS STRING), 9, '0') END AS tie FROM events")
    return captures.take_backlog(rows, position(), F.lit("000000500"), 200)


@query("backlog_rejects", """
SELECT event_id, 'no tie value' AS reject_reason FROM events WHERE event_id % 10 = 0 AND date_trunc('hour', ts) >= TIMESTAMP '2024-01-15 12:00:00'""")
def _(t):
    rows = t._view("SELECT event_id, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 10 <> 0 THEN lpad(CAST(event_id AS STRING), 9, '0') END AS tie FROM events")
    return captures.backlog_rejects(rows, position(), F.lit("000000500")).select("event_id", "reject_reason")


def capture_files(t, made):
    """Captures as files of one array each, some of them no JSON at all: up to 200 arrays are joined into one."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/captures-{uuid.uuid4().hex}"
    inner = F.expr("substr(value, 2, length(value) - 2)")
    files = made.groupBy((F.col("origin").cast("bigint") % 1000003 / 200).cast("int").alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(inner), ","), F.lit("]")).alias("value"))
    files.unionByName(t.spark.createDataFrame([(-1, "no json"), (-2, "{}")], "file int, value string")).repartition("file").write.partitionBy("file").text(path)
    return path


@query("read_problems", ORACLES["normalize_problems"])
def _(t):
    items = captures.read_problems(t.spark, capture_files(t, problem_captures(t)))
    good, _ = normalize.split_rejects(normalize.normalize_problems(items, t.now, t.cfg))
    return good.select("external_id", "host", "type", "severity", "title", "started_at", "resolved_at", "fingerprint", "analyzable", "availability")


@query("read_security_alerts", ORACLES["normalize_security"])
def _(t):
    items = captures.read_security_alerts(t.spark, capture_files(t, security_captures(t)))
    good, _ = normalize.split_rejects(normalize.normalize_security(items, t.cfg))
    return good.select("external_id", "host", "type", "severity", "title", "started_at", "fingerprint", "analyzable")


@query("read_snapshot", over("cases", sql="SELECT *, '2024-01-03' AS generation FROM cases"))
def _(t):
    """Three generations and a torn one; two stay, and the newest is read back."""
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    for day in (1, 2, 3):
        tables.write_snapshot({"cases": t.cases, "polls": t.polls}, path, f"2024-01-0{day}")
    t.cases.write.parquet(f"{path}/gen=2024-01-04/cases")
    snapshots.expire(t.spark, path, 2)
    newest = max(g.stamp for g in snapshots.generations(t.spark, path) if g.committed)
    return snapshots.read_snapshot(t.spark, path)["cases"].withColumn("generation", F.lit(newest))


@query("upsert", """
SELECT c_custkey AS key, CASE WHEN o_orderkey IS NULL THEN c_name ELSE 'order ' || CAST(o_orderkey AS VARCHAR) END AS value FROM customer LEFT JOIN
  (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey
UNION ALL SELECT 1000000000 + o_custkey, 'order ' || CAST(max(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""")
def _(t):
    table = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    new = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1000000000).otherwise(F.col("o_custkey"))
    changes = t.orders.where("o_orderstatus IN ('F', 'P')").select(new.alias("key"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("value"),
                                                                  F.col("o_orderkey").alias("seq"))
    return tables.upsert(table, changes, ["key"], "seq").select("key", "value")


@query("check_tables", over("incidents", "assigned", "cases", sql="""
WITH refs AS (SELECT source, external_id, CASE WHEN seq % 50 = 0 THEN -seq ELSE incident_id END AS incident_id FROM assigned UNION ALL SELECT source, external_id, incident_id FROM assigned WHERE seq % 70 = 0),
inc AS (SELECT id, source, CASE WHEN id % 90 = 0 THEN 'lost' ELSE analysis_state END AS analysis_state, occurrence_count FROM incidents)
SELECT 'unknown analysis_state' AS finding, 'lost x ' || CAST(count(*) AS VARCHAR) AS detail FROM inc WHERE analysis_state = 'lost' HAVING count(*) > 0
UNION ALL SELECT 'duplicate alert', source || '/' || external_id FROM refs GROUP BY source, external_id HAVING count(*) > 1
UNION ALL SELECT 'orphan alert', source || '/' || external_id FROM refs WHERE incident_id NOT IN (SELECT id FROM inc)
UNION ALL SELECT 'orphan case', CAST(id AS VARCHAR) FROM cases WHERE incident_id NOT IN (SELECT id FROM inc)
UNION ALL SELECT 'count differs', CAST(id AS VARCHAR) FROM inc LEFT JOIN (SELECT incident_id, count(*) AS n FROM refs GROUP BY 1) r ON r.incident_id = inc.id
  WHERE analysis_state <> 'skipped' AND occurrence_count <> coalesce(n, 0)"""))
def _(t):
    refs = intake.alert_refs(t.assigned.where("seq % 50 <> 0")).unionByName(intake.alert_refs(t.assigned.where("seq % 50 = 0").withColumn("incident_id", -F.col("seq")))) \
        .unionByName(intake.alert_refs(t.assigned.where("seq % 70 = 0")))
    odd = t.incidents.withColumn("analysis_state", F.when(F.col("id") % 90 == 0, "lost").otherwise(F.col("analysis_state")))
    return tables.check_tables(odd, refs, t.cases)


@query("snapshot_manifest", over("cases", "log", sql="""
SELECT 'cases' AS name, count(*) AS rows FROM cases UNION ALL SELECT 'log', count(*) FROM log"""))
def _(t):
    return tables.manifest_of({"cases": t.cases, "log": t.log}).select("name", "rows")
