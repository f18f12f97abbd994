"""Queries over cases, retention and probes."""
from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import cases, intake, probes, retention
from alertloom.plans import adapters, q_grouping, q_queue, q_reports  # noqa: F401  (their oracle blocks)
from alertloom.plans.oracle import add_block, over
from alertloom.plans.registry import query

NOW = f"TIMESTAMP '{adapters.NOW}'"
LATER = "2024-08-15 00:00:00"
CARD = """'Host: ' || host || chr(10) || 'Type: ' || type || chr(10) || 'Date: ' || CAST(occurred_on AS VARCHAR) || chr(10) || 'Symptoms: ' || symptoms || chr(10) ||
  'Confirmed cause: ' || cause || chr(10) || 'How it was confirmed: ' || CASE WHEN confirmation = '' THEN 'no record' ELSE confirmation END || chr(10) ||
  'Action or decision: ' || CASE WHEN action = '' THEN 'no record' ELSE action END || chr(10) || 'Time to recover: ' ||
  coalesce(CAST(time_to_recover_sec // 60 AS VARCHAR) || ' min', 'no record')"""

add_block("drafts", ("shown", "analyses"), """
SELECT i.id AS incident_id, i.fingerprint, i.host, i.type, i.title, i.started_at, i.resolved_at,
  coalesce(json_extract_string(a.result_json, '$.summary'), i.title) AS symptoms, coalesce(json_extract_string(a.result_json, '$.probable_causes[0].cause'), '') AS cause,
  coalesce(json_extract_string(a.result_json, '$.recommended_checks[0].purpose') || ', ' || json_extract_string(a.result_json, '$.recommended_checks[1].purpose'), '') AS confirmation
FROM incidents i JOIN shown s USING (id) LEFT JOIN analyses a ON a.id = s.analysis_id""")


@query("draft_cases", over("drafts", sql="SELECT incident_id, symptoms, cause, confirmation FROM drafts"))
def _(t):
    return cases.draft_cases(t.incidents, t.analyses).select("incident_id", "symptoms", "cause", "confirmation")


def verdicts_of(t):
    return t._view("SELECT user_id AS incident_id, event_id AS id, ts AS at, CASE event_type WHEN 'view' THEN 'corrected' WHEN 'click' THEN 'odd' ELSE 'correct' END AS verdict, "
                   "CASE WHEN value < 20 THEN '' ELSE 'note   ' || CAST(event_id AS STRING) END AS note, '' AS symptoms, "
                   "CASE WHEN value > 100 THEN 'own cause' ELSE '' END AS cause, '' AS confirmation, 'waited' AS action FROM events WHERE value < 30 OR value > 90")


@query("confirm_cases", over("drafts", sql="""
WITH v AS (SELECT incident_id, max(id) AS id FROM (SELECT user_id AS incident_id, event_id AS id FROM events WHERE value < 30 OR value > 90) x GROUP BY 1),
w AS (SELECT v.incident_id, CASE event_type WHEN 'view' THEN 'corrected' WHEN 'click' THEN 'odd' ELSE 'correct' END AS verdict,
  CASE WHEN value < 20 THEN '' ELSE 'note ' || CAST(event_id AS VARCHAR) END AS note, CASE WHEN value > 100 THEN 'own cause' ELSE '' END AS own FROM v JOIN events e ON e.event_id = v.id),
c AS (SELECT d.incident_id, d.symptoms, d.confirmation, 'waited' AS action, w.verdict, CASE WHEN own <> '' THEN own ELSE d.cause END AS c0, note,
  CASE WHEN d.resolved_at IS NOT NULL THEN greatest(0, CAST(epoch(d.resolved_at) - epoch(d.started_at) AS BIGINT)) END AS time_to_recover_sec, CAST(d.started_at AS DATE) AS occurred_on
  FROM drafts d JOIN w USING (incident_id)),
k AS (SELECT *, CASE WHEN verdict = 'correct' THEN CASE WHEN c0 <> '' THEN c0 ELSE note END ELSE CASE WHEN note <> '' THEN note ELSE c0 END END AS cause FROM c)
SELECT incident_id, symptoms, cause, confirmation, action, verdict, time_to_recover_sec, occurred_on,
  CASE WHEN verdict = 'odd' THEN 'unknown verdict' WHEN cause = '' THEN 'cause missing' END AS reject_reason FROM k"""))
def _(t):
    return cases.confirm_cases(cases.draft_cases(t.incidents, t.analyses), verdicts_of(t), t.now).select(
        "incident_id", "symptoms", "cause", "confirmation", "action", "verdict", "time_to_recover_sec", "occurred_on", "reject_reason")


@query("fit_card")
def _(t):
    n = F.col("id") % 3
    cards = t.cases.withColumns({"action": F.repeat(F.lit("restart 123, "), (n * 10).cast("int")), "confirmation": F.repeat("title", 6),
                                 "symptoms": F.repeat(F.lit("slow 99% "), (n * 9).cast("int"))})
    return cases.fit_card(cards).select("id", "action", "confirmation", "symptoms", "cause", "tokens")


@query("similar_cases", over("rolled", "cases", sql="""
SELECT id, pos, case_id, near FROM (SELECT i.id, c.id AS case_id, CASE WHEN c.fingerprint = i.fingerprint THEN 0 WHEN c.host = i.host THEN 1 ELSE 2 END AS near,
  row_number() OVER (PARTITION BY i.id ORDER BY CASE WHEN c.fingerprint = i.fingerprint THEN 0 WHEN c.host = i.host THEN 1 ELSE 2 END,
    CASE c.status WHEN 'approved' THEN 0 ELSE 1 END, approved_at DESC, c.id DESC) - 1 AS pos FROM rolled i JOIN cases c ON c.type = i.type AND c.incident_id <> i.id) x WHERE pos < 3"""))
def _(t):
    return cases.similar_cases(t.rolled, t.cases)


@query("mark_stale", over("cases", sql="""
SELECT id, CASE WHEN status = 'approved' AND host IN ('host-1', 'host-2') THEN 'stale' ELSE status END AS status,
  CASE WHEN status = 'approved' AND host IN ('host-1', 'host-2') THEN 'moved to new rack' END AS stale_reason FROM cases"""))
def _(t):
    return cases.mark_stale(t.cases, "moved  to new rack", ["host-1", "host-2"]).select("id", "status", "stale_reason")


@query("render_cases", over("cases", sql=f"SELECT id, incident_id, status, {CARD} AS text FROM cases"))
def _(t):
    return cases.render_cases(t.cases)


@query("export_cases_markdown", over("cases", sql=f"""
SELECT id, '## Case ' || CAST(id AS VARCHAR) || ' (I-' || CASE WHEN incident_id < 1000 THEN lpad(CAST(incident_id AS VARCHAR), 4, '0') ELSE CAST(incident_id AS VARCHAR) END ||
  ', ' || status || ')' || chr(10) || chr(10) || {CARD} || chr(10) AS block FROM cases"""))
def _(t):
    return cases.cases_markdown(t.cases)


# ---- retention: incidents and group rows in one table, looked at half a year later -------------------------------

ENDED = "('done', 'failed', 'skipped', 'grouped')"
add_block("held_rows", ("incidents", "groups"), f"""
SELECT id, source, group_id, analysis_state, problem_status, resolved_at, last_occurrence_at, updated_at, raw_json FROM incidents
UNION ALL SELECT group_id, 'group', NULL, 'done', problem_status, resolved_at, last_occurrence_at, last_occurrence_at, '[]' FROM groups""")
add_block("judged", ("held_rows", "cases"), f"""
SELECT *, problem_status <> 'open' AND analysis_state IN {ENDED} AND NOT has_case AND aged AS expired FROM (SELECT *, id IN (SELECT incident_id FROM cases) AS has_case,
  coalesce(analysis_state = 'skipped' AND updated_at < TIMESTAMP '{LATER}' - INTERVAL 14 DAY OR coalesce(resolved_at, last_occurrence_at) < TIMESTAMP '{LATER}' - INTERVAL 200 DAY, false) AS aged
  FROM held_rows) x""")
add_block("old_groups", ("judged",), "SELECT id FROM judged g WHERE source = 'group' AND expired AND NOT EXISTS "
          "(SELECT 1 FROM judged m WHERE m.group_id = g.id AND NOT m.expired)")
add_block("gone", ("judged", "old_groups"), "SELECT id FROM judged WHERE expired AND group_id IS NULL AND source <> 'group' UNION SELECT id FROM old_groups "
          "UNION SELECT id FROM judged WHERE group_id IN (SELECT id FROM old_groups)")


def held_rows(t):
    from alertloom.operators.grouping import group_rollup
    cols = ["id", "source", "group_id", "analysis_state", "problem_status", "resolved_at", "last_occurrence_at", "updated_at", "raw_json"]
    groups = group_rollup(t.incidents, t.now).select(
        F.col("group_id").alias("id"), F.lit("group").alias("source"), F.lit(None).cast("bigint").alias("group_id"), F.lit("done").alias("analysis_state"),
        "problem_status", "resolved_at", "last_occurrence_at", F.col("last_occurrence_at").alias("updated_at"), F.lit("[]").alias("raw_json"))
    return t.incidents.select(*cols).unionByName(groups)


def keep_cfg():
    from alertloom.settings import Settings
    return Settings(retention_incident_days=200, root_host=adapters.ROOT)


def later():
    return F.lit(LATER).cast("timestamp")


@query("expired_incidents", over("judged", sql="SELECT id FROM judged WHERE expired AND group_id IS NULL AND source <> 'group'"))
def _(t):
    return retention.expired_incidents(held_rows(t), t.cases, later(), keep_cfg())


@query("expired_groups", over("old_groups", sql="SELECT id FROM old_groups UNION ALL SELECT id FROM judged WHERE group_id IN (SELECT id FROM old_groups)"))
def _(t):
    return retention.expired_groups(held_rows(t), t.cases, later(), keep_cfg())


@query("cascade_delete", over("gone", "log", "analyses", "probes", sql="""
SELECT 'incidents' AS name, count(*) AS kept FROM held_rows WHERE id NOT IN (SELECT id FROM gone) UNION ALL
SELECT 'log', count(*) FROM log WHERE incident_id NOT IN (SELECT id FROM gone) UNION ALL
SELECT 'analyses', count(*) FROM analyses WHERE incident_id NOT IN (SELECT id FROM gone) UNION ALL
SELECT 'probes', count(*) FROM probes WHERE incident_id NOT IN (SELECT id FROM gone)"""))
def _(t):
    rows = held_rows(t)
    ids = retention.retention_marks(rows, t.cases, later(), keep_cfg()).where("gone").select("id").persist()  # read four times
    out = None
    for name, df in retention.cascade_delete({"incidents": rows, "log": t.log, "analyses": t.analyses, "probes": t.probes}, ids).items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("kept"))
        out = part if out is None else out.unionByName(part)
    return out


@query("clear_payloads", over("held_rows", sql=f"""
SELECT id, cleared, CASE WHEN cleared THEN '{{}}' ELSE raw_json END AS raw_json FROM (SELECT *, coalesce(raw_json <> '{{}}' AND source <> 'group' AND problem_status <> 'open'
  AND analysis_state IN {ENDED} AND coalesce(resolved_at, last_occurrence_at) < TIMESTAMP '2024-04-19 00:00:00' - INTERVAL 90 DAY, false) AS cleared FROM held_rows) x"""))
def _(t):
    return retention.clear_payloads(held_rows(t), F.lit("2024-04-19 00:00:00").cast("timestamp"), t.cfg).select("id", "cleared", "raw_json")


@query("clear_contexts", over("analyses", sql="""
SELECT id, context_json IS NOT NULL AND started_at < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 90 DAY AS cleared,
  CASE WHEN started_at >= TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 90 DAY THEN context_json END AS context_json FROM analyses"""))
def _(t):
    return retention.clear_contexts(t.analyses, F.lit("2000-01-01 00:00:00").cast("timestamp"), t.cfg).select("id", "cleared", "context_json")


@query("retention_report", over("gone", "log", "analyses", "assigned", sql=f"""
SELECT 'incidents_deleted' AS what, count(*) AS rows FROM gone UNION ALL SELECT 'events_deleted', count(*) FROM log WHERE incident_id IN (SELECT id FROM gone)
UNION ALL SELECT 'alert_refs_deleted', count(*) FROM assigned WHERE incident_id IN (SELECT id FROM gone)
UNION ALL SELECT 'analyses_deleted', count(*) FROM analyses WHERE incident_id IN (SELECT id FROM gone)
UNION ALL SELECT 'payloads_cleared', count(*) FROM held_rows WHERE id NOT IN (SELECT id FROM gone) AND raw_json <> '{{}}' AND source <> 'group' AND problem_status <> 'open'
  AND analysis_state IN {ENDED} AND coalesce(resolved_at, last_occurrence_at) < TIMESTAMP '{LATER}' - INTERVAL 90 DAY
UNION ALL SELECT 'contexts_cleared', count(*) FROM analyses WHERE incident_id NOT IN (SELECT id FROM gone) AND context_json IS NOT NULL AND started_at < TIMESTAMP '{LATER}' - INTERVAL 90 DAY
UNION ALL SELECT 'kept_for_cases', count(*) FROM judged WHERE problem_status <> 'open' AND aged AND has_case"""))
def _(t):
    return retention.retention_report(held_rows(t), intake.alert_refs(t.assigned), t.log, t.analyses, t.cases, later(), keep_cfg())


# ---- probes ------------------------------------------------------------------------------------------------------

add_block("catalog", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{n}', '{w}', '{r}', '{when}', {'NULL' if c is None else chr(39) + c.replace(chr(39), chr(39) * 2) + chr(39)})"
    for i, (n, w, r, when, c) in enumerate(probes.CATALOG)) + ") c(ord, name, place, roles, conditions, command)")
add_block("probe_hosts", (), "SELECT 'host-' || CAST(s_nationkey % 10 AS VARCHAR) AS host, max('/opt/' || CAST(s_nationkey % 10 AS VARCHAR) || '.yml') AS compose, "
          "max('table_' || CAST(s_nationkey % 10 AS VARCHAR)) AS guard_table, max(CASE WHEN s_nationkey % 2 = 0 THEN 'docker' ELSE 'frr' END) AS role "
          "FROM supplier WHERE s_nationkey % 10 < 7 GROUP BY 1")
add_block("plan", ("rolled", "catalog", "probe_hosts"), """
SELECT i.id, c.ord, c.name, c.place, i.host FROM rolled i JOIN catalog c ON (list_contains(string_split(conditions, ','), 'always') OR
  list_contains(string_split(conditions, ','), 'type:' || i.type) OR list_contains(string_split(conditions, ','), 'source:' || i.source))
LEFT JOIN probe_hosts h ON h.host = i.host WHERE place <> 'host' OR (h.host IS NOT NULL AND (roles = '' OR roles = h.role))""")


def hosts_of(t):
    n = F.col("s_nationkey") % 10
    return t.supplier.where(n < 7).select(F.concat(F.lit("host-"), n.cast("string")).alias("host"), F.concat(F.lit("/opt/"), n.cast("string"), F.lit(".yml")).alias("compose"),
                                          F.concat(F.lit("table_"), n.cast("string")).alias("guard_table"),
                                          F.array(F.when(n % 2 == 0, "docker").otherwise("frr")).alias("roles")).dropDuplicates(["host"])


def plan_of(t):
    return probes.plan_probes(t.rolled, probes.catalog_frame(t.spark), hosts_of(t))


@query("plan_probes", over("plan", sql="SELECT * FROM plan"))
def _(t):
    return plan_of(t)


@query("probe_commands", over("plan", sql="""
SELECT p.id, p.ord, p.name, p.host, replace(replace(command, '{compose}', coalesce(compose, '')), '{guard_table}', guard_table) AS command
FROM plan p JOIN catalog c USING (name) LEFT JOIN probe_hosts h ON h.host = p.host"""))
def _(t):
    return probes.probe_commands(plan_of(t), probes.catalog_frame(t.spark), hosts_of(t))


@query("thin_series", """
SELECT series, "at", tie, value, total FROM (SELECT event_type AS series, ts AS "at", event_id AS tie, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n,
  count(*) OVER (PARTITION BY event_type) AS total FROM events) x WHERE total <= 30 OR n IN (SELECT i * total // 30 FROM range(30) r(i))""")
def _(t):
    return probes.thin_series(t.events.select(F.col("event_type").alias("series"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), "value"))


@query("recent_events", """
SELECT host, seq, started_at, level, nth FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY started_at DESC, seq DESC) AS nth FROM (
  SELECT 'host-' || CAST(user_id % 10 AS VARCHAR) AS host, event_id AS seq, date_trunc('second', ts) AS started_at, CAST(floor(value / 10) AS INTEGER) AS level FROM events) a
  WHERE started_at BETWEEN TIMESTAMP '2024-01-20 22:00:00' AND TIMESTAMP '2024-01-21 00:00:00' AND level >= 5) b WHERE nth <= 20""")
def _(t):
    alerts = t._view("SELECT 'host-' || CAST(user_id % 10 AS STRING) AS host, event_id AS seq, date_trunc('second', ts) AS started_at, CAST(floor(value / 10) AS INT) AS level FROM events")
    return probes.recent_events(alerts, alerts, F.lit("2024-01-21 00:00:00").cast("timestamp"))


@query("open_problems", over("alerts", sql="""
SELECT host, seq, severity, started_at, nth FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS nth FROM alerts
  WHERE source = 'problem' AND resolved_at IS NULL) x WHERE nth <= 20"""))
def _(t):
    return probes.open_problems(t.alerts)


@query("probe_status", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'refused' WHEN 2 THEN 'timeout' WHEN 3 THEN 'failed' WHEN 4 THEN
  CASE WHEN event_type = 'error' THEN 'refused' ELSE 'unreachable' END WHEN 5 THEN 'failed' ELSE 'timeout' END AS status FROM events""")
def _(t):
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 2, 3, 4, 255, 1, None)]), (F.col("event_id") % 7 + 1).cast("int"))
    err = F.when(F.col("event_type") == "error", "Permission denied (publickey).").otherwise("connection timed out")
    return t.events.select("event_id", probes.probe_status(code, err).alias("status"))


@query("probe_rollup", over("probes", sql="""
SELECT analysis_id, count(*) AS probes, count(*) FILTER (status = 'ok') AS ok, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (status <> 'ok'), '') AS failed
FROM probes WHERE analysis_id IS NOT NULL GROUP BY analysis_id"""))
def _(t):
    return probes.probe_rollup(t.probes)


@query("attach_operator_results", over("probes", sql="""
SELECT p.id, p.incident_id, (SELECT arg_min(r.event_id, (r.ts, r.event_id)) FROM events r WHERE r.event_type = 'purchase' AND r.user_id = p.incident_id AND date_trunc('second', r.ts) >= p.started_at) AS analysis_id
FROM probes p WHERE trigger = 'operator' AND analysis_id IS NULL"""))
def _(t):
    runs = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("incident_id"), F.date_trunc("second", "ts").alias("started_at"))
    return probes.attach_operator_results(t.probes, runs)


@query("suppress_repeats", """
WITH RECURSIVE r AS (SELECT event_id AS id, user_id % 10 AS incident_id, event_type AS name, date_trunc('second', ts) AS "at", row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT id, incident_id, name, "at", n, true AS accepted, "at" AS last_ok FROM r WHERE n = 1
  UNION ALL SELECT r.id, r.incident_id, r.name, r."at", r.n, r."at" - f.last_ok >= INTERVAL 3600 SECOND, CASE WHEN r."at" - f.last_ok >= INTERVAL 3600 SECOND THEN r."at" ELSE f.last_ok END
  FROM f JOIN r ON r.incident_id = f.incident_id AND r.name = f.name AND r.n = f.n + 1)
SELECT id, incident_id, name, "at", accepted FROM f""")
def _(t):
    return probes.suppress_repeats(t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("incident_id"), F.col("event_type").alias("name"),
                                                   F.date_trunc("second", "ts").alias("at")), 3600)


@query("checks_to_probes", over("plan", sql="""
WITH cmd AS (SELECT h.host, ord, name, regexp_replace(replace(replace(command, '{compose}', compose), '{guard_table}', guard_table), '^(sudo |-n )+', '') AS fixed FROM catalog, probe_hosts h WHERE command IS NOT NULL),
chk AS (SELECT event_id AS check_id, 'host-' || CAST(user_id % 10 AS VARCHAR) AS host, list_extract(['df -h / /var/lib/docker /home', 'uptime -p', 'free -m | head', 'uptimes', 'ss -ltnup'], CAST(event_id % 5 + 1 AS INTEGER)) AS command FROM events)
SELECT check_id, arg_min(name, ord) AS probe FROM chk JOIN cmd USING (host) WHERE starts_with(command || ' ', fixed || ' ') GROUP BY check_id"""))
def _(t):
    texts = ("sudo df  -h / /var/lib/docker /home", "uptime -p", "sudo -n free -m | head", "uptimes", "ss -ltnup")
    checks = t.events.select(F.col("event_id").alias("check_id"), F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")).alias("host"),
                             F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("event_id") % 5 + 1).cast("int")).alias("command"))
    every = hosts_of(t).select("host", F.lit(0).alias("id")).join(F.broadcast(probes.catalog_frame(t.spark).where("command IS NOT NULL")))
    filled = probes.probe_commands(every.select("id", "ord", "name", "host"), probes.catalog_frame(t.spark), hosts_of(t))
    return probes.checks_to_probes(checks, filled.select("host", "ord", "name", "command"))


@query("latest_results", over("probes", sql="""
SELECT id, incident_id, name, status, nth FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY id DESC) AS nth FROM probes) x WHERE nth <= 5"""))
def _(t):
    return probes.latest_results(t.probes, 5).select("id", "incident_id", "name", "status", "nth")
