"""Queries over the analysis queue."""
from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import queueing
from alertloom.plans import adapters, q_grouping  # noqa: F401  (its oracle blocks)
from alertloom.plans.oracle import add_block, over
from alertloom.plans.registry import query

NOW = f"TIMESTAMP '{adapters.NOW}'"
ORDER = "ORDER BY priority DESC, severity DESC, started_at, id"
add_block("actions", (), "SELECT event_id AS id, user_id AS incident_id, date_trunc('second', ts) AS \"at\", "
          "list_extract(['prioritize', 'skip', 'requeue', 'read', 'feedback', 'case'], CAST(CAST(floor(value) AS BIGINT) % 6 + 1 AS INTEGER)) AS name, "
          "list_extract(['helpful', 'wrong', 'corrected'], CAST(event_id % 3 + 1 AS INTEGER)) AS verdict, 'note ' || event_type AS note FROM events")
add_block("waiting", ("incidents",), f"SELECT *, row_number() OVER ({ORDER}) - 1 AS ahead FROM incidents "
          "WHERE analysis_state IN ('held', 'queued', 'retry_wait')")
add_block("typical", ("analyses",), "SELECT CAST(floor(median(duration_ms) / 1000) AS BIGINT) AS typical_sec FROM "
          "(SELECT duration_ms FROM analyses WHERE status = 'done' AND duration_ms IS NOT NULL ORDER BY id DESC LIMIT 10) x")


def actions_of(t):
    return t._view("SELECT event_id AS id, user_id AS incident_id, date_trunc('second', ts) AS at, "
                   "element_at(array('prioritize', 'skip', 'requeue', 'read', 'feedback', 'case'), CAST(CAST(floor(value) AS BIGINT) % 6 + 1 AS INT)) AS name, "
                   "element_at(array('helpful', 'wrong', 'corrected'), CAST(event_id % 3 + 1 AS INT)) AS verdict, 'note ' || event_type AS note FROM events")


@query("promote_held", over("incidents", sql=f"""
SELECT id, coalesce(analysis_state = 'held' AND held_until <= {NOW}, false) AS promoted,
  CASE WHEN analysis_state = 'held' AND held_until <= {NOW} THEN 'queued' ELSE analysis_state END AS analysis_state FROM incidents"""))
def _(t):
    return queueing.promote_held(t.incidents, t.now).select("id", "promoted", "analysis_state")


@query("skip_stale", over("incidents", sql=f"""
SELECT id, skip_reason, analysis_state FROM (SELECT id, CASE WHEN st THEN 'resolved_too_long' ELSE skip_reason END AS skip_reason,
  CASE WHEN st THEN 'skipped' ELSE analysis_state END AS analysis_state FROM (SELECT *, analysis_state IN ('queued', 'retry_wait')
  AND problem_status = 'resolved' AND resolved_at < {NOW} - INTERVAL 6 HOUR AND queue_reason <> 'manual' AND priority = 0 AS st
  FROM incidents) x) y"""))
def _(t):
    return queueing.skip_stale(t.incidents, t.now, t.cfg).select("id", "skip_reason", "analysis_state")


@query("next_candidates", over("incidents", sql=f"""
SELECT id, priority, severity, started_at FROM incidents WHERE analysis_state = 'queued' OR (analysis_state = 'retry_wait'
  AND next_retry_at <= {NOW}) {ORDER} LIMIT 50"""))
def _(t):
    return queueing.next_candidates(t.incidents, t.now, 50).select("id", "priority", "severity", "started_at")


@query("plan_retries", over("analyses", sql="""
SELECT id, CASE WHEN again THEN 'retry_wait' ELSE 'failed' END AS analysis_state, CASE WHEN again THEN finished_at +
  to_seconds(CASE attempt WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END) END AS next_retry_at FROM (SELECT *,
  error_kind NOT IN ('validation', 'length') AND attempt <= 3 AS again FROM (SELECT id, finished_at, error_kind,
  id % 5 + 1 AS attempt FROM analyses WHERE status = 'failed') a) b"""))
def _(t):
    failures = t.analyses.where("status = 'failed'").select(
        "id", F.col("finished_at").alias("at"), "error_kind", (F.col("id") % 5 + 1).cast("int").alias("attempt"))
    return queueing.plan_retries(failures, t.cfg).select("id", "analysis_state", "next_retry_at")


@query("followups_due", over("incidents", sql=f"""
SELECT id, analyzed_at FROM incidents WHERE analysis_state = 'done' AND problem_status = 'open' AND NOT followup_done
  AND analyzed_at <= {NOW} - INTERVAL 2 HOUR"""))
def _(t):
    return queueing.followups_due(t.incidents, t.now, t.cfg).select("id", "analyzed_at")


@query("attempt_counts", over("log", sql="""
SELECT incident_id, CAST(greatest(0, sum(CASE WHEN type = 'analysis_started' THEN 1 ELSE -1 END)) AS BIGINT) AS attempts
FROM (SELECT *, max(CASE WHEN type IN ('requeued', 'followup_queued') THEN id END) OVER (PARTITION BY incident_id) AS reset FROM log) x
WHERE type IN ('analysis_started', 'released') AND (reset IS NULL OR id > reset) GROUP BY incident_id"""))
def _(t):
    return queueing.attempt_counts(t.log)


@query("apply_actions", over("incidents", "actions", sql="""
WITH f AS (SELECT incident_id, arg_max(name, id) FILTER (name IN ('prioritize', 'skip', 'requeue')) AS move,
  arg_max(note, id) FILTER (name = 'skip') AS note, min("at") FILTER (name = 'read') AS first_read,
  arg_max(verdict, id) FILTER (name = 'feedback') AS feedback, arg_max(verdict, id) FILTER (name = 'case') AS confirmed_verdict,
  max("at") FILTER (name = 'case') AS confirmed_at, max("at") AS touched FROM actions GROUP BY 1)
SELECT id, CASE WHEN w AND move = 'prioritize' OR e AND move = 'requeue' THEN 'queued' WHEN w AND move = 'skip' THEN 'skipped'
    ELSE analysis_state END AS analysis_state, CASE WHEN w AND move = 'prioritize' THEN 1 ELSE priority END AS priority,
  CASE WHEN w AND move = 'skip' THEN 'manual: ' || note WHEN e AND move = 'requeue' THEN NULL ELSE skip_reason END AS skip_reason,
  CASE WHEN e AND move = 'requeue' THEN 'manual' ELSE queue_reason END AS queue_reason,
  CASE WHEN e AND move = 'requeue' THEN 0 ELSE attempt_count END AS attempt_count,
  coalesce(read_at, first_read) AS read_at, feedback, confirmed_verdict, confirmed_at,
  CASE WHEN touched > updated_at THEN touched ELSE updated_at END AS updated_at
FROM (SELECT *, analysis_state IN ('held', 'queued', 'retry_wait') AS w, analysis_state IN ('done', 'failed', 'skipped') AS e
  FROM incidents) i LEFT JOIN f ON f.incident_id = i.id"""))
def _(t):
    return queueing.apply_actions(t.incidents, actions_of(t)).select(
        "id", "analysis_state", "priority", "skip_reason", "queue_reason", "attempt_count", "read_at", "feedback",
        "confirmed_verdict", "confirmed_at", "updated_at")


@query("refused_actions", over("incidents", "actions", sql="""
SELECT a.id AS action_id, a.incident_id, name, analysis_state FROM actions a JOIN incidents i ON i.id = a.incident_id
WHERE CASE name WHEN 'prioritize' THEN analysis_state NOT IN ('held', 'queued', 'retry_wait')
  WHEN 'skip' THEN analysis_state NOT IN ('held', 'queued', 'retry_wait')
  WHEN 'requeue' THEN analysis_state NOT IN ('done', 'failed', 'skipped') WHEN 'read' THEN false
  ELSE analysis_state <> 'done' AND latest_analysis_id IS NULL END"""))
def _(t):
    return queueing.refused_actions(t.incidents, actions_of(t))


@query("invalid_transitions", over("log", sql="""
WITH m AS (SELECT *, CASE """ + " ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in queueing.AFTER.items()) + """ END AS state FROM log),
p AS (SELECT *, lag(state) OVER (PARTITION BY incident_id ORDER BY "at", id) AS was FROM m WHERE state IS NOT NULL)
SELECT id, incident_id, "at", type, was FROM p WHERE was IS NOT NULL AND NOT (""" + " OR ".join(
    f"type = '{k}' AND was IN ({', '.join(repr(s) for s in v)})" for k, v in queueing.ALLOWED.items()) + ")"))
def _(t):
    return queueing.invalid_transitions(t.log)


@query("queue_summary", over("incidents", "log", sql=f"""
WITH e AS (SELECT incident_id, max("at") AS entered FROM log WHERE type IN ('queued', 'requeued', 'followup_queued') GROUP BY 1),
w AS (SELECT CASE WHEN analysis_state = 'queued' THEN coalesce(entered, started_at) WHEN analysis_state = 'retry_wait'
  AND next_retry_at <= {NOW} THEN next_retry_at END AS since FROM incidents i LEFT JOIN e ON e.incident_id = i.id
  WHERE analysis_state IN ('held', 'queued', 'retry_wait')),
o AS (SELECT count(*) AS depth, coalesce(CAST(epoch({NOW}) - epoch(min(since)) AS BIGINT), 0) AS sec FROM w)
SELECT depth, greatest(0, sec) AS oldest_waiting_sec, sec > 600 AS stalled FROM o"""))
def _(t):
    return queueing.queue_summary(t.incidents, t.log, t.now, t.cfg)


@query("wait_positions", over("waiting", "typical", sql=f"""
SELECT id, ahead, {NOW} + to_seconds(typical_sec * (ahead + 1)) AS expected_at FROM waiting, typical"""))
def _(t):
    return queueing.wait_positions(t.incidents, queueing.typical_duration(t.analyses), t.now)


@query("typical_duration", over("typical", sql="SELECT * FROM typical"))
def _(t):
    return queueing.typical_duration(t.analyses)


@query("abandoned_runs", over("analyses", sql="""
SELECT id, incident_id, CASE WHEN status = 'running' THEN 'released' ELSE status END AS status,
  CASE WHEN status = 'running' THEN 'restart' ELSE error_kind END AS error_kind, status = 'running' AS back_to_queue FROM analyses"""))
def _(t):
    return queueing.abandoned_runs(t.analyses)


@query("concurrent_runs", over("analyses", sql="""
SELECT id, started_at, busy_until FROM (SELECT *, max(coalesce(finished_at, TIMESTAMP '2999-01-01 00:00:00')) OVER (
  ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM analyses) x
WHERE busy_until > started_at"""))
def _(t):
    return queueing.concurrent_runs(t.analyses)


@query("run_trigger", over("incidents", sql="""
SELECT id, CASE WHEN queue_reason IN ('followup', 'manual') THEN queue_reason WHEN attempt_count > 1 THEN 'retry' ELSE 'initial' END
  AS trigger FROM incidents"""))
def _(t):
    return queueing.run_trigger(t.incidents)


@query("model_backoff", over("analyses", sql="""
WITH RECURSIVE r AS (SELECT id, model, status, error_kind, row_number() OVER (PARTITION BY model ORDER BY finished_at, id) AS n
  FROM analyses WHERE status IN ('done', 'failed') OR (status = 'released' AND error_kind IN ('unreachable', 'server', 'auth', 'tls',
  'throttled', 'invalid_response'))),
f AS (SELECT id, model, n, status, CASE WHEN status <> 'released' THEN 0 WHEN error_kind = 'auth' THEN 900 ELSE 5 END AS wait
  FROM r WHERE n = 1
 UNION ALL SELECT r.id, r.model, r.n, r.status, CASE WHEN r.status <> 'released' THEN 0 WHEN r.error_kind = 'auth' THEN 900
  WHEN f.wait <= 0 THEN 5 ELSE least(f.wait * 2, 600) END FROM f JOIN r ON r.model = f.model AND r.n = f.n + 1)
SELECT id, model AS lane, CAST(wait AS BIGINT) AS wait_sec FROM f WHERE status = 'released'""").replace("WITH analyses", "WITH RECURSIVE analyses").replace("WITH RECURSIVE r AS", "r AS").replace(",\nRECURSIVE r AS", ",\nr AS"))
def _(t):
    runs = t.analyses.where("status <> 'running'").select("id", F.col("finished_at").alias("at"), F.col("model").alias("lane"),
                                                          "status", "error_kind")
    return queueing.model_backoff(runs, t.cfg)


@query("cycle", over("cand", sql=f"""
WITH dens AS (SELECT s, max(w) AS within FROM (SELECT s, count(*) OVER (ORDER BY s RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING) AS w
  FROM cand) x GROUP BY s),
best AS (SELECT s FROM dens WHERE within >= 5 ORDER BY within DESC, s LIMIT 1),
mem AS (SELECT id, min(id) OVER () AS g FROM cand, best WHERE cand.s BETWEEN best.s AND best.s + 300),
st AS (SELECT i.id, mem.g, CASE WHEN mem.g IS NOT NULL THEN 'grouped' WHEN analysis_state = 'held' AND held_until <= {NOW} THEN 'queued'
  WHEN analysis_state = 'done' AND problem_status = 'open' AND NOT followup_done AND analyzed_at <= {NOW} - INTERVAL 2 HOUR THEN 'queued'
  ELSE analysis_state END AS analysis_state, analysis_state = 'done' AND problem_status = 'open' AND NOT followup_done
  AND analyzed_at <= {NOW} - INTERVAL 2 HOUR AS followup FROM incidents i LEFT JOIN mem ON mem.id = i.id)
SELECT id, analysis_state, coalesce(followup, false) AS followup, 'group-' || CAST(g AS VARCHAR) AS group_key FROM st"""))
def _(t):
    return queueing.cycle(t.incidents, t.now, t.cfg).select("id", "analysis_state", "followup", "group_key")
