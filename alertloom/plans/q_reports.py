"""Queries over the reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import codes
from alertloom.operators import intake, queueing, reports
from alertloom.plans import adapters, q_queue  # noqa: F401  (its oracle blocks)
from alertloom.plans.oracle import add_block, over
from alertloom.plans.q_scalar import DURATION, _case
from alertloom.plans.registry import query

NOW, DAY = f"TIMESTAMP '{adapters.NOW}'", adapters.DAY
BEGIN, END = f"(TIMESTAMP '{DAY} 00:00:00' - INTERVAL 9 HOUR)", f"(TIMESTAMP '{DAY} 00:00:00' + INTERVAL 15 HOUR)"


def today(column: str) -> str:
    return f"({column} >= {BEGIN} AND {column} < {END})"


def clock(column: str) -> str:
    return f"coalesce(strftime({column} + INTERVAL 9 HOUR, '%H:%M'), '—')"


def js(name: str) -> str:
    return f"coalesce(json_extract_string(detail_json, '$.{name}'), '')"


@query("state_counts", over("incidents", sql=f"""
SELECT count(*) FILTER (analysis_state IN ('held', 'queued', 'retry_wait')) AS waiting, count(*) FILTER (analysis_state = 'running') AS running,
  count(*) FILTER (analysis_state = 'done' AND {today('analyzed_at')}) AS done,
  count(*) FILTER (analysis_state = 'done' AND {today('analyzed_at')} AND read_at IS NULL) AS unread,
  count(*) FILTER (analysis_state = 'failed') AS failed, count(*) FILTER (analysis_state = 'skipped' AND {today('updated_at')}) AS skipped FROM incidents"""))
def _(t):
    return reports.state_counts(t.incidents, DAY, t.cfg)


@query("sections", over("incidents", sql=f"""
SELECT section, position, id FROM (SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN analysis_state = 'running' THEN 0 ELSE 1 END,
  CASE WHEN section = 'active' THEN priority END DESC, CASE section WHEN 'active' THEN started_at WHEN 'done' THEN analyzed_at ELSE updated_at END DESC, id DESC) AS position
FROM (SELECT *, CASE WHEN analysis_state IN ('held', 'queued', 'retry_wait', 'running') AND group_id IS NULL THEN 'active'
  WHEN analysis_state = 'done' AND {today('analyzed_at')} THEN 'done' WHEN analysis_state = 'failed' THEN 'failed'
  WHEN analysis_state = 'skipped' AND {today('updated_at')} THEN 'skipped' END AS section FROM incidents) x WHERE section IS NOT NULL) y WHERE position <= 500"""))
def _(t):
    return reports.sections(t.incidents, DAY, t.cfg).select("section", F.col("position").cast("bigint").alias("position"), "id")


@query("incident_rows", over("waiting", "typical", "incidents", sql=f"""
WITH w AS (SELECT id, ahead, {NOW} + to_seconds(typical_sec * (ahead + 1)) AS eta FROM waiting, typical),
a AS (SELECT i.*, w.ahead, w.eta, CAST(epoch({NOW}) - epoch(started_at) AS BIGINT) AS age,
  greatest(0, CAST(epoch(resolved_at) - epoch(started_at) AS BIGINT)) AS heal FROM incidents i LEFT JOIN w USING (id)),
b AS (SELECT *, {DURATION.replace('sec', 'age')} AS age_text, {DURATION.replace('sec', 'heal')} AS heal_text FROM a)
SELECT id, 'I-' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS label,
  CASE WHEN analysis_state IN ('held', 'queued', 'retry_wait') THEN 'wait' WHEN analysis_state = 'running' THEN 'run' WHEN analysis_state = 'failed' THEN 'fail'
    WHEN analysis_state = 'skipped' THEN 'skip' WHEN analysis_state = 'done' THEN 'done' ELSE 'other' END AS state,
  CASE WHEN analysis_state = 'done' THEN urgency END AS urgency, title, host, {clock('started_at')} AS time,
  analysis_state = 'done' AND read_at IS NULL AS unread, CASE WHEN problem_status = 'open' THEN 'open for ' || age_text END AS live,
  CASE WHEN problem_status = 'open' THEN NULL WHEN problem_status = 'resolved' AND resolved_at IS NOT NULL THEN 'recovered after ' || heal_text
    ELSE 'single event' END AS healed,
  CASE analysis_state WHEN 'held' THEN 'collecting more' WHEN 'retry_wait' THEN 'retry at ' || {clock('next_retry_at')}
    WHEN 'queued' THEN CAST(ahead AS VARCHAR) || ' ahead, expected at ' || {clock('eta')}
    WHEN 'failed' THEN {_case('fail_reason', codes.FAIL_LABELS, 'fail_reason')}
    WHEN 'skipped' THEN CASE WHEN skip_reason LIKE 'manual: %' THEN 'Skipped: ' || substr(skip_reason, 9) ELSE {_case('skip_reason', codes.SKIP_LABELS, "'Skipped'")} END END AS why,
  occurrence_count AS count, priority > 0 AS priority FROM b"""))
def _(t):
    typical = queueing.typical_duration(t.analyses)
    return reports.incident_rows(t.incidents, queueing.wait_positions(t.incidents, typical, t.now), typical, t.now, t.cfg)


@query("day_band", over("incidents", sql=f"""
SELECT id, round((epoch(started_at) - epoch({BEGIN})) / 864, 2) AS x, CASE WHEN analysis_state = 'done' AND urgency IS NOT NULL THEN urgency
  WHEN analysis_state IN ('running', 'failed') THEN analysis_state WHEN analysis_state IN ('held', 'queued', 'retry_wait') THEN 'waiting' ELSE 'out' END AS class,
  NOT (analysis_state = 'done' AND urgency IS NOT NULL) AS ring FROM incidents WHERE {today('started_at')} AND group_id IS NULL"""))
def _(t):
    return reports.day_band(t.incidents, DAY, t.cfg)


@query("timeline", over("log", sql=f"""
SELECT id, incident_id, type, strftime("at" + INTERVAL 9 HOUR, '%m/%d') AS day, {clock('"at"')} AS time, {_case('type', codes.EVENT_LABELS, 'type')} AS label,
  CASE WHEN type = 'skipped' THEN {_case(js('reason'), codes.SKIP_LABELS, js('reason'))}
    WHEN type IN ('analysis_failed', 'retry_scheduled', 'released') THEN {_case(js('reason'), codes.FAIL_LABELS, js('reason'))}
    WHEN type = 'feedback' THEN {_case(js('verdict'), codes.FEEDBACK_LABELS, "''")}
    WHEN type = 'case_registered' THEN {_case(js('verdict'), codes.VERDICT_LABELS, "''")}
    WHEN type = 'analysis_done' THEN {_case(js('urgency'), codes.URGENCY_LABELS, "''")}
    WHEN type = 'checks_excluded' THEN {js('count')} || ' checks' WHEN type = 'probed' THEN {js('count')} || ' probes, ' || {js('ok')} || ' succeeded'
    WHEN type = 'probe_run' THEN {js('name')} || ': ' || {_case(js('status'), codes.PROBE_LABELS, js('status'))} ELSE '' END AS note FROM log"""))
def _(t):
    return reports.timeline(t.log, t.cfg)


add_block("shown", ("incidents", "analyses"), """
SELECT i.id, coalesce((SELECT a.id FROM analyses a WHERE a.id = i.latest_analysis_id AND a.incident_id = i.id AND a.status = 'done'),
  (SELECT max(a.id) FROM analyses a WHERE a.incident_id = i.id AND a.status = 'done')) AS analysis_id FROM incidents i""")


@query("shown_analysis", over("shown", sql="SELECT * FROM shown"))
def _(t):
    return reports.shown_analysis(t.incidents, t.analyses)


def _part(name: str, path: str, body: str, extra: str) -> str:
    return f"""SELECT id, '{name}' AS part, pos, {body} AS body, {extra} AS extra FROM (SELECT id, unnest(range(len(json_extract(result_json, '{path}[*]')))) AS pos,
  unnest(json_extract(result_json, '{path}[*]')) AS item FROM analyses WHERE status = 'done') z"""


@query("explode_answer", over("analyses", sql=" UNION ALL ".join([
    _part("cause", "$.probable_causes", "item->>'cause'", _case("(item->>'confidence')", codes.CONFIDENCE_LABELS, "(item->>'confidence')")),
    _part("check", "$.recommended_checks", "item->>'purpose'", "item->>'command'")] + [
        _part(n, p, "item->>'$'", "NULL") for n, p in (("service", "$.impact.services"), ("incident", "$.correlation.incidents"),
                                                     ("change", "$.correlation.changes"), ("unknown", "$.unknowns"))])))
def _(t):
    return reports.explode_answer(t.analyses)


@query("feedback_ratio", over("log", sql=f"""
SELECT *, helpful + wrong + corrected AS total, CAST(CASE WHEN helpful + wrong + corrected > 0 THEN round_even(helpful * 100 / (helpful + wrong + corrected), 0) END AS INTEGER)
  AS helpful_percent FROM (SELECT count(*) FILTER ({js('verdict')} = 'helpful') AS helpful, count(*) FILTER ({js('verdict')} = 'wrong') AS wrong,
  count(*) FILTER ({js('verdict')} = 'corrected') AS corrected FROM log WHERE type = 'feedback' AND "at" >= TIMESTAMP '2024-01-10 00:00:00') x"""))
def _(t):
    return reports.feedback_ratio(t.log, F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query("change_mark", over("incidents", "log", "analyses", sql="""
SELECT (SELECT max(updated_at) FROM incidents) AS incidents_updated, (SELECT count(*) FROM incidents) AS incidents_count,
  (SELECT max(id) FROM log) AS events_id, (SELECT max(id) FROM analyses) AS analyses_id, (SELECT max(finished_at) FROM analyses) AS analyses_finished,
  (SELECT concat_ws('/', count(*) FILTER (status = 'running'), count(*) FILTER (status = 'done'), count(*) FILTER (status = 'failed')) FROM analyses) AS analyses_states"""))
def _(t):
    return reports.change_mark(t.incidents, t.log, t.analyses)


@query("changed_incidents", over("incidents", "log", "analyses", sql="""
SELECT id FROM incidents WHERE updated_at > TIMESTAMP '2024-01-29 00:00:00' UNION SELECT incident_id FROM log WHERE id > 900
UNION SELECT incident_id FROM analyses WHERE id > 1400 OR finished_at > TIMESTAMP '2024-01-29 00:00:00'"""))
def _(t):
    return reports.changed_incidents(t.incidents, t.log, t.analyses, F.lit("2024-01-29 00:00:00").cast("timestamp"), 900, 1400)


@query("running_progress", over("analyses", sql=f"""
SELECT id, incident_id, 'Inference' AS phase, tokens_so_far AS tokens, greatest(0, CAST(epoch({NOW}) - epoch(started_at) AS BIGINT)) AS elapsed_sec,
  CAST(least(100, floor(tokens_so_far * 100 / 1200)) AS INTEGER) AS percent FROM analyses WHERE status = 'running'"""))
def _(t):
    return reports.running_progress(t.analyses, t.now, t.cfg)


@query("host_history", over("incidents", sql=f"""
WITH recent AS (SELECT id, host, started_at FROM incidents WHERE started_at >= {NOW} - INTERVAL 7 DAY)
SELECT id, pos, other_id FROM (SELECT i.id, o.id AS other_id, row_number() OVER (PARTITION BY i.id ORDER BY o.started_at DESC, o.id) - 1 AS pos
FROM incidents i JOIN recent o ON (o.host = i.host OR o.host = '{adapters.ROOT}') AND o.id <> i.id) x WHERE pos < 10"""))
def _(t):
    return reports.host_history(t.incidents, t.now, t.cfg)


@query("fingerprint_stats", over("incidents", sql=f"""
WITH pool AS (SELECT *, CAST(epoch(resolved_at) - epoch(started_at) AS BIGINT) AS rec FROM incidents WHERE started_at >= {NOW} - INTERVAL 30 DAY),
f AS (SELECT i.id, count(p.id) AS n, count(p.rec) AS r, CAST(floor(median(p.rec)) AS BIGINT) AS med,
  count(*) FILTER (p.urgency = 'ignore') AS u1, count(*) FILTER (p.urgency = 'now') AS u2, count(*) FILTER (p.urgency = 'today') AS u3,
  count(*) FILTER (p.urgency = 'watch') AS u4 FROM incidents i LEFT JOIN pool p ON p.fingerprint = i.fingerprint AND p.id <> i.id GROUP BY i.id),
h AS (SELECT i.id, count(p.id) AS h FROM incidents i LEFT JOIN pool p ON p.host = i.host AND p.type = i.type AND p.id <> i.id GROUP BY i.id)
SELECT f.id, n AS same_fingerprint, h AS same_host_type, r AS recovered, med AS median_recover_sec,
  concat_ws(', ', CASE WHEN u1 > 0 THEN 'ignore ' || u1 END, CASE WHEN u2 > 0 THEN 'now ' || u2 END, CASE WHEN u3 > 0 THEN 'today ' || u3 END,
    CASE WHEN u4 > 0 THEN 'watch ' || u4 END) AS urgencies FROM f JOIN h USING (id)"""))
def _(t):
    return reports.fingerprint_stats(t.incidents, t.now, t.cfg)


@query("group_members", over("incidents", sql="""
SELECT group_id, id, host, started_at, nth, greatest(0, total - 3) AS more FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY started_at, id) AS nth,
  count(*) OVER (PARTITION BY group_id) AS total FROM incidents WHERE group_id IS NOT NULL) x WHERE nth <= 3"""))
def _(t):
    return reports.group_members(t.incidents, 3)


@query("incident_list", over("incidents", sql="""
SELECT id, 'I-' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS label, source, host, type, severity,
  problem_status, analysis_state, occurrence_count, title FROM incidents"""))
def _(t):
    return reports.incident_list(t.incidents)


@query("run_metrics", over("analyses", sql="""
SELECT model, trigger, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed, round(avg(duration_ms), 2) AS avg_duration_ms,
  max(duration_ms) AS max_duration_ms, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  round(avg(coalesce(tokens_per_sec, tokens_so_far / (duration_ms / 1000))), 4) AS tokens_per_sec, count(error_kind) AS errors,
  count(DISTINCT knowledge_version) AS versions FROM analyses WHERE status <> 'running' GROUP BY ROLLUP (model, trigger)"""))
def _(t):
    return reports.run_metrics(t.analyses)


@query("version_metrics", over("analyses", sql="""
SELECT knowledge_version, error_kind, count(*) AS runs, round(avg(duration_ms), 2) AS avg_duration_ms, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
  max(attempt) AS attempts FROM (SELECT * REPLACE (coalesce(error_kind, 'none') AS error_kind) FROM analyses WHERE status <> 'running') a
GROUP BY ROLLUP (knowledge_version, error_kind)"""))
def _(t):
    return reports.version_metrics(t.analyses)


@query("failed_outputs", over("analyses", sql="""
SELECT id, CASE WHEN result_json LIKE '{%' THEN json_extract_string(result_json, '$.failed_output') END AS output FROM analyses WHERE status = 'failed'"""))
def _(t):
    return reports.failed_outputs(t.analyses)


@query("incident_detail", over("incidents", "assigned", "log", "analyses", "probes", "cases", "shown", sql="""
SELECT i.id AS incident_id, i.title, i.host, i.analysis_state, i.group_id, (SELECT count(*) FROM assigned a WHERE a.incident_id = i.id) AS alerts_total,
  (SELECT count(*) FROM log a WHERE a.incident_id = i.id) AS events_total, (SELECT count(*) FROM analyses a WHERE a.incident_id = i.id) AS runs_total,
  (SELECT count(*) FROM probes a WHERE a.incident_id = i.id) AS probes_total,
  (SELECT string_agg(id, ',' ORDER BY id DESC) FROM (SELECT id FROM log a WHERE a.incident_id = i.id ORDER BY id DESC LIMIT 100) q) AS event_ids,
  (SELECT arg_max(json_extract_string(detail_json, '$.verdict'), id) FROM log a WHERE a.incident_id = i.id AND type = 'feedback') AS feedback,
  (SELECT arg_max(cause, id) FROM cases a WHERE a.incident_id = i.id) AS case_cause, s.analysis_id AS shown_analysis_id
FROM incidents i JOIN shown s ON s.id = i.id"""))
def _(t):
    d = reports.incident_detail(t.incidents, intake.alert_refs(t.assigned), t.log, t.analyses, t.probes, t.cases)
    return d.select("incident_id", "title", "host", "analysis_state", "group_id", "alerts_total", "events_total", "runs_total",
                    "probes_total", F.array_join(F.transform("events", lambda e: e["id"].cast("string")), ",").alias("event_ids"),
                    "feedback", "case_cause", "shown_analysis_id")
