"""Views of the driver's tables as alerts, incidents, runs, polls and texts.

Each function gives one SELECT over the tables named in it. The same text runs in Spark and, with the other dialect,
inside an oracle, so both sides start from equal rows. Nothing here is an operator.
"""
from __future__ import annotations

NOW = "2024-01-31 00:00:00"
DAY = "2024-01-20"
ROOT = "host-0"


def arrivals(d) -> str:
    """Security and problem alerts in arrival order, one in 50 delivered a second time under its old number."""
    return f"""
SELECT event_id AS seq,
  CASE WHEN event_type IN ('error', 'signup') THEN 'problem' ELSE 'security' END AS source,
  CAST(CASE WHEN event_id % 50 = 49 THEN event_id - 10 ELSE event_id END AS STRING) AS external_id,
  'host-' || CAST(user_id % 10 AS STRING) AS host,
  CASE event_type WHEN 'error' THEN 'service' WHEN 'signup' THEN 'user' WHEN 'click' THEN 'net'
    WHEN 'view' THEN 'file' ELSE 'auth' END AS type,
  CAST(least(5, 1 + floor(value / 40)) AS INT) AS severity,
  {d.second('ts')} AS started_at,
  CASE WHEN event_type IN ('error', 'signup') AND event_id % 97 <> 0
    THEN {d.add(d.second('ts'), 'floor(value * 10)')} END AS resolved_at,
  event_type = 'error' AND value >= 150 AS availability,
  props AS raw, user_id, value
FROM events"""


def alerts_of(d, base: str) -> str:
    """Arrivals with the derived columns of a normalised alert."""
    return f"""
SELECT seq, source, external_id, substr({d.sha("source || '|' || host || '|' || type")}, 1, 16) AS fingerprint, host,
  type, severity, source || ' level ' || CAST(severity AS STRING) AS source_severity, type || ' on ' || host AS title,
  started_at, resolved_at, availability, severity >= 2 AS analyzable, raw
FROM {base}"""


def state_of(d, base: str) -> str:
    """Rolled-up incidents with the columns the queue, the model runs and the operators would have set."""
    state = d.pick("id", "held", "queued", "retry_wait", "running", "done", "done", "failed", "skipped")
    return f"""
SELECT {d.without('problem_status', 'resolved_at')}, CASE WHEN reopened THEN 'open' ELSE problem_status END AS problem_status,
  CASE WHEN NOT reopened THEN resolved_at END AS resolved_at,
  CASE WHEN state0 = 'done' THEN {d.pick('id', 'now', 'today', 'watch', 'ignore', 'watch')} END AS urgency,
  CASE WHEN state0 = 'done' THEN {d.pick('id', 'availability', 'performance', 'security', 'configuration', 'noise')} END AS kind,
  CASE WHEN state0 = 'done' THEN 'summary ' || CAST(id AS STRING) END AS summary,
  CASE WHEN id % 16 = 8 THEN 'grouped' ELSE state0 END AS analysis_state,
  CASE WHEN id % 16 = 8 THEN 1000000000 + CAST(floor({d.epoch('started_at')} / 21600) AS BIGINT) END AS group_id,
  CAST(CASE WHEN state0 IN ('held', 'queued', 'retry_wait') AND id % 23 = 0 THEN 1 ELSE 0 END AS INT) AS priority,
  CASE WHEN state0 = 'held' THEN {d.add('started_at', "CASE WHEN source = 'security' THEN 120 ELSE 60 END + (id % 9) * 100000")} END AS held_until,
  CASE WHEN state0 = 'retry_wait' THEN {d.add('last_occurrence_at', '(id % 7) * 90000')} END AS next_retry_at,
  CAST(id % 4 AS INT) AS attempt_count,
  {d.pick('id', 'initial', 'manual', 'followup', 'initial', 'initial', 'initial', 'initial')} AS queue_reason,
  CASE WHEN state0 = 'done' THEN {d.add('last_occurrence_at', 'id % 20000')} END AS analyzed_at,
  id % 3 = 0 AS followup_done,
  CASE WHEN state0 = 'skipped' THEN CASE WHEN severity < 2 THEN 'below_threshold' ELSE 'manual: seen before' END END AS skip_reason,
  CASE WHEN state0 = 'failed' THEN {d.pick('id', 'timeout', 'validation', 'length', 'internal', 'odd reason')} END AS fail_reason,
  CASE WHEN state0 = 'done' AND id % 2 = 0 THEN id END AS latest_analysis_id,
  CASE WHEN state0 = 'done' AND id % 3 = 0 THEN {d.add('last_occurrence_at', 'id % 20000 + 3600')} END AS read_at,
  {d.add('last_occurrence_at', 'id % 20000')} AS updated_at,
  raw AS raw_json
FROM (SELECT *, CASE WHEN severity < 2 THEN 'skipped' ELSE {state} END AS state0,
  source = 'problem' AND id % 5 = 2 AS reopened FROM {base}) b"""


def events_log(d) -> str:
    """Lifecycle log: one entry per event of a user, the user number standing for the incident."""
    kinds = ("detected", "queued", "analysis_started", "analysis_done", "analysis_failed", "retry_scheduled", "released",
             "requeued", "followup_queued", "skipped", "feedback", "case_registered", "checks_excluded", "probed",
             "probe_run", "prioritized")
    return f"""
SELECT event_id AS id, user_id AS incident_id, {d.second('ts')} AS at,
  {d.pick('CAST(floor(value) AS BIGINT) + event_id', *kinds)} AS type,
  '{{"reason":"' || {d.pick('event_id', 'timeout', 'manual', 'below_threshold', 'restart', 'odd')} ||
  '","verdict":"' || {d.pick('event_id', 'helpful', 'wrong', 'corrected', 'correct')} ||
  '","urgency":"' || {d.pick('event_id', 'now', 'today', 'watch')} || '","name":"disk","status":"' ||
  {d.pick('event_id', 'ok', 'timeout', 'failed')} || '","count":' || CAST(event_id % 5 AS STRING) || ',"ok":' ||
  CAST(event_id % 3 AS STRING) || '}}' AS detail_json
FROM events"""


def analyses(d) -> str:
    """Model runs: one per order, the customer number standing for the incident."""
    answer = f"""'{{"summary":"run ' || CAST(o_orderkey AS STRING) || '","classification":{{"kind":"' ||
  {d.pick('o_orderkey', 'availability', 'performance', 'security', 'other')} || '","urgency":"' ||
  {d.pick('o_orderkey', 'now', 'today', 'watch', 'ignore', 'later')} ||
  '"}},"probable_causes":[{{"cause":"cause ' || CAST(o_custkey AS STRING) || '","confidence":"high","evidence":"e1"}},{{"cause":"second","confidence":"' ||
  {d.pick('o_orderkey', 'low', 'medium', 'sure')} ||
  '","evidence":"e2"}}],"impact":{{"services":["web","db"],"scope":"one host"}},"recommended_checks":[{{"purpose":"space","where":"host","command":"df -h ' ||
  CASE WHEN o_orderkey % 9 = 0 THEN '| sh' ELSE '/var' END || '"}},{{"purpose":"log","where":"host","command":"' ||
  {d.pick('o_orderkey', 'journalctl -u app', 'rm -rf /var/tmp', 'docker ps -a', 'systemctl restart app')} ||
  '"}}],"correlation":{{"incidents":["I-0001"],"changes":[]}},"needs_human_decision":' ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"unknowns":["u' || CAST(o_orderkey % 7 AS STRING) || '"]}}'"""
    return f"""
SELECT o_orderkey AS id, o_custkey AS incident_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'manual' WHEN '2-HIGH' THEN 'followup' WHEN '3-MEDIUM' THEN 'retry'
    WHEN '5-LOW' THEN 'replay' ELSE 'initial' END AS trigger,
  st AS status, CASE WHEN st = 'running' THEN 'inference' ELSE 'finished' END AS phase,
  CAST(1 + o_orderkey % 3 AS INT) AS attempt,
  {d.add('o_orderdate', 'o_orderkey % 86400')} AS started_at,
  CASE WHEN st <> 'running' THEN {d.add('o_orderdate', 'o_orderkey % 86400 + floor(o_totalprice / 1000)')} END AS finished_at,
  CASE WHEN st <> 'running' THEN CAST(floor(o_totalprice) AS BIGINT) END AS duration_ms,
  'model-' || CAST(o_orderkey % 3 AS STRING) AS model,
  'v' || CAST(year(o_orderdate) AS STRING) AS knowledge_version,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE '{{"mode":"selection","tokens":' || CAST(o_orderkey AS STRING) || '}}' END AS context_json,
  CAST(floor(o_totalprice / 40) AS INT) AS prompt_tokens, CAST(floor(o_totalprice / 400) AS INT) AS completion_tokens,
  CAST(floor(o_totalprice / 300) AS INT) AS tokens_so_far,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice / 5000) AS DOUBLE) END AS tokens_per_sec,
  CASE WHEN st = 'done' THEN {answer}
       WHEN st = 'failed' AND o_orderkey % 2 = 0 THEN '{{"failed_output":"broken text ' || CAST(o_orderkey AS STRING) || '"}}'
       WHEN st = 'failed' AND o_orderkey % 3 = 0 THEN 'not json' END AS result_json,
  CASE WHEN st IN ('failed', 'released') THEN {d.pick('o_custkey', 'timeout', 'validation', 'server', 'length', 'auth', 'unreachable')} END AS error_kind
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN
        CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'released' ELSE 'done' END
      WHEN o_orderkey % 50 = 0 THEN 'running' ELSE 'done' END AS st FROM orders) o"""


def cases(d) -> str:
    """Case cards confirmed by people: one per customer."""
    return f"""
SELECT c_custkey + 1 AS id, c_custkey AS incident_id,
  substr({d.sha("'problem|host-' || CAST(c_nationkey % 10 AS STRING) || '|service'")}, 1, 16) AS fingerprint,
  'host-' || CAST(c_nationkey % 10 AS STRING) AS host,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'service' WHEN 'BUILDING' THEN 'user' WHEN 'AUTOMOBILE' THEN 'net'
    WHEN 'FURNITURE' THEN 'file' ELSE 'auth' END AS type,
  c_name AS title, 'seen ' || c_mktsegment AS symptoms, 'cause ' || CAST(c_custkey % 17 AS STRING) AS cause,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'look at ' || c_name END AS confirmation, '' AS action,
  CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS time_to_recover_sec,
  CAST({d.add("CAST('2023-06-01 00:00:00' AS TIMESTAMP)", '(c_custkey % 200) * 86400')} AS DATE) AS occurred_on,
  CASE WHEN c_custkey % 2 = 0 THEN 'correct' ELSE 'corrected' END AS verdict,
  CASE WHEN c_custkey % 5 = 0 THEN 'stale' ELSE 'approved' END AS status,
  {d.add("CAST('2023-06-01 00:00:00' AS TIMESTAMP)", 'c_custkey % 1000 * 3600')} AS approved_at
FROM customer"""


def probe_results(d) -> str:
    """Probe results: one per event."""
    return f"""
SELECT event_id AS id, user_id AS incident_id,
  CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(event_id / 5) AS BIGINT) END AS analysis_id,
  {d.pick('CAST(floor(value) AS BIGINT)', 'uptime_load', 'disk', 'memory', 'logins')} AS name,
  'host-' || CAST(user_id % 10 AS STRING) AS target,
  CASE WHEN event_type IN ('signup', 'view') THEN 'operator' ELSE 'initial' END AS trigger,
  {d.second('ts')} AS started_at, CAST(floor(value * 10) AS INT) AS duration_ms,
  {d.pick('event_id', 'ok', 'ok', 'ok', 'timeout', 'failed', 'unreachable')} AS status,
  CASE WHEN event_id % 6 < 3 THEN props ELSE '' END AS output,
  CASE WHEN event_id % 6 >= 3 THEN 'exit' END AS error
FROM events"""


def poll_log(d) -> str:
    """Polls of two sources: an error event is a failed poll."""
    return f"""
SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'problem' ELSE 'security' END AS source, {d.second('ts')} AS at,
  event_type <> 'error' AS ok, value < 30 AS complete,
  CASE WHEN event_type = 'error' THEN {d.pick('CAST(floor(event_id / 3) AS BIGINT)', 'auth', 'timeout', 'internal', 'server', 'throttled')} END AS error_kind,
  CAST(CAST(floor(event_id / 40) AS BIGINT) AS STRING) AS position,
  CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN 700 WHEN event_type = 'error' AND event_id % 7 = 0 THEN 45 END AS retry_after
FROM events"""


def listings(d) -> str:
    """Listing rounds of the problem source: a round every two hours, each naming the alerts of a slice of users."""
    return f"""
SELECT DISTINCT CAST(user_id AS STRING) AS external_id, CAST(floor({d.epoch(d.second('ts'))} / 7200) AS BIGINT) AS round,
  event_type = 'purchase' AND value < 10 AS hidden
FROM events WHERE event_type IN ('signup', 'purchase', 'view')"""


def rounds(d) -> str:
    """All listing rounds, with whether they were read to their end."""
    return f"""
SELECT round, max(polled) AS at, max(n) % 4 <> 0 AS complete FROM (
  SELECT CAST(floor({d.epoch(d.second('ts'))} / 7200) AS BIGINT) AS round, {d.second('ts')} AS polled, event_id AS n FROM events) r
GROUP BY round"""
