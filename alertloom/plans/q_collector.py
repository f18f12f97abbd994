"""Queries over the poll log and the listing rounds."""
from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import collector, intake
from alertloom.operators.queueing import queue_summary
from alertloom.plans import adapters
from alertloom.plans.oracle import add_block, over
from alertloom.plans.registry import query

NOW = "TIMESTAMP '2024-01-30 23:58:00'"
add_block("streaks", ("polls",), """
SELECT *, CASE WHEN ok THEN 0 ELSE n - last_ok END AS failures,
  count(*) FILTER (ok AND NOT complete) OVER (PARTITION BY source, full_no ORDER BY "at", id) AS incomplete_polls,
  CASE WHEN ok THEN 0 ELSE count(*) OVER (PARTITION BY source, last_ok, move_no ORDER BY "at", id) - CASE WHEN first_is_ok THEN 1 ELSE 0 END END AS stuck_failures
FROM (SELECT *, sum(CASE WHEN moved THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY "at", id) AS move_no,
    NOT moved AND last_ok > 0 AND false AS first_is_ok FROM (
  SELECT *, NOT ok AND (prev_fail IS DISTINCT FROM position OR n - 1 = last_ok) AS moved FROM (
  SELECT *, coalesce(max(CASE WHEN ok THEN n END) OVER (PARTITION BY source ORDER BY "at", id), 0) AS last_ok,
    coalesce(sum(CASE WHEN ok AND complete THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY "at", id), 0) AS full_no,
    max(CASE WHEN NOT ok THEN position END) OVER (PARTITION BY source, ok ORDER BY "at", id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_fail
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at", id) AS n FROM polls) a) b) c) d""")
add_block("waits", ("streaks",), """
SELECT *, "at" + to_seconds(CAST(wait_sec AS BIGINT)) AS next_poll_at FROM (SELECT *, CASE WHEN ok THEN iv WHEN error_kind = 'auth' THEN 900
  ELSE greatest(least(iv * pow(2, least(failures - 1, 20)), 600), coalesce(least(retry_after, 600), 0)) END AS wait_sec
FROM (SELECT *, CASE WHEN source = 'security' THEN 60 ELSE 30 END AS iv FROM streaks) x) y""")
add_block("cstate", ("waits",), """
SELECT source, max("at") AS last_poll_at, max("at") FILTER (ok) AS last_ok_at, arg_max(failures, id) AS failures,
  arg_max(incomplete_polls, id) AS incomplete_polls, arg_max(stuck_failures, id) AS stuck_failures,
  arg_max(error_kind, id) FILTER (NOT ok) AS last_error_kind, arg_max(next_poll_at, id) AS next_poll_at FROM waits GROUP BY source""")


def state_of(t):
    return collector.collector_state(collector.next_poll(collector.failure_streaks(t.polls), t.cfg))


def now_of():
    return F.lit("2024-01-30 23:58:00").cast("timestamp")


@query("failure_streaks", over("streaks", sql="SELECT id, source, failures, incomplete_polls, stuck_failures FROM streaks"))
def _(t):
    return collector.failure_streaks(t.polls).select("id", "source", "failures", "incomplete_polls", "stuck_failures")


@query("next_poll", over("waits", sql="SELECT id, source, CAST(wait_sec AS BIGINT) AS wait_sec, next_poll_at FROM waits"))
def _(t):
    return collector.next_poll(collector.failure_streaks(t.polls), t.cfg).select("id", "source", "wait_sec", "next_poll_at")


@query("collector_state", over("cstate", sql="SELECT * FROM cstate"))
def _(t):
    return state_of(t)


@query("due_sources", over("cstate", sql=f"""
SELECT source, ahead > 900 OR ahead <= 0 AS due, CASE WHEN ahead > 900 THEN 'stored time too far ahead' WHEN ahead <= 0 THEN 'time has come'
  WHEN failures = 0 THEN 'usual interval' WHEN last_error_kind = 'auth' THEN 'waiting after a credential error'
  ELSE 'waiting after failures' END AS reason, CASE WHEN ahead > 900 OR ahead <= 0 THEN 0 ELSE ahead END AS wait_sec
FROM (SELECT *, CAST(epoch(next_poll_at) - epoch({NOW}) AS BIGINT) AS ahead FROM cstate) x"""))
def _(t):
    return collector.due_sources(state_of(t), now_of(), t.cfg)


@query("source_health", over("cstate", sql=f"""
SELECT source, reason IS NULL AS healthy, reason, since AS seconds_since_ok FROM (SELECT source, since, CASE
  WHEN failures > 0 AND stuck_failures >= 3 AND last_error_kind IN ('invalid_response', 'partial', 'too_large', 'internal') THEN 'stuck'
  WHEN failures > 0 THEN 'failing' WHEN last_ok_at IS NULL THEN 'never ok' WHEN since < 0 THEN 'clock in the future'
  WHEN since > 3 * CASE WHEN source = 'security' THEN 60 ELSE 30 END THEN 'stale' WHEN incomplete_polls > 3 THEN 'behind' END AS reason
FROM (SELECT n.source, CAST(epoch({NOW}) - epoch(last_ok_at) AS BIGINT) AS since, failures, stuck_failures, last_error_kind, last_ok_at,
  incomplete_polls FROM (VALUES ('problem'), ('security')) n(source) LEFT JOIN cstate USING (source)) x) y"""))
def _(t):
    return collector.source_health(state_of(t), now_of(), t.cfg)


def refs_of(t):
    return t.alerts.where("source = 'problem'").selectExpr(
        "source", "CAST(seq % 400 AS STRING) AS external_id", "seq AS incident_id",
        "CAST(floor(unix_timestamp(started_at) / 7200) AS BIGINT) AS seen_round",
        "CASE WHEN seq % 3 = 0 THEN resolved_at END AS resolved_at").where("resolved_at IS NULL") \
        .groupBy("source", "external_id").agg(F.min("incident_id").alias("incident_id"), F.min("seen_round").alias("seen_round"),
                                              F.min("resolved_at").alias("resolved_at"))


@query("missing_in_listing", over("alerts", "listings", "rounds", sql="""
WITH refs AS (SELECT source, CAST(seq % 400 AS VARCHAR) AS external_id, min(seq) AS incident_id,
  min(CAST(floor(epoch(started_at) / 7200) AS BIGINT)) AS seen_round FROM alerts WHERE source = 'problem'
  AND (seq % 3 <> 0 OR resolved_at IS NULL) GROUP BY 1, 2),
full_rounds AS (SELECT round, "at", row_number() OVER (ORDER BY round) AS nth FROM rounds WHERE complete),
grid AS (SELECT r.source, r.external_id, r.incident_id, f.nth, f."at", l.external_id IS NULL AS absent
  FROM refs r JOIN full_rounds f ON f.nth > (SELECT count(*) FROM full_rounds g WHERE g.round <= r.seen_round)
  LEFT JOIN (SELECT DISTINCT external_id, round FROM listings) l ON l.external_id = r.external_id AND l.round = f.round),
part AS (SELECT l.external_id, (SELECT count(*) FROM full_rounds f WHERE f.round <= l.round) AS k FROM listings l JOIN rounds r USING (round)
  WHERE NOT r.complete AND NOT l.hidden),
cuts AS (SELECT g.*, (SELECT count(DISTINCT k) FROM part p WHERE p.external_id = g.external_id AND p.k < g.nth) AS cut FROM grid g),
runs AS (SELECT *, nth - row_number() OVER (PARTITION BY source, external_id, absent, cut ORDER BY nth) AS run FROM cuts),
streak AS (SELECT *, row_number() OVER (PARTITION BY source, external_id, absent, cut, run ORDER BY nth) AS k FROM runs),
closed AS (SELECT source, external_id, incident_id, min(nth) AS nth FROM streak WHERE absent AND k = 3 GROUP BY 1, 2, 3)
SELECT c.source, c.external_id, c.incident_id, 'resolved' AS outcome, CAST(3 AS BIGINT) AS missing_rounds, f."at" AS resolved_at
FROM closed c JOIN full_rounds f USING (nth)
UNION ALL SELECT source, external_id, incident_id, 'missing', k, NULL FROM streak s WHERE absent AND nth = (SELECT max(nth) FROM full_rounds) AND NOT EXISTS (SELECT 1 FROM part p WHERE p.external_id = s.external_id AND p.k = s.nth)
  AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.external_id = s.external_id)"""))
def _(t):
    return collector.missing_in_listing(refs_of(t), t.listings, t.rounds, t.cfg)


@query("recovered_in_listing", over("assigned", sql=f"""
SELECT a.source, a.external_id, a.incident_id, CASE WHEN event_id % 4 = 1 THEN TIMESTAMP '{adapters.NOW}' ELSE
  date_trunc('second', ts) END AS resolved_at FROM assigned a JOIN events e ON a.external_id = CAST(e.event_id AS VARCHAR)
WHERE a.resolved_at IS NULL AND event_id % 4 IN (1, 2)"""))
def _(t):
    listed = t.events.select(F.col("event_id").cast("string").alias("external_id"),
                             F.when((F.col("event_id") % 4).isin(1, 2), "77").otherwise("0").alias("r_eventid"),
                             F.when(F.col("event_id") % 4 == 1, "x").otherwise(F.unix_timestamp("ts").cast("string")).alias("r_clock"))
    return collector.recovered_in_listing(listed, intake.alert_refs(t.assigned), t.now)


@query("recovery_lookup", f"""
SELECT CAST(event_id AS VARCHAR) AS external_id, CASE WHEN event_id % 3 <> 0 THEN 'r' || CAST(event_id AS VARCHAR) END AS r_eventid,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE TIMESTAMP '{adapters.NOW}' END AS resolved_at
FROM events WHERE event_type = 'error'""")
def _(t):
    own = F.col("event_id").cast("string")
    link = F.concat(F.lit("r"), own)
    missing = t.events.where("event_type = 'error'").select(own.alias("external_id"))
    links = t.events.select(own.alias("external_id"), F.when(F.col("event_id") % 3 == 0, "0").otherwise(link).alias("r_eventid"))
    clocks = t.events.where("event_id % 2 = 0").select(link.alias("eventid"), F.unix_timestamp("ts").cast("string").alias("clock"))
    return collector.recovery_lookup(missing, links, clocks, t.now)


@query("backlog_trend", over("streaks", sql="""
SELECT id, source, "at", CASE WHEN incomplete_polls = 4 THEN 'behind' ELSE 'caught up' END AS change,
  greatest(was, incomplete_polls) AS polls FROM (SELECT *, coalesce(lag(incomplete_polls) OVER (PARTITION BY source ORDER BY "at", id), 0) AS was
  FROM streaks WHERE ok) x WHERE incomplete_polls = 4 OR (incomplete_polls = 0 AND was > 3)"""))
def _(t):
    return collector.backlog_trend(collector.failure_streaks(t.polls), t.cfg)


@query("health_report", over("cstate", "incidents", "log", sql=f"""
WITH h AS (SELECT source || ': ' || CASE WHEN failures > 0 AND stuck_failures >= 3 AND last_error_kind = 'internal' THEN 'stuck'
  WHEN failures > 0 THEN 'failing' WHEN epoch({NOW}) < epoch(last_ok_at) THEN 'clock in the future'
  WHEN epoch({NOW}) - epoch(last_ok_at) > 3 * CASE WHEN source = 'security' THEN 60 ELSE 30 END THEN 'stale'
  WHEN incomplete_polls > 3 THEN 'behind' END AS problem FROM cstate),
e AS (SELECT incident_id, max("at") AS entered FROM log WHERE type IN ('queued', 'requeued', 'followup_queued') GROUP BY 1),
q AS (SELECT CAST(epoch({NOW}) - epoch(min(CASE WHEN analysis_state = 'queued' THEN coalesce(entered, started_at) WHEN analysis_state = 'retry_wait'
  AND next_retry_at <= {NOW} THEN next_retry_at END)) AS BIGINT) AS sec FROM incidents i LEFT JOIN e ON e.incident_id = i.id),
p AS (SELECT problem FROM h WHERE problem IS NOT NULL UNION ALL SELECT 'queue: oldest wait ' || CAST(sec AS VARCHAR) || ' s' FROM q WHERE sec > 600
  UNION ALL SELECT 'manual: not loaded')
SELECT CASE WHEN count(*) = 0 THEN 'ok' ELSE 'degraded' END AS status, count(*) AS problems, string_agg(problem, '; ' ORDER BY problem) AS detail FROM p"""))
def _(t):
    loaded = t.documents.agg((F.count("*") < 0).alias("loaded"), F.lit(False).alias("stale"))
    return collector.health_report(collector.source_health(state_of(t), now_of(), t.cfg),
                                   queue_summary(t.incidents, t.log, now_of(), t.cfg), loaded)


@query("poll_report", over("arrivals", "assigned", sql="""
WITH fst AS (SELECT source, external_id, min(seq) AS first_seq FROM arrivals GROUP BY 1, 2),
known AS (SELECT source, external_id, arg_min(resolved_at, seq) FILTER (resolved_at IS NOT NULL) AS rec FROM arrivals GROUP BY 1, 2),
one AS (SELECT a.*, rec FROM arrivals a JOIN fst ON a.seq = fst.first_seq JOIN known k ON k.source = a.source AND k.external_id = a.external_id),
ends2 AS (SELECT *, max(busy) OVER (PARTITION BY source, fingerprint ORDER BY started_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT seq, source, fingerprint, started_at, CASE WHEN source = 'security' THEN started_at WHEN rec IS NULL
    THEN TIMESTAMP '2999-01-01 00:00:00' ELSE greatest(started_at, rec) END AS busy FROM one WHERE analyzable) x),
o AS (SELECT a.source, CASE WHEN a.seq <> first_seq THEN 'duplicate' WHEN NOT a.analyzable THEN 'skipped'
  WHEN e.before IS NULL OR e.started_at - INTERVAL 1800 SECOND > e.before THEN 'created' ELSE 'recurred' END AS outcome
  FROM arrivals a JOIN fst USING (source, external_id) LEFT JOIN ends2 e ON e.seq = a.seq)
SELECT source, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'recurred') AS recurred,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'duplicate') AS duplicate, CAST(0 AS BIGINT) AS known,
  CAST(0 AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS resolved, CAST(0 AS BIGINT) AS reopened, CAST(0 AS BIGINT) AS hidden,
  CAST(0 AS BIGINT) AS missing FROM o GROUP BY source"""))
def _(t):
    return collector.poll_report(intake.intake_outcomes(t.arrivals))
