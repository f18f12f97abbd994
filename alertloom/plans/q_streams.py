"""Replays: the tables as files that arrive in batches and out of order, through the streams, against the batch result."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from alertloom.plans.oracle import over
from alertloom.plans.q_sources import problem_captures, security_captures
from alertloom.plans.registry import ORACLES, query
from alertloom.session import checkpoint_dir
from alertloom.streaming import captures, lifecycle

LATER = 1 << 40  # numbers of what is heard after the alerts


def place(t, kind: str) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def heard(t):
    """Alerts without their recoveries, and the recoveries on their own. One recovery in three is first told with a wrong time,
    then withdrawn, then told again. Copies of alerts come too."""
    alerts = t.alerts
    bare = alerts.withColumn("resolved_at", F.when(F.col("seq") % 2 == 0, F.col("resolved_at")))
    told = alerts.where("analyzable AND seq % 2 = 1 AND resolved_at IS NOT NULL")
    wrong = told.where("seq % 3 = 0")
    later = lambda rows, k, at: rows.select("source", "fingerprint", "external_id", (F.col("seq") * 4 + LATER + k).alias("seq"), at.alias("resolved_at"))
    recoveries = later(wrong, 0, F.col("resolved_at") + F.expr("INTERVAL 7 HOURS")).unionByName(later(wrong, 1, F.lit(None).cast("timestamp"))) \
        .unionByName(later(told, 2, F.col("resolved_at")))
    return lifecycle.alert_events(bare).unionByName(lifecycle.alert_events(bare.where("seq % 5 = 0"))).unionByName(lifecycle.recovery_events(recoveries))


def replay(t):
    """Changes of incidents after the stream has read all files, three at a time, in an order that has nothing to do with time."""
    files, out, mark = (place(t, kind) for kind in ("heard", "changes", "position"))
    heard(t).repartition(9, F.xxhash64("seq", "kind")).write.parquet(files)
    schema = t.spark.read.parquet(files).schema
    events = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(files)
    lifecycle.write_changes(lifecycle.stream_changes(events, t.cfg), out, mark).awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_incidents", over("rolled", sql="""
SELECT id, source, fingerprint, problem_status, started_at, last_occurrence_at, resolved_at, occurrence_count, severity, source_severity FROM rolled"""))
def _(t):
    return lifecycle.current_incidents(replay(t)).select("id", "source", "fingerprint", "problem_status", "started_at", "last_occurrence_at", "resolved_at",
                                                         "occurrence_count", "severity", "source_severity")


def landing(t, made, normalise):
    files, out, mark = (place(t, kind) for kind in ("captures", "landed", "position"))
    made.select("value").repartition(7, F.xxhash64("value")).write.text(files)
    # a line of these files is an array already
    source = captures.stream_captures(t.spark, files, 3, lines=True).withColumn("value", F.expr("substr(value, 2, length(value) - 2)"))
    captures.land(source, normalise, out, mark).awaitTermination()
    return out


@query("stream_captures", ORACLES["normalize_security"])
def _(t):
    out = landing(t, security_captures(t), captures.security_alerts(t.cfg))
    return captures.landed(t.spark, out).select("external_id", "host", "type", "severity", "title", "started_at", "fingerprint", "analyzable")


@query("stream_quality", """
SELECT 2 * count(*) AS elements, count_if(event_id % 9 <> 3) AS accepted, count(*) + count_if(event_id % 9 = 3) AS rejected,
  count_if(event_id % 9 <> 3 AND event_id % 6 < 2) AS below_threshold, max(CASE WHEN event_id % 9 <> 3 THEN date_trunc('second', ts) END) AS newest FROM events""")
def _(t):
    out = landing(t, problem_captures(t), captures.problems(t.cfg))
    return captures.position(t.spark, out).select("elements", "accepted", "rejected", "below_threshold", "newest")
