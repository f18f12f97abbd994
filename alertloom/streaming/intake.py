"""The intake as Structured Streaming queries."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alertloom.schemas import ALERTS
from alertloom.settings import SECURITY, Settings

LATENESS = "120 seconds"


def stream_alerts(spark: SparkSession, path: str, schema: str = ALERTS, files_per_batch: int | None = None) -> DataFrame:
    """Continuous intake of normalised alerts from a folder of Parquet files. The checkpoint of the query that reads it holds
    the position: page and position move together, and a restart goes on where it stopped."""
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def stream_dedup(alerts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Copies that come again inside the overlap are dropped; state older than the lateness is forgotten."""
    return alerts.withWatermark("started_at", lateness).dropDuplicatesWithinWatermark(["source", "external_id"])


def stream_oneshot_sessions(alerts: DataFrame, gap: int = 1800, lateness: str = LATENESS) -> DataFrame:
    """Session incidents of alerts without recovery, once the watermark has passed their end."""
    held = alerts.where((F.col("source") == SECURITY) & F.col("analyzable")).withWatermark("started_at", lateness)
    return (held.groupBy("fingerprint", F.session_window("started_at", f"{gap} seconds").alias("w"))
            .agg(F.min("seq").alias("incident_id"), F.count("*").alias("occurrence_count"), F.max("severity").alias("severity"))
            .select("fingerprint", "incident_id", F.col("w.start").alias("started_at"),
                    (F.col("w.end") - F.expr(f"INTERVAL {gap} SECONDS")).alias("last_occurrence_at"), "occurrence_count", "severity"))


def stream_storm_counts(incidents: DataFrame, cfg: Settings = Settings(), lateness: str = LATENESS) -> DataFrame:
    """Sliding counts of starts as an alarm; the exact windows are the batch density."""
    window = F.window("started_at", f"{cfg.storm_window} seconds", "60 seconds")
    return (incidents.withWatermark("started_at", lateness).groupBy(window.alias("w")).agg(F.count("*").alias("starts"))
            .select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "starts", (F.col("starts") >= cfg.storm_count).alias("storm")))


INCIDENT_STATE = "incident_id BIGINT, started BIGINT, last BIGINT, resolved BIGINT, n BIGINT, n_open BIGINT, severity INT, held ARRAY<BIGINT>"
INCIDENT_EVENTS = "source STRING, fingerprint STRING, seq BIGINT, incident_id BIGINT, event STRING, started_at TIMESTAMP, occurrence_count BIGINT, severity INT"
OPEN = 1 << 52
HELD = 5  # numbers in ``held`` per incident that waits: id, end of the hold (ms), start, alerts, severity


def _fold(gap: int, hold: dict[str, int]) -> Callable:
    """Arrival-order intake of one fingerprint: one output row per alert, and a timer for the holds. State is one small row and
    ``HELD`` numbers per incident whose hold runs. The alerts of a batch are taken in the order of ``seq``. Every call sets the
    timer anew, as Spark clears it at each; holds that have ended are told first."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, fingerprint = key
        now, held, clock = None, [], state.getCurrentProcessingTimeMs()
        if state.exists:
            *now, flat = state.get
            held = [list(flat[k:k + HELD]) for k in range(0, len(flat), HELD)]
        rows = [(source, fingerprint, i, i, "queued", pd.Timestamp(s, unit="s"), n, level) for i, due, s, n, level in held if due <= clock]
        held = [h for h in held if h[1] > clock]
        frames = [batch for batch in batches if len(batch)]
        alerts = pd.concat(frames).sort_values("seq", kind="stable") if frames else None
        for seq, at, until, level in zip(*(alerts[c] for c in ("seq", "s", "until", "severity"))) if frames else ():
            oneshot, end = source == SECURITY, 0 if until >= OPEN else until
            if now is not None:
                incident_id, started, last, resolved, n, n_open, severity = now
                is_open = not oneshot and n_open > 0
                near = at - gap <= max(last, resolved) and at >= started - gap
            if now is None or not (is_open or near):
                now, event = (seq, at, at, end, 1, int(not oneshot and until >= OPEN), level), "created"
                held.append([seq, clock + hold.get(source, 60) * 1000, at, 1, level])
            else:
                event = "escalated" if level > severity else "recurred"
                now = (incident_id, min(started, at), max(last, at), max(resolved, end), n + 1, n_open + int(not oneshot and until >= OPEN), max(severity, level))
                for h in held:
                    if h[0] == incident_id:
                        h[2:] = [now[1], now[4], now[6]]
            rows.append((source, fingerprint, seq, now[0], event, pd.Timestamp(now[1], unit="s"), now[4], now[6]))
        if now is not None:
            state.update((*now, [x for h in held for x in h]))
            if held:
                state.setTimeoutDuration(max(1, min(h[1] for h in held) - clock))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INCIDENT_EVENTS.split(", ")])
    return step


def stream_incidents(alerts: DataFrame, cfg: Settings = Settings(), gap: int | None = None) -> DataFrame:
    """Incidents in arrival order: created, recurred, escalated per alert, and queued when the hold is over.

    State is one small row per fingerprint, and the alerts of a batch pass it as Arrow batches. The trigger bounds how many
    alerts a batch brings.
    """
    s = F.unix_timestamp("started_at")
    until = F.when(F.col("source") == SECURITY, s).when(F.col("resolved_at").isNull(), F.lit(OPEN)).otherwise(
        F.greatest(s, F.unix_timestamp("resolved_at")))
    rows = alerts.where("analyzable").select("source", "fingerprint", "seq", s.alias("s"), until.alias("until"), "severity")
    hold = {SECURITY: cfg.hold_security, "problem": cfg.hold_problem}
    return rows.groupBy("source", "fingerprint").applyInPandasWithState(
        _fold(gap or cfg.recurrence_gap, hold), INCIDENT_EVENTS, INCIDENT_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_holds(incident_events: DataFrame) -> DataFrame:
    """Incidents whose hold has ended, from the timers of ``stream_incidents``."""
    return incident_events.where("event = 'queued'").select("source", "fingerprint", "incident_id", "started_at")


def stream_changes(incident_events: DataFrame, path: str, checkpoint: str):
    """Change feed: the incidents a batch touched, appended under the number of the batch. Writing a batch again replaces
    what it wrote, so a restart leaves no duplicates."""
    def write(batch: DataFrame, number: int) -> None:
        touched = batch.groupBy("incident_id").agg(F.max("occurrence_count").alias("occurrence_count"), F.max("severity").alias("severity"))
        touched.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return incident_events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_quality(alerts: DataFrame, name: str = "quality") -> DataFrame:
    """Alerts unchanged, with counts per batch observed on the way; a listener or ``lastProgress`` reads them."""
    return alerts.observe(name, F.count("*").alias("rows"), F.count_if(F.col("external_id").isNull()).alias("no_id"),
                          F.count_if(~F.col("analyzable")).alias("below_threshold"), F.count_if(F.col("started_at").isNull()).alias("no_time"))
