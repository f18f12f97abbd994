"""Incidents as a stream of changes, fed by alerts and by recoveries, whatever order they arrive in.

The state of a fingerprint are its alerts by external id, each with the recoveries and withdrawals heard of it, in parts by a hash of
that id, a map of what was last told of each incident, and a timer per hold. A call takes in what the batch brought, forms the incidents of the
fingerprint anew by event time, and tells the differences under rising version numbers. Recoveries may precede their alert. So
the newest versions equal ``intake.incident_rollup`` over the same input, for every order of arrival.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertloom.operators.intake import NEVER
from alertloom.settings import SECURITY, Settings

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = ("source STRING, fingerprint STRING, incident_id BIGINT, version INT, event STRING, problem_status STRING, started_at TIMESTAMP, "
           "last_occurrence_at TIMESTAMP, resolved_at TIMESTAMP, occurrence_count BIGINT, severity INT, source_severity STRING")
BUCKETS = 256  # parts of the alerts of a fingerprint; a part is read and written as one value
TOLD = "version INT, status STRING, started BIGINT, last BIGINT, resolved BIGINT, n BIGINT, severity INT, source_severity STRING"
UNKNOWN = -1
GONE = "withdrawn"


def prepare_streams(spark: SparkSession) -> SparkSession:
    """State with several variables needs the state store that has column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def alert_events(alerts: DataFrame) -> DataFrame:
    """Alerts above the threshold as input of ``stream_changes``; copies of an alert may come."""
    return alerts.where("analyzable").select(
        F.lit("alert").alias("kind"), "source", "fingerprint", "external_id", "seq", F.unix_timestamp("started_at").alias("s"),
        F.unix_timestamp("resolved_at").alias("resolved"), "severity", "source_severity")


def recovery_events(recoveries: DataFrame) -> DataFrame:
    """``recoveries(source, fingerprint, external_id, seq, resolved_at)`` as input of ``stream_changes``: without a time an
    earlier recovery is withdrawn."""
    return recoveries.select(
        F.when(F.col("resolved_at").isNull(), "reopened").otherwise("recovered").alias("kind"), "source", "fingerprint", "external_id", "seq",
        F.lit(None).cast("bigint").alias("s"), F.unix_timestamp("resolved_at").alias("resolved"), F.lit(None).cast("int").alias("severity"),
        F.lit(None).cast("string").alias("source_severity"))


def resolved_by(marks: str) -> int | None:
    """The recovery that stands after all marks ``seq:time`` in the order of seq: the first wins until it is withdrawn."""
    now = None
    if not marks:
        return None
    for _, at in sorted((int(seq), at) for seq, at in (m.split(":") for m in marks.split(",") if m)):
        now = None if not at else int(at) if now is None else now
    return now


def sessions(alerts: list[tuple], oneshot: bool, gap: int) -> dict[int, tuple]:
    """Incidents of one fingerprint: the columns of ``TOLD`` after the version, by incident id. ``alerts`` hold seq, second, severity, its label and the marks."""
    known = sorted((s, seq, severity, label, resolved_by(marks)) for seq, s, severity, label, marks in alerts if seq != UNKNOWN)
    found: dict[int, list[tuple]] = {}
    busy, now, at = None, None, 0
    while at < len(known):
        end = at
        while end < len(known) and known[end][0] == known[at][0]:
            end += 1
        second = known[at:end]
        if busy is None or second[0][0] - gap > busy:
            now = second[0][1]
        found.setdefault(now, []).extend(second)
        until = max(s if oneshot else NEVER if resolved is None else max(s, resolved) for s, *_, resolved in second)
        busy = until if busy is None else max(busy, until)
        at = end
    out = {}
    for incident, members in found.items():
        ends = [m[4] for m in members]
        status = "oneshot" if oneshot else "open" if None in ends else "resolved"
        top = max(members, key=lambda m: (m[2], -m[1]))
        out[incident] = (status, members[0][0], members[-1][0], max(ends) if status == "resolved" else None, len(members), top[2], top[3])
    return out


def change_of(old: tuple | None, new: tuple) -> str:
    """The kind of a change from what was told (status, started, last, resolved, n, severity, label)."""
    if old is None or old[0] == GONE:
        return "created"
    if new[0] != old[0]:
        return {"resolved": "resolved", "open": "reopened", GONE: GONE}.get(new[0], "changed")
    return "escalated" if new[5] > old[5] else "recurred" if new[4] > old[4] else "changed"


class Alerts:
    """The alerts of a fingerprint by external id in a map state of parts. A call reads all parts and writes those it changed, each as
    one value: what passes between Spark and Python does not take a turn per alert."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("alerts", "part INT", "alerts STRING")

    def read(self) -> dict[int, dict[str, list]]:
        return {part: json.loads(text) for (part,), (text,) in self.parts.iterator()}

    def write(self, parts: dict[int, dict[str, list]], changed: set[int]) -> None:
        for part in sorted(changed):
            if parts[part]:
                self.parts.updateValue((part,), (json.dumps(parts[part]),))
            elif self.parts.containsKey((part,)):
                self.parts.removeKey((part,))

    def iterator(self) -> Iterator[tuple]:
        return (((name,), tuple(held)) for known in self.read().values() for name, held in known.items())


class Lifecycle(StatefulProcessor):
    """State and rules of one fingerprint."""

    def __init__(self, gap: int, hold: dict[str, int], horizon: int | None) -> None:
        self.gap, self.hold, self.horizon = gap, hold, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = Alerts(handle)
        self.told = handle.getMapState("told", "incident_id BIGINT", TOLD)
        self.holds = handle.getMapState("holds", "incident_id BIGINT", "due BIGINT")
        self.floor = handle.getValueState("floor", "s BIGINT")

    def take(self, rows: pd.DataFrame, floor: int | None, parts: dict[int, dict[str, list]], changed: set[int]) -> Iterator[int]:
        """Put the rows of a batch into ``parts``; numbers of alerts that come after their time was closed."""
        for kind, name, seq, s, resolved, severity, label in zip(*(rows[c].tolist() for c in ("kind", "external_id", "seq", "s", "resolved", "severity", "source_severity"))):
            key = name if isinstance(name, str) else ""
            part = zlib.crc32(key.encode()) % BUCKETS
            known = parts.setdefault(part, {})
            held = known.get(key) or [UNKNOWN, None, None, None, ""]
            if kind == "alert":
                if floor is not None and held[0] == UNKNOWN and s - self.gap <= floor:
                    yield int(seq)
                    continue
                if held[0] == UNKNOWN or seq < held[0]:
                    held = [int(seq), int(s), int(severity), label, held[4]]
            mark = None if kind == "alert" and pd.isna(resolved) else f"{seq}:" if pd.isna(resolved) else f"{seq}:{int(resolved)}"
            if mark and mark not in held[4].split(","):
                held = [*held[:4], f"{held[4]},{mark}" if held[4] else mark]
            if held != known.get(key):
                known[key] = held
                changed.add(part)

    def rows(self, key: tuple, told: list[tuple]) -> pd.DataFrame:
        stamp = lambda s: pd.NaT if s is None else pd.Timestamp(s, unit="s")
        made = [(*key, incident, version, event, status, stamp(a), stamp(b), stamp(r), n, severity, label)
                for incident, version, event, status, a, b, r, n, severity, label in told]
        return pd.DataFrame(made, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        source, heard, late = key[0], 0, []
        floor = self.floor.get()[0] if self.floor.exists() else None
        parts, changed = self.alerts.read(), set()
        for batch in rows:
            late += self.take(batch, floor, parts, changed)
            heard = max(heard, int(batch["heard"].max()))
        out = [(seq, 0, "late", None, None, None, None, None, None, None) for seq in late]
        now = sessions([v for known in parts.values() for v in known.values()], source == SECURITY, self.gap)
        before = {k[0]: v for k, v in self.told.iterator()}
        gone = {i: (GONE, *v[2:]) for i, v in before.items() if i not in now and v[1] != GONE}
        for incident, new in sorted((now | gone).items()):
            old = before.get(incident)
            if old is not None and tuple(old[1:]) == new:
                continue
            version = 1 if old is None else old[0] + 1
            self.told.updateValue((incident,), (version, *new))
            out.append((incident, version, change_of(None if old is None else old[1:], new), *new))
            if old is None:
                due = heard + self.hold.get(source, 60) * 1000
                self.holds.updateValue((incident,), (due,))
                self.handle.registerTimer(due)
        if self.horizon is not None and now:
            self.forget(parts, changed, now)
        self.alerts.write(parts, changed)
        if out:
            yield self.rows(key, out)

    def forget(self, parts: dict[int, dict[str, list]], changed: set[int], now: dict[int, tuple]) -> None:
        """Drop the alerts of ended incidents that ended before the horizon, and remember the time up to which that is done."""
        newest = max(v[2] for v in now.values())
        ended = [v for v in now.values() if v[0] != "open" and max(v[2], v[3] or 0) + self.gap < newest - self.horizon]
        if not ended:
            return
        until = max(max(v[2], v[3] or 0) for v in ended)
        for part, known in parts.items():
            gone = [name for name, held in known.items() if held[0] != UNKNOWN and any(v[1] <= held[1] <= v[2] for v in ended)]
            for name in gone:
                del known[name]
            if gone:
                changed.add(part)
        for incident, v in now.items():
            if v in ended:
                self.told.removeKey((incident,))
        self.floor.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Incidents whose hold is over are told as queued, with their newest version."""
        at = expiredTimerInfo.getExpiryTimeInMs()
        over = [k[0] for k, v in self.holds.iterator() if v[0] <= at]
        out = []
        for incident in sorted(over):
            self.holds.removeKey((incident,))
            if self.told.containsKey((incident,)):
                version, *told = self.told.getValue((incident,))
                if told[0] != GONE:
                    out.append((incident, version, "queued", *told))
        if out:
            yield self.rows(key, out)

    def close(self) -> None:
        """Nothing is held outside the state."""


def stream_changes(events: DataFrame, cfg: Settings = Settings(), gap: int | None = None, horizon: int | None = None, clock: bool = False) -> DataFrame:
    """Changes of incidents from the union of ``alert_events`` and ``recovery_events``: the columns of ``CHANGES``, where
    ``event`` is created, recurred, escalated, resolved, reopened, changed, withdrawn (another incident took its alerts), queued
    (the hold is over), or late (an alert, named by its seq, whose time was closed).

    Holds run from the time of the batch that brought the incident. Their timers follow the times of the batches, so that a
    query that takes what is there and ends does end; with ``clock`` they follow the clock, for a query that runs on.

    ``horizon`` seconds after its end an incident leaves the state; without it all alerts of a fingerprint stay. A batch costs
    the alerts that the state holds of the fingerprints it touches.
    """
    hold = {SECURITY: cfg.hold_security, "problem": cfg.hold_problem}
    processor = Lifecycle(gap or cfg.recurrence_gap, hold, horizon)
    heard = events.withColumn("heard_at", F.current_timestamp()).withColumn("heard", F.unix_millis("heard_at"))
    # all rows of a batch carry its time, so that none is ever behind the watermark
    timed = heard if clock else heard.withWatermark("heard_at", "0 seconds")
    return timed.groupBy("source", "fingerprint").transformWithStateInPandas(processor, CHANGES, "Append", "ProcessingTime" if clock else "EventTime")


def write_changes(changes: DataFrame, path: str, checkpoint: str):
    """Append the changes under the number of their batch: a batch that is written again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    prepare_streams(changes.sparkSession)
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_incidents(changes: DataFrame) -> DataFrame:
    """The newest version of every incident that was not withdrawn."""
    kept = ("version", "problem_status", "started_at", "last_occurrence_at", "resolved_at", "occurrence_count", "severity", "source_severity")
    newest = changes.where("event NOT IN ('late', 'queued')").groupBy("source", "fingerprint", "incident_id").agg(F.max_by(F.struct(*kept), "version").alias("v"))
    return newest.where(F.col("v.problem_status") != GONE).select("source", "fingerprint", F.col("incident_id").alias("id"), "v.*")


def status_counts(changes: DataFrame) -> DataFrame:
    """How often each kind of change was told, by source."""
    return changes.groupBy("source", "event").agg(F.count("*").alias("times"))


def queued_holds(changes: DataFrame) -> Column:
    """Filter for the incidents whose hold has ended."""
    return changes["event"] == "queued"
