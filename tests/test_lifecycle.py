"""Streams with recoveries, withdrawals and restarts against the batch result."""
from __future__ import annotations

import json
import random
import shutil
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertloom.operators import normalize
from alertloom.streaming import captures, lifecycle

COLUMNS = ["kind", "external_id", "seq", "s", "resolved", "severity", "source_severity", "heard"]


class Store:
    """A state variable without Spark."""
    def __init__(self):
        self.rows = {}

    def getValue(self, key):
        return self.rows.get(key)

    def containsKey(self, key):
        return key in self.rows

    def updateValue(self, key, value):
        self.rows[key] = tuple(value)

    def removeKey(self, key):
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[()]

    def update(self, value):
        self.rows[()] = tuple(value)


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Store()

    def getValueState(self, *_):
        return Store()

    def registerTimer(self, at):
        self.timers.append(at)


class Expiry:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def started(horizon=None, gap=100):
    step = lifecycle.Lifecycle(gap, {"problem": 60, "security": 120}, horizon)
    step.init(Handle())
    return step


def fed(step, rows, source="problem", heard=0):
    frame = pd.DataFrame([(*r, heard) for r in rows], columns=COLUMNS)
    frame = frame.astype({"s": "float64", "resolved": "float64", "severity": "float64"})
    out = list(step.handleInputRows((source, "f"), iter([frame.iloc[:1], frame.iloc[1:]] if len(frame) > 1 else [frame]), None))
    return out[0] if out else pd.DataFrame(columns=["event"])


def newest(frames):
    told = {}
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.event not in ("queued", "late"):
                assert r.version > told.get(r.incident_id, (0,))[0]
                told[r.incident_id] = (r.version, r.problem_status, r.started_at, r.last_occurrence_at, r.resolved_at, r.occurrence_count, r.severity, r.source_severity)
    return {k: tuple(None if pd.isna(x) else x for x in v[1:]) for k, v in told.items() if v[1] != "withdrawn"}


def history(rnd):
    """Alerts, copies, recoveries and withdrawals of one fingerprint, and the alerts with the recovery that stands."""
    rows, final = [], []
    for k in range(rnd.randrange(1, 25)):
        s, level = rnd.randrange(2000), rnd.randrange(1, 6)
        first = rnd.choice([None, s + rnd.randrange(-50, 400)])
        rows.append(("alert", str(k), k, s, first, level, f"l{level}{k}"))
        if rnd.random() < 0.2:
            rows.append(("alert", str(k), 500 + k, s, rnd.choice([None, first]), level, f"l{level}{k}"))
        stands, seq = first, 1000 + 10 * k
        for n in range(rnd.randrange(4)):
            at = rnd.choice([None, s + rnd.randrange(500)])
            rows.append(("recovered" if at is not None else "reopened", str(k), seq + n, None, at, None, None))
            stands = None if at is None else at if stands is None else stands
        final.append((k, s, level, f"l{level}{k}", stands))
    return rows, final


def plain(final, source, gap):
    """The batch rule, second by second."""
    found, busy, now = {}, None, None
    for s in sorted({f[1] for f in final}):
        here = [f for f in final if f[1] == s]
        if busy is None or s - gap > busy:
            now = min(f[0] for f in here)
        found.setdefault(now, []).extend(here)
        ends = [s if source == "security" else float("inf") if f[4] is None else max(s, f[4]) for f in here]
        busy = max([*ends, *([] if busy is None else [busy])])
    stamp = lambda x: None if x is None else pd.Timestamp(x, unit="s")
    out = {}
    for i, members in found.items():
        done = all(m[4] is not None for m in members)
        status = "oneshot" if source == "security" else "resolved" if done else "open"
        top = max(members, key=lambda m: (m[2], -m[0]))
        out[i] = (status, stamp(min(m[1] for m in members)), stamp(max(m[1] for m in members)),
                  stamp(max(m[4] for m in members)) if status == "resolved" else None, len(members), top[2], top[3])
    return out


@pytest.mark.parametrize("source", ["problem", "security"])
def test_any_order_of_arrival_gives_the_batch_result(source):
    rnd = random.Random(5)
    for _ in range(40):
        rows, final = history(rnd)
        want = plain(final, source, 100)
        for _ in range(3):
            rnd.shuffle(rows)
            step, frames, at = started(), [], 0
            while at < len(rows):
                size = rnd.randrange(1, 8)
                frames.append(fed(step, rows[at:at + size], source))
                at += size
            frames.append(fed(step, rows[:3], source))  # what comes again changes nothing
            assert newest(frames) == want


def test_kinds_of_changes():
    step = started()
    told = lambda *rows: [(r.incident_id, r.event) for r in fed(step, rows).itertuples()]
    assert told(("recovered", "a", 50, None, 30, None, None)) == []  # its alert is not known yet
    assert told(("alert", "a", 1, 0, None, 2, "l")) == [(1, "created")]
    assert told(("alert", "b", 2, 90, None, 2, "l")) == [(1, "reopened")]
    assert told(("recovered", "b", 51, None, 95, None, None)) == [(1, "resolved")]
    assert told(("alert", "c", 3, 1000, None, 4, "l")) == [(3, "created")]
    assert told(("alert", "d", 4, 1010, None, 5, "l")) == [(3, "escalated")]
    assert told(("reopened", "b", 52, None, None, None, None)) == [(1, "reopened"), (3, "withdrawn")]
    assert told(("recovered", "b", 53, None, 95, None, None)) == [(1, "resolved"), (3, "created")]
    assert told(("recovered", "b", 54, None, 99, None, None)) == []  # the first recovery stands


def test_holds_are_told_once_and_not_for_withdrawn():
    step = started()
    fed(step, [("alert", "a", 1, 0, 10, 2, "l"), ("alert", "b", 2, 5000, 5010, 2, "l")], heard=1000)
    assert step.handle.timers == [61_000, 61_000]
    fed(step, [("reopened", "a", 9, None, None, None, None)], heard=2000)  # the first stays open and takes the second in
    told = [list(f.itertuples()) for f in step.handleExpiredTimer(("problem", "f"), None, Expiry(61_000))]
    assert [(r.incident_id, r.event) for r in told[0]] == [(1, "queued")]
    assert list(step.handleExpiredTimer(("problem", "f"), None, Expiry(61_000))) == []


def test_horizon_forgets_and_names_what_is_late():
    step = started(horizon=1000)
    fed(step, [("alert", "a", 1, 0, 10, 2, "l")])
    fed(step, [("alert", "b", 2, 5000, None, 3, "l")])
    assert [k for k, _ in step.alerts.iterator()] == [("b",)] and step.floor.get() == (10,)
    out = fed(step, [("alert", "c", 3, 60, None, 3, "l"), ("alert", "d", 4, 5050, None, 3, "l")])
    assert [(r.incident_id, r.event) for r in out.itertuples()] == [(3, "late"), (2, "recurred")]


# ---- captures ------------------------------------------------------------------------------------------------------

def capture(path: Path, number: int):
    items = [7, "x", {"eventid": True}]
    for k in range(5):
        items.append({"eventid": str(number * 10 + k), "objectid": "5", "severity": str(k), "clock": str(1_700_000_000 + number * 100 + k),
                      "name": "n", "r_eventid": "0", "hosts": [{"host": "h"}], "tags": [], "items": []})
    (path / f"c{number}.json").write_text("no json" if number == 3 else json.dumps(items))


def test_captures_stop_and_go_on(spark, tmp_path):
    files, out, mark = tmp_path / "files", str(tmp_path / "out"), str(tmp_path / "mark")
    files.mkdir()

    def run():
        query = captures.land(captures.stream_captures(spark, str(files), 2), captures.problems(), out, mark)
        query.awaitTermination(120)
        assert query.exception() is None
    for number in range(4):
        capture(files, number)
    run()
    first = captures.position(spark, out).first()
    assert (first.batch, first.elements, first.accepted, first.rejected, first.below_threshold) == (1, 25, 15, 10, 6)
    for number in range(4, 7):
        capture(files, number)
    run()
    # the last batch was written but not committed: it runs again and replaces itself
    for name in Path(mark, "commits").glob("*3*"):
        name.unlink()
    run()
    shutil.copytree(f"{out}/alerts/batch=0", f"{out}/alerts/batch=9")  # a batch without its counts is not read
    whole = normalize.explode_captures(spark.read.text(str(files), wholetext=True).withColumn("origin", F.col("_metadata.file_path")))
    good, bad = normalize.split_rejects(normalize.normalize_problems(whole, F.current_timestamp()))
    for kind, want in (("alerts", good), ("rejects", bad)):
        got = captures.landed(spark, out, kind)
        key = lambda df: sorted((r.origin.rpartition("/")[2], r.pos, r.external_id) for r in df.collect())
        assert key(got) == key(want)
    total = captures.position(spark, out).first()
    assert (total.batch, total.accepted, total.rejected) == (3, 30, 19)
    assert captures.quality(spark, out).count() == 4


def test_stream_of_changes_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(2)
    rows, final = history(rnd)
    rnd.shuffle(rows)
    files, out, mark = str(tmp_path / "files"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "kind string, source string, fingerprint string, external_id string, seq long, s long, resolved long, severity int, source_severity string"
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame([(k, "problem", "f", *r) for k, *r in part], schema).coalesce(1).write.mode("append").parquet(files)
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
        lifecycle.write_changes(lifecycle.stream_changes(events, gap=100), out, mark).awaitTermination(120)
    got = {r.id: (r.problem_status, r.occurrence_count) for r in lifecycle.current_incidents(spark.read.parquet(out)).collect()}
    assert got == {i: (v[0], v[4]) for i, v in plain(final, "problem", 100).items()}
