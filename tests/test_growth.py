"""What must not grow faster than the input: chains of requests, sizes of texts, turns of the stream state."""
from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertloom.functions.text import estimate_tokens
from alertloom.operators import normalize, probes, prompts
from alertloom.streaming import lifecycle
from tests import test_lifecycle


def chain(seconds, within):
    """The plain loop."""
    taken = []
    for s in seconds:
        if not taken or s - taken[-1] >= within:
            taken.append(s)
    return taken


@pytest.mark.parametrize("within", [1, 60, 3600, 86400])
def test_a_day_is_left_where_the_plain_chain_leaves_it(spark, within):
    rnd = random.Random(within)
    for _ in range(20):
        own = sorted(rnd.sample(range(86400, 2 * 86400), rnd.choice([1, 5, 300])))
        late = sorted(rnd.sample(range(2 * 86400, 2 * 86400 + within), min(within, rnd.choice([0, 1, 40]))))
        rest = rnd.choice([None, 2 * 86400 + within + rnd.randrange(5)])
        found = probes.day_hops(within).func(pd.Series([1]), pd.Series([np.array(own)]), pd.Series([np.array(late, "int64")]), pd.Series([rest]))
        got = dict(zip(found["s"][0], found["target"][0]))
        assert set(own[:1]) | {s for s in own if s < 86400 + within} <= set(got)
        for s, target in got.items():
            way = chain([x for x in own + late + ([] if rest is None else [rest]) if x >= s], within)
            assert target == next((x for x in way if x >= 2 * 86400), probes.NOWHERE)
        assert list(probes.day_chain(within).func(pd.Series([np.array(own)]), pd.Series([own[0]]))[0]) == chain(own, within)


def test_chains_of_all_keys_before_and_after_1970(spark):
    rnd = random.Random(5)
    rows = [(i, i % 3, "disk" if i % 7 else None, rnd.randrange(-200000, 300000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id BIGINT, incident_id BIGINT, name STRING, s BIGINT").select("id", "incident_id", "name", F.timestamp_seconds("s").alias("at"))
    want = set()
    for k in range(3):
        first = {}
        for i, incident, name, s in rows:
            if incident == k and name:
                first.setdefault(s, i)
        want |= {first[s] for s in chain(sorted(first), 500)}
    got = probes.suppress_repeats(df, 500).collect()
    assert len(got) == len(rows) and {r["id"] for r in got if r["accepted"]} == want


def test_packed_probes_are_the_most_that_fit_and_are_sized_once(spark):
    rnd = random.Random(3)
    words = ["a", "日本", "12 34", "  x", "", "line\nline", "ﾊ!", "-- 7\n\n"]
    rows = [(k, 10 * k + i, rnd.choice(["disk", "logins", "memory", None]), "h", "ok", " ".join(rnd.choices(words, k=rnd.randrange(20))), rnd.choice([None, "exit"]), 5,
             rnd.choice(["initial", "operator"])) for k in range(40) for i in range(rnd.randrange(1, 9))]
    df = spark.createDataFrame(rows, "analysis_id BIGINT, id BIGINT, name STRING, target STRING, status STRING, output STRING, error STRING, duration_ms INT, trigger STRING")
    for budget in (40, 90, 400):
        packed = prompts.pack_probes(df, ["disk"], budget)
        assert "sequence(size(b" not in packed._jdf.queryExecution().optimizedPlan().toString()
        got = {r["analysis_id"]: r for r in packed.withColumn("size", estimate_tokens(F.col("text"))).collect()}
        blocks = {}
        for r in prompts.probe_blocks(df).collect():
            blocks.setdefault(r["analysis_id"], []).append((2 if r["trigger"] == "operator" else 0 if r["name"] == "disk" else 1, r["size"], r["id"], r["block"]))
        texts = []
        for k, found in blocks.items():
            order = sorted(found, key=lambda b: (-b[0], b[1], -b[2]))
            for n in range(min(len(order), budget // 5), 0, -1):
                gone = len(order) - n
                text = (f"({gone} probes left out for the budget)\n" if gone else "") + "\n\n".join(b[3] for b in sorted(order[:n], key=lambda b: b[2]) if b[3] is not None)
                texts.append((k, n, text))
        sizes = {(r["k"], r["n"]): (r["size"], r["t"]) for r in spark.createDataFrame(texts, "k BIGINT, n INT, t STRING").withColumn("size", estimate_tokens(F.col("t"))).collect()}
        for k, r in got.items():
            kept = max((n for (key, n), (size, _) in sizes.items() if key == k and size <= budget), default=0)
            assert (r["kept"], r["kept"] + r["dropped"]) == (kept, len(blocks[k]))
            assert not kept or r["text"] == sizes[k, kept][1]


def test_a_call_of_the_stream_takes_no_turn_per_alert():
    step = test_lifecycle.started()
    turns = []
    store = type(step.alerts.iterator.__self__.parts if hasattr(step.alerts, "parts") else step.alerts)
    counted = {name: getattr(store, name) for name in ("updateValue", "getValue", "containsKey")}
    try:
        for name, fn in counted.items():
            setattr(store, name, lambda self, *a, fn=fn: turns.append(1) or fn(self, *a))
        test_lifecycle.fed(step, [("alert", str(i), i, i, None, 3, "l") for i in range(5000)])
    finally:
        for name, fn in counted.items():
            setattr(store, name, fn)
    assert len(turns) < 1000 and len(list(step.alerts.iterator())) == 5000
    assert lifecycle.BUCKETS < 1000


def test_a_capture_is_read_once(spark):
    texts = ['[{"a":1},2,null]', "[]", "{}", "no json", None, "", "[3]"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "origin STRING, value STRING").repartition(2)
    rows = normalize.explode_captures(df)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("regexp_replace(value") == 1
    got = {(r["origin"], r["pos"]): r["t"] for r in rows.select("origin", "pos", F.to_json("item").alias("t")).collect()}
    assert got == {("0", 0): '{"a":1}', ("0", 1): "2", ("0", 2): "null", ("2", 0): None, ("3", 0): None, ("4", 0): None, ("5", 0): None, ("6", 0): "3"}
