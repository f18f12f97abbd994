"""Bursts of a whole history in blocks against the choice one by one."""
from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators import grouping
from alertloom.settings import Settings

CFG = Settings(storm_window=10, storm_count=3)


def one_by_one(seconds, window, count):
    left, burst = dict(seconds), {}
    while True:
        windows = [(-sum(n for t, n in left.items() if s <= t <= s + window), s) for s in left]
        if not windows or -min(windows)[0] < count:
            return burst
        start = min(windows)[1]
        last = max(t for t in left if t <= start + window)
        for t in [t for t in left if start - window <= t <= last + window]:
            burst[t] = start
            del left[t]


def frame(spark, seconds):
    rows = [(k * 1000 + i, "h", 1, s) for k, (s, n) in enumerate(seconds.items()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, host string, severity int, s long").select("id", "host", "severity", F.timestamp_seconds("s").alias("started_at"))


def found(df):
    return {r.s: r.burst for r in df.select(F.unix_timestamp("started_at").alias("s"), "burst").distinct().collect()}


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "waves"])
def test_blocks_give_the_choice_one_by_one(spark, kind):
    rnd = random.Random(kind)
    if kind == "random":
        seconds = {rnd.randrange(900): rnd.randrange(1, 5) for _ in range(300)}
    else:
        height = {"rising": lambda k: k + 3, "falling": lambda k: 200 - k, "waves": lambda k: 3 + abs(k % 40 - 20)}[kind]
        seconds = {8 * k: height(k) for k in range(110)}
    got = found(grouping.storm_groups(frame(spark, seconds), CFG, block=160))
    assert got == one_by_one(seconds, 10, 3)


def test_a_long_chain_ends_within_few_rounds(spark, monkeypatch):
    """10,000 windows, each denser than the one before: found from the end, one after the other."""
    n = 10_000
    per_second = spark.range(n).select((F.col("id") * 250).alias("s"), (F.col("id") + 5).alias("n"))
    rounds, cover = [], grouping.newest_cover
    monkeypatch.setattr(grouping, "newest_cover", lambda *a: rounds.append(1) or cover(*a))
    grouping.checkpoint_dir(spark)
    got = {r.s: r.burst for r in grouping._bursts(per_second.checkpoint(), 300, 5, 1 << 20).collect()}
    # a window holds two seconds and takes the one before it as well
    assert got == {250 * k: 250 * max(n - 2 - 3 * ((n - 1 - k) // 3), 0) for k in range(n)}
    assert len(rounds) <= 4  # three blocks of time


def test_doubt_never_settles_what_the_rest_could_change():
    rnd = random.Random(1)
    for _ in range(200):
        seconds = {rnd.randrange(400): rnd.randrange(1, 6) for _ in range(rnd.randrange(20, 160))}
        whole = one_by_one(seconds, 10, 4)
        low, high = 100, 300
        inner = sorted((s, n) for s, n in seconds.items() if low - 10 <= s < high + 10)
        if not inner:
            continue
        sure, _ = grouping.certain_bursts(*map(np.array, zip(*inner)), 10, 4, low, high)
        for start, _, lo, hi in sure:
            assert whole[start] == start
            assert all(whole.get(s) is not None for s, _ in inner if lo <= s <= hi)
        taken = {s: min(((-c, a) for a, c, lo, hi in sure if lo <= s <= hi), default=None) for s, _ in inner}
        assert all(whole[s] == best[1] for s, best in taken.items() if best)
