"""Bursts of incidents and outages of the root host.

Only start times matter for grouping, so incidents are counted per second first; every later step works on seconds.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.times import seconds
from alertloom.operators.scans import density, newest_cover
from alertloom.session import checkpoint_dir
from alertloom.settings import GROUP, Settings

STATUS_OPEN = "problem_status = 'open'"


def group_candidates(incidents: DataFrame) -> DataFrame:
    """Incidents that may still join a group."""
    return incidents.where((F.col("source") != GROUP) & F.col("group_id").isNull()
                           & F.col("analysis_state").isin("held", "queued") & (F.col("priority") == 0))


def _per_second(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(seconds(F.col("started_at")).alias("s")).agg(F.count("*").cast("bigint").alias("n"))


def window_density(candidates: DataFrame, window: int = 300) -> DataFrame:
    """How many candidates start in ``[start, start + window]``, for every second in which one starts."""
    counted = density(_per_second(candidates), window)
    return counted.select(F.timestamp_seconds("s").alias("started_at"), F.col("n").alias("starts"), "within")


def largest_storm(candidates: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Members of the densest window, the earliest on a tie; empty below the storm count."""
    w = cfg.storm_window
    best = (density(_per_second(candidates), w).where(F.col("within") >= cfg.storm_count)
            .orderBy(F.desc("within"), "s").limit(1))
    # one row; its two time buckets make the membership test an equi join
    spans = best.select(F.col("s").alias("first"), F.explode(F.array(F.floor(F.col("s") / w), F.floor(F.col("s") / w) + 1))
                        .alias("bucket"))
    tagged = candidates.withColumn("s", seconds(F.col("started_at"))).withColumn("bucket", F.floor(F.col("s") / w))
    return (tagged.join(spans, "bucket").where((F.col("s") >= F.col("first")) & (F.col("s") <= F.col("first") + w))
            .select("id", "host", "severity", "started_at"))


def certain_bursts(s: np.ndarray, n: np.ndarray, window: int, count: int, low: int | None, high: int | None) -> tuple[list[tuple[int, ...]], list[int]]:
    """Bursts ``(start, starts in the window, from, to)`` that are sure from the seconds ``s`` with ``n`` starts each, and the
    windows that stay in doubt.

    ``low`` and ``high`` are the borders of what is known, None where nothing lies beyond. Windows are taken as in the whole
    history, densest first, the earliest on a tie. What a window beyond a border may take is in doubt; a window that touches
    seconds in doubt is not chosen, and what it might take is in doubt from then on. A window's count can only fall, so one
    look at it when its turn comes is enough.
    """
    sums = np.concatenate([[0], np.cumsum(n)])
    ends = np.searchsorted(s, s + window, "right")
    first = sums[ends] - sums[:-1]
    alive, doubt = np.ones(len(s), bool), np.zeros(len(s), bool)
    if low is not None:
        doubt[:np.searchsorted(s, low + 2 * window, "right")] = True
    if high is not None:
        doubt[np.searchsorted(s, high - 2 * window):] = True
    turns = [(-int(c), k) for k, c in enumerate(first) if c >= count]
    heapq.heapify(turns)
    found, open_ = [], []
    while turns:
        told, k = heapq.heappop(turns)
        if not alive[k]:
            continue
        inside = alive[k:ends[k]]
        now = int(n[k:ends[k]][inside].sum())
        if now < count:
            continue
        if now != -told:
            heapq.heappush(turns, (-now, k))
            continue
        start, last = int(s[k]), int(s[k:ends[k]][inside][-1])
        near = slice(*np.searchsorted(s, (start - window, start + 2 * window + 1)))
        if doubt[near].any():
            doubt[near] = True
            open_.append(start)
            continue
        found.append((start, now, start - window, last + window))
        alive[slice(*np.searchsorted(s, (start - window, last + window + 1)))] = False
    return found, open_


def _bursts(per_second: DataFrame, window: int, count: int, block: int) -> DataFrame | None:
    """Seconds with the start of the burst that takes them.

    A gap longer than the window ends all influence, so most of a history falls into islands. A block of time is one task,
    which also reads the seconds ``margin`` around it and settles all but what depends on seconds further away: the densest
    window left is always settled by its block. A round settles a chain of influence up to the next border, and a border has
    room for a few bursts only, so the rounds are bounded by the blocks of the longest island, whatever the number of alerts.
    """
    spark, margin = per_second.sparkSession, 8 * window
    own = F.floor(F.col("s") / block)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["block"].iloc[0])
        rows = rows.sort_values("s")
        s, n = rows["s"].to_numpy(), rows["n"].to_numpy()
        low, high = at * block - margin, (at + 1) * block + margin
        found, open_ = certain_bursts(s, n, window, count, low if rows["before"].any() else None, high if rows["after"].any() else None)
        mine = [(at, *burst) for burst in found if burst[0] // block == at]
        undecided = any(start // block == at for start in open_)
        return pd.DataFrame([*mine, *([(at, None, None, None, None)] if undecided else [])], columns=["block", "burst", "n", "lo", "hi"]).astype("Int64")
    left, taken = per_second, []
    while True:
        # what lies just beyond the margins says whether the island goes on there
        spread = left.withColumn("own", own).withColumn("block", F.explode(F.array(own - 1, own, own + 1))).where(
            F.col("s").between(F.col("block") * block - margin - window, (F.col("block") + 1) * block + margin + window - 1))
        marked = spread.withColumns({"before": F.col("s") < F.col("block") * block - margin, "after": F.col("s") >= (F.col("block") + 1) * block + margin})
        flags = marked.select("block", "s", "n", "before", "after")
        told = flags.groupBy("block").applyInPandas(settle, "block long, burst long, n long, lo long, hi long").checkpoint()
        spans = told.where("burst IS NOT NULL")
        hit = newest_cover(left.select("s"), spans.select("lo", "hi", F.struct("n", (-F.col("burst")).alias("o")).alias("rank")), window).where("best IS NOT NULL").select(
            "s", (-F.col("best.o")).alias("burst")).checkpoint()
        if not hit.isEmpty():
            taken.append(hit)
        rest = told.where("burst IS NULL").select(F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("own")).distinct()
        if rest.isEmpty():
            break
        left = left.join(hit.select("s"), "s", "left_anti").withColumn("own", own).join(rest, "own", "left_semi").select("s", "n").checkpoint()
    out = None
    for part in taken:
        out = part if out is None else out.unionByName(part)
    return out


def storm_groups(candidates: DataFrame, cfg: Settings = Settings(), checkpoints: str | None = None, block: int = 1 << 20) -> DataFrame:
    """All bursts of a history. The densest window takes all that starts within ``window`` of its members; what is left
    is looked at again until no window holds ``storm_count``.

    Candidates are folded to seconds; ``block`` seconds are settled by one task. Rounds are cut by reliable checkpoints.
    """
    if block < 16 * cfg.storm_window:
        raise ValueError("a block must be 16 windows long or more")
    checkpoint_dir(candidates.sparkSession, checkpoints)
    counted = _per_second(candidates).checkpoint()
    found = _bursts(counted, cfg.storm_window, cfg.storm_count, block)
    tagged = candidates.withColumn("s", seconds(F.col("started_at")))
    if found is None:
        return tagged.where("false").select("id", F.col("s").alias("burst"), "host", "severity", "started_at")
    return tagged.join(found, "s").select("id", "burst", "host", "severity", "started_at")


def open_roots(incidents: DataFrame, root_host: str) -> DataFrame:
    """Open availability incidents of the root host."""
    return incidents.where((F.col("source") != GROUP) & (F.col("host") == root_host) & F.col("availability") & F.expr(STATUS_OPEN))


def root_outage_groups(candidates: DataFrame, roots: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Candidates near an open root outage. A candidate goes to the newest outage within the window; an outage with
    fewer than two candidates around it makes no group."""
    w = cfg.storm_window
    cand = _per_second(candidates)
    at = roots.groupBy(seconds(F.col("started_at")).alias("s")).agg(F.max("id").alias("root_id"))
    both = (cand.select("s", "n", F.lit(None).cast("bigint").alias("root_id"))
            .unionByName(at.select("s", F.lit(0).cast("bigint").alias("n"), "root_id"))
            .groupBy("s").agg(F.sum("n").alias("n"), F.max("root_id").alias("root_id")))
    own = F.floor(F.col("s") / w)
    spread = both.withColumn("own", own).withColumn("bucket", F.explode(F.array(own - 1, own, own + 1)))
    around = W.partitionBy("bucket").orderBy("s").rangeBetween(-w, w)
    counted = spread.withColumn("near", F.sum("n").over(around)).where("bucket = own")
    roots_ok = counted.where("root_id IS NOT NULL AND near >= 2").select(
        (F.col("s") - w).alias("lo"), (F.col("s") + w).alias("hi"), F.struct(F.col("s"), F.col("root_id")).alias("rank"))
    placed = newest_cover(cand.select("s"), roots_ok, w).where("best IS NOT NULL").select("s", F.col("best.root_id").alias("root_id"))
    members = candidates.withColumn("s", seconds(F.col("started_at"))).join(placed, "s")
    enough = members.groupBy("root_id").agg(F.count("*").alias("members")).where("members >= 2")
    return members.join(enough, "root_id").select("root_id", "id", "host", "started_at", "members")


def member_spans(incidents: DataFrame, window: int) -> DataFrame:
    """First and last start of the members of every group, widened by the window."""
    s = seconds(F.col("started_at"))
    return (incidents.where(F.col("group_id").isNotNull()).groupBy("group_id")
            .agg((F.min(s) - window).alias("lo"), (F.max(s) + window).alias("hi")))


def mark_root_down(spans: DataFrame, roots: DataFrame, window: int = 300) -> DataFrame:
    """``spans(group_id, lo, hi)`` with whether an open root outage starts inside. Roots are reduced to the first and the
    last of each time bucket, which is all a span longer than a bucket can ask for."""
    low, high = F.floor(F.col("lo") / window), F.floor(F.col("hi") / window)
    per_bucket = roots.groupBy(F.floor(seconds(F.col("started_at")) / window).alias("bucket")).agg(
        F.min(seconds(F.col("started_at"))).alias("first"), F.max(seconds(F.col("started_at"))).alias("last"))
    pieces = spans.select("group_id", "lo", "hi", F.explode(F.sequence(low, high)).alias("bucket"))
    down = (pieces.join(per_bucket, "bucket").where((F.col("last") >= F.col("lo")) & (F.col("first") <= F.col("hi")))
            .select("group_id").distinct().withColumn("root_down", F.lit(True)))
    return spans.join(down, "group_id", "left").withColumn("root_down", F.coalesce("root_down", F.lit(False)))


def join_waiting_group(candidates: DataFrame, spans: DataFrame, window: int = 300) -> DataFrame:
    """Candidates that start inside the span of a waiting group join the newest such group."""
    points = candidates.select(seconds(F.col("started_at")).alias("s")).distinct()
    placed = newest_cover(points, spans.select("lo", "hi", F.col("group_id").alias("rank")), window)
    return (candidates.withColumn("s", seconds(F.col("started_at")))
            .join(placed.where("best IS NOT NULL"), "s").select("id", F.col("best").alias("group_id")))


def group_rollup(incidents: DataFrame, now: Column) -> DataFrame:
    """State of every group from its members. Member ids stay in the incidents; the report lists them on demand."""
    return (incidents.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(
        F.count("*").alias("members"), F.max("severity").alias("severity"), F.min("started_at").alias("started_at"),
        F.max("last_occurrence_at").alias("last_occurrence_at"), F.count_if(F.expr(STATUS_OPEN)).alias("open_members"),
        F.count_if(F.col("problem_status") == "oneshot").alias("oneshot_members"),
        F.max("resolved_at").alias("latest"), F.min("id").alias("first_id"))
        .withColumn("problem_status", F.when(F.col("open_members") > 0, "open")
                    .when(F.col("oneshot_members") == F.col("members"), "oneshot").otherwise("resolved"))
        .withColumn("resolved_at", F.when(F.col("problem_status") == "resolved", F.coalesce("latest", now)))
        .drop("open_members", "oneshot_members", "latest"))


def group_titles(groups: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Host and title of a group; the title stays as it was once the analysis has begun."""
    fresh = F.when(F.col("root_down"), F.concat(F.lit(f"Chain after an outage of {cfg.root_host} ("),
                                                F.col("members").cast("string"), F.lit(")"))) \
        .otherwise(F.concat(F.lit("Burst ("), F.col("members").cast("string"), F.lit(")")))
    waits = F.col("analysis_state").isin("held", "queued")
    return groups.withColumn("host", F.when(F.col("root_down"), cfg.root_host).otherwise("several")) \
        .withColumn("title", F.when(waits, fresh).otherwise(F.col("title")))


DERIVED = ("members", "severity", "started_at", "last_occurrence_at", "problem_status", "resolved_at")


def changed_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups whose derived values differ from what is stored, with the lifecycle event the change means."""
    before = old.select("group_id", *[F.col(c).alias(f"old_{c}") for c in DERIVED])
    same = F.lit(True)
    for c in DERIVED:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    moved = ~F.col("problem_status").eqNullSafe(F.col("old_problem_status"))
    event = F.when(moved & (F.col("problem_status") == "resolved"), "resolved") \
        .when(moved & (F.col("problem_status") == "open"), "reopened")
    return new.join(before, "group_id").where(~same).select("group_id", *DERIVED, event.alias("event"))
