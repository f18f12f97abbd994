"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks. Block j of a source with the exact rational weight w has release floor(j / w) and deadline
ceil((j + 1) / w); in every slot the released block with the earliest deadline runs. In any prefix of a phase a source is less
than one block away from its share by the weights themselves, which are never rounded. When a source runs out, the weights of
the rest are scaled up and a new phase begins; no row is dropped or repeated.

Slots are dealt in ranges that tasks schedule apart. At the border t of two ranges each source has run floor(t w) blocks or one
more; ``border`` says which, from t and the weights alone: blocks astride the border by earliest deadline, as far as the slots
after their releases hold them. The fluid schedule shows that such a choice exists, and the greedy one leaves the range
after it the loosest deadlines. A range is at least two blocks of the lightest source long, so no block is astride two borders.

Defined cases: a null source is a source of its own; sources without a given weight get the smallest given one; sources of weight
zero follow all others; repeated rows and null ids keep their own places; the last block of a source may be short; an empty table
gives an empty result. ``most_sources`` raises an error beyond it, None takes any number: the driver sees their totals, and one
border costs the square of their number.
"""
from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import aside, stored

PERIOD = 1024
BLOCK = 8
MOST_SOURCES = 256


class Phase(NamedTuple):
    """Slots from ``slot`` in which the sources share by ``shares`` of ``sum(shares)``, each from its block ``done``."""
    sources: list[str]
    shares: list[int]
    done: list[int]
    slot: int
    size: int


def earliest(waiting: list[tuple[int, int, object, int]], begin: int, end: int) -> Iterator[tuple[object, int, int]]:
    """``(source, block, slot)`` from ``(release, deadline, source, block)``, one in every slot."""
    waiting, ready, at = sorted(waiting), [], 0
    for slot in range(begin, end):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, s, k = waiting[at]
            heapq.heappush(ready, (deadline, s, k))
            at += 1
        deadline, s, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a block missed its deadline")
        yield s, k, slot


def window(k: int, share: int, total: int) -> tuple[int, int]:
    """Release and deadline of block ``k``."""
    return k * total // share, -(-(k + 1) * total // share)


def earliest_deadlines(shares: dict[str, int], period: int) -> list[tuple[str, int, int, int, int]]:
    """``(source, k, slot, release, deadline)`` of one period of whole shares."""
    waiting = [(*window(k, a, period), s, k) for s, a in shares.items() for k in range(a)]
    return [(s, k, slot, *window(k, shares[s], period)) for s, k, slot in earliest(waiting, 0, period)]


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    found = {s: int(x * scale) for s, x in exact.items()}
    least = math.gcd(*found.values())
    return {s: n // least for s, n in found.items()}


def border(shares: list[int], t: int) -> list[int]:
    """Blocks that each source has run before slot ``t``."""
    total = sum(shares)
    a = np.array(shares, np.int64 if (t + 2) * total < 2 ** 62 else object)
    base = t * a // total
    more, astride = t - int(base.sum()), np.nonzero(t * a % total)[0]
    if not more:
        return base.tolist()
    release, deadline = base[astride] * total // a[astride], -(-(base[astride] + 1) * total // a[astride])
    points = sorted(set(release.tolist()))
    # free slots from each release on, beside the blocks that end before the border
    room = np.array([t - p - int(np.maximum(base - -(-p * a // total), 0).sum()) for p in points], np.int64)
    found = base.tolist()
    for d, r, x in sorted(zip(deadline.tolist(), release.tolist(), astride.tolist())):
        k = bisect_right(points, r)
        if more and room[:k].min() > 0:
            room[:k] -= 1
            found[x] += 1
            more -= 1
    return found


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[Phase]:
    """Phases until every block is dealt: each ends where a source runs out."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    left, slot, found = dict(blocks), 0, []
    while left:
        now = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)
        sources, shares = [*now], [*whole(now).values()]
        total = sum(shares)
        size = min(left[s] * total // a for s, a in zip(sources, shares))
        found.append(Phase(sources, shares, [blocks[s] - left[s] for s in sources], slot, size))
        for s, n in zip(sources, border(shares, size)):
            left[s] -= n
            if not left[s]:
                del left[s]
        slot += size
    return found


def ranges(phase: Phase, period: int) -> int:
    """Number of ranges of a phase, the last one the longest."""
    return max(1, phase.size // length(phase, period))


def length(phase: Phase, period: int) -> int:
    return max(period, 2 * (sum(phase.shares) // min(phase.shares) + 2))


def dealt(phase: Phase, nth: int, period: int) -> list[tuple[str, int, int, int, int]]:
    """``(source, block, slot, release, deadline)`` of one range."""
    step, total = length(phase, period), sum(phase.shares)
    begin = nth * step
    end = phase.size if nth + 1 == ranges(phase, period) else begin + step
    waiting = []
    for x, (a, low, high) in enumerate(zip(phase.shares, border(phase.shares, begin), border(phase.shares, end))):
        for k in range(low, high):
            release, deadline = window(k, a, total)
            waiting.append((max(release, begin), min(deadline, end), x, k))
    return [(phase.sources[x], phase.done[x] + k, phase.slot + slot, *(phase.slot + t for t in window(k, phase.shares[x], total)))
            for x, k, slot in earliest(waiting, begin, end)]


def slots(spark: SparkSession, found: list[Phase], period: int) -> DataFrame:
    """``_source, _block, _slot, _release, _deadline`` of every block; each range is scheduled by itself."""
    ends = list(accumulate(ranges(p, period) for p in found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth in batch.column(0).to_pylist():
                k = bisect_right(ends, nth)
                rows = dealt(found[k], nth - (ends[k - 1] if k else 0), period)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)],
                                                 names=["_source", "_block", "_slot", "_release", "_deadline"])
    n = ends[-1] if ends else 0
    tasks = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, n, 1, tasks).mapInArrow(run, "_source string, _block long, _slot long, _release long, _deadline long")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``_rank`` from 0 inside their ``_source``: ranges of the sorted rows are counted, never one source at once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "_source", *order).sortWithinPartitions("_source", *order)
    held = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    task = F.shiftright("_at", 33).alias("_task")
    counts = held.groupBy("_source", task).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = W.partitionBy("_source").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_source", "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"))
    # one row per task and source that meet: fewer than tasks + sources
    placed = held.withColumn("_task", task).join(F.broadcast(starts), ["_source", "_task"])
    return placed.withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_task")


def tempered(counts: dict[str, int], alpha: float) -> dict[str, float]:
    """Weights in proportion to a power of the rows: 1 keeps the sizes, 0 makes sources equal."""
    return {s: n ** alpha for s, n in counts.items()}


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """Every row of ``docs`` with ``_mix``: block, slot, release, deadline (in slots) and the place inside the block. It takes the
    place of an input column of that name."""
    docs = docs.drop("_mix")
    return scheduled(docs, weights, **options).select(*aside(docs)[1], "_mix")


def scheduled(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, block: int = BLOCK,
              period: int = PERIOD, source: str = "source", order: str = "doc_id", most_sources: int | None = MOST_SOURCES) -> DataFrame:
    """``schedule`` with the input's columns under the names of ``aside``. ``period`` is the least length of the ranges that
    tasks schedule apart; the bounds do not depend on it."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    held = numbered(docs.select(*aside(docs)[0], key.alias("_source")), [F.col(f"c{docs.columns.index(order)}")])
    held = held.withColumn("_block", F.expr(f"_rank div {block}"))
    sizes = held.groupBy("_source").agg((F.max("_rank") + 1).alias("n"))
    sizes = (sizes if most_sources is None else sizes.limit(most_sources + 1)).collect()
    if most_sources is not None and len(sizes) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    counts = {r["_source"]: r["n"] for r in sorted(sizes)}
    if weights is None:
        given = tempered(counts, alpha)
    else:
        named = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
        given = {s: named.get(s, min(named.values(), default=1.0)) for s in counts}
    table = stored(slots(docs.sparkSession, phases({s: -(-n // block) for s, n in counts.items()}, given), period), "slots")
    placed = held.join(table, ["_source", "_block"])
    mix = F.struct(F.col("_block").alias("block"), *[F.col(f"_{c}").alias(c) for c in ("slot", "release", "deadline")],
                   F.pmod("_rank", F.lit(block)).alias("place")).alias("_mix")
    return placed.select(*[f"c{i}" for i in range(len(docs.columns))], mix)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, in the order of their slots across files: ``places`` reads it from the written files."""
    placed = scheduled(docs, **{"most_sources": None} | options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (placed.repartitionByRange(n, "_mix.slot", "_mix.place").sortWithinPartitions("_mix.slot", "_mix.place").select(*aside(docs)[1]))


def places(docs: DataFrame, name: str = "place") -> DataFrame:
    """Rows read from Parquet files that Spark wrote, with their place from 0: by number of the part file, its name, and the row
    in it; an input column of that name goes. However the reader packs and splits the files, this is the order in which ``mixed`` left the rows."""
    docs = docs.drop(name)
    there, back = aside(docs)
    told = docs.metadataColumn("_metadata")
    held = docs.select(*there, told["file_name"].alias("_file"), told["row_index"].alias("_row"))
    counts = held.groupBy("_file").agg(F.count("*").alias("_n"))
    # one row per file
    order = W.orderBy(F.regexp_extract("_file", "^part-([0-9]+)", 1).cast("long"), "_file").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    return held.join(F.broadcast(starts), "_file").select(*back, (F.col("_start") + F.col("_row")).alias(name))
