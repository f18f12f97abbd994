"""Ordered scans that never put a whole key into one task.

A running value per key is split in two: a window inside each ``(key, chunk of time)`` and a carry taken over the few
chunk totals of the key. Spans are matched to points through time buckets, with one row per second and bucket, so a
crowded bucket costs at most its number of seconds.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows with ``columns`` computed here, once per row: what filters on them reads values. Otherwise a filter is moved
    below the columns and below a repartition, and works them out again for each place that it reads them."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_settled")).select(*[
        F.col(f"_settled.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def join_by_count(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``values(key, n, ...)``, one row per key with the number of rows that have it.

    Keys of more than a thousandth of the rows, a thousand at most, are broadcast; the other rows are dealt by key. So no task gets
    all rows of a frequent key, however few keys there are.
    """
    kept = [c for c in values.columns if c not in (key, "n")]
    values = values.persist()
    tagged = values.join(F.broadcast(values.agg(F.sum("n").alias("_all")))).select(key, F.struct(*kept).alias("_v"), (F.col("n") * 1000 > F.col("_all")).alias("_often"))
    often = tagged.where("_often").select(key, F.col("_v").alias("_often"))
    others = tagged.where("NOT _often").select(F.col(key).alias("_key"), F.lit(0).cast("bigint").alias("_deal"), F.col("_v").alias("_other"))
    found = rows.join(F.broadcast(often), key, "left")
    done = F.col("_often").isNotNull() | F.col(key).isNull()
    found = found.withColumns({"_key": F.when(~done, F.col(key)), "_deal": F.when(done, F.pmod(F.xxhash64(*rows.columns), F.lit(1000))).otherwise(0).cast("bigint")})
    both = found.join(others, ["_key", "_deal"], "left").withColumn("_v", F.coalesce("_often", "_other"))
    return both.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in kept])


def carry(df: DataFrame, keys: list[str], chunk: str, totals: dict[str, tuple[Column, Callable[[str], Column]]]
          ) -> DataFrame:
    """Add what all earlier chunks of the same key amount to. ``totals`` maps a new column to its aggregate inside a
    chunk and to the function that combines chunk totals (``F.sum``, ``F.max``)."""
    per_chunk = df.groupBy(*keys, chunk).agg(*[agg.alias(name) for name, (agg, _) in totals.items()])
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, chunk, *[fn(name).over(before).alias(name) for name, (_, fn) in totals.items()])
    return df.join(carried, [*keys, chunk])


def carry_state(df: DataFrame, keys: list[str], chunk: str, state: dict[str, Column], steps: list[dict[str, Callable[[WindowSpec], Column]]], keep: list[str]
                ) -> DataFrame:
    """Add to every row what the chunks before its own amount to, where carried values depend on each other.

    ``state`` are the aggregates of a chunk, computed once. ``steps`` then add columns to the small table of chunks, one
    after the other: a step sees the columns of those before it and, through the window it is given, the earlier chunks of
    the key. The ``keep`` columns are joined back once, however many steps there are.
    """
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    per_chunk = df.groupBy(*keys, chunk).agg(*[agg.alias(name) for name, agg in state.items()])
    for step in steps:
        per_chunk = per_chunk.withColumns({name: fn(before) for name, fn in step.items()})
    return df.join(per_chunk.select(*keys, chunk, *keep), [*keys, chunk])


def density(seconds: DataFrame, window: int) -> DataFrame:
    """``seconds(s, n)`` with the number of starts in ``[s, s + window]`` as ``within`` and the last of them."""
    own = F.floor(F.col("s") / window)
    doubled = seconds.withColumn("bucket", F.explode(F.array(own, own - 1))).withColumn("own", own)
    ahead = W.partitionBy("bucket").orderBy("s").rangeBetween(0, window)
    return (doubled.select("s", "n", "own", "bucket", F.sum("n").over(ahead).alias("within"),
                           F.max("s").over(ahead).alias("last"))
            .where("bucket = own").drop("own", "bucket"))


def newest_cover(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """For every second ``points(s)`` the largest ``rank`` of ``spans(lo, hi, rank)`` that contains it, else null.

    Every span must be at least ``width`` long. A span is cut at bucket borders; its first and last piece are compared
    by running maxima inside the bucket, the pieces between cover their bucket whole.
    """
    low, high = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    pieces = (spans.select("lo", "hi", "rank", low.alias("a"), high.alias("b"), F.explode(F.sequence(low, high)).alias("bucket"))
              .select("bucket", "rank",
                      F.when(F.col("bucket") == F.col("a"), "from").when(F.col("bucket") == F.col("b"), "until")
                      .otherwise("all").alias("kind"),
                      F.when(F.col("bucket") == F.col("a"), F.col("lo")).when(F.col("bucket") == F.col("b"), F.col("hi"))
                      .otherwise(F.col("bucket") * width).alias("s"))
              .groupBy("bucket", "kind", "s").agg(F.max("rank").alias("rank")))
    marks = points.select(F.floor(F.col("s") / width).alias("bucket"), F.lit("point").alias("kind"), "s",
                          F.lit(None).cast(spans.schema["rank"].dataType).alias("rank")).distinct()
    both = marks.unionByName(pieces)
    until_now = W.partitionBy("bucket").orderBy("s").rangeBetween(W.unboundedPreceding, 0)
    from_now = W.partitionBy("bucket").orderBy("s").rangeBetween(0, W.unboundedFollowing)
    whole = W.partitionBy("bucket").orderBy("s").rangeBetween(W.unboundedPreceding, W.unboundedFollowing)

    def best(kind: str, over) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("rank"))).over(over)
    found = both.select("kind", "s", F.greatest(best("from", until_now), best("until", from_now), best("all", whole))
                        .alias("best"))
    return found.where("kind = 'point'").select("s", "best")


def global_rank(df: DataFrame, order: list[Column], coarse: list[Column], fine: list[Column], name: str = "rank"
                ) -> DataFrame:
    """Position (from 0) of every row in the total order ``coarse, fine, order``.

    ``coarse`` must have few distinct values (days and grades), ``fine`` narrows them; only counts of these are ordered
    across the cluster, rows are ordered inside one ``(coarse, fine)`` cell.
    """
    c = [f"_c{i}" for i in range(len(coarse))]
    f = [f"_f{i}" for i in range(len(fine))]
    tagged = df.select("*", *[e.alias(n) for e, n in zip(coarse, c)], *[e.alias(n) for e, n in zip(fine, f)])
    cells = tagged.groupBy(*c, *f).agg(F.count("*").alias("_n"))
    top = cells.groupBy(*c).agg(F.sum("_n").alias("_m"))
    # the coarse table holds one row per grade and day, so ordering it in one place is cheap whatever the input size
    top = top.select(*c, F.coalesce(F.sum("_m").over(W.partitionBy(F.lit(0)).orderBy(*c).rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = cells.select(*c, *f, F.coalesce(F.sum("_n").over(W.partitionBy(*c).orderBy(*f).rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)).alias("_inside"))
    placed = tagged.join(inner, c + f).join(F.broadcast(top), c)
    rank = F.col("_before") + F.col("_inside") + F.row_number().over(W.partitionBy(*c, *f).orderBy(*order)) - 1
    return placed.withColumn(name, rank.cast("bigint")).drop(*c, *f, "_before", "_inside")
