"""Helpers shared by the operators: written intermediate tables, let-bindings, word splitting and connected components."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import checkpoint_dir

SPACE = "[\\x20\\x09-\\x0D]+"


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """The rows, written once to the shared folder: lineage ends here, and a lost executor does not cost the work above."""
    path = folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def aside(docs: DataFrame) -> tuple[list[Column], list[Column]]:
    """The columns of ``docs`` under names of their own, ``c0`` and so on, and the way back: helper columns that begin with an
    underscore stand beside them whatever the input's names are."""
    there = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return there, [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]


def words(text: Column) -> Column:
    """Words between the six ASCII spaces; an empty array for null."""
    return F.filter(F.coalesce(F.split(text, SPACE, -1), F.array().cast("array<string>")), lambda w: w != "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge list, root the smallest node of its component.

    Alternating large-star and small-star: each round hangs the neighbours of a node under its smallest neighbour, by a
    partial minimum and a join that adaptive execution can split, so that a hub never meets one task. Every round is
    written; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = stored(edges.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
