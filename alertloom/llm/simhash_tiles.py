"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are laid out in tiles by the population counts of their parts. Two fingerprints within the radius
differ by at most the radius in the sum of these counts' differences, so tile pairs beyond it are never formed. The rest is
compared whole with exclusive or and bit counts in numpy. A tile pair returns a spanning forest of its links, not the links.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; repeated rows share their
fingerprint; a null doc_id is carried along and never names a component unless all its members are null; other columns are
ignored. Work: the comparisons grow with the square of the distinct fingerprints, cut by ``parts`` (README has figures).
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import components, stored

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of one text, unsigned."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(found) - shingle + 1, 1)
    last = ends[min(shingle, len(found)) - 1:]
    hashed = xxhash.xxh64_intdigest
    totals = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at:min(at + CHUNK, n)].tolist(), last[at:at + CHUNK].tolist())
        values = np.array([hashed(joined[a:b], seed) for a, b in spans], dtype="<u8")
        totals += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * totals > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def cell(fp: Column, parts: int) -> list[Column]:
    """Population counts of the parts of a fingerprint."""
    width = 64 // parts
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask).cast("long"))) for k in range(parts)]


def packed(counts: list[Column]) -> Column:
    code = F.lit(0).cast("long")
    for c in counts:
        code = code * 256 + c.cast("long")
    return code


def half_ball(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Offsets between cells that can hold a link, one of each mirrored pair."""
    span = range(-radius, radius + 1)
    near = [d for d in product(span, repeat=parts) if sum(map(abs, d)) <= radius]
    return sorted(d for d in near if d >= (0,) * parts)


def forest(a: np.ndarray, b: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two tiles: every pair within the radius is connected by them."""
    both = np.concatenate([a, b])
    label = np.arange(len(both))
    for at in range(0, len(a), block):
        i, j = np.nonzero(np.bitwise_count(a[at:at + block, None] ^ b[None, :]) <= radius)
        i, j = i + at, j + len(a)
        while True:
            x, y = label[i], label[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    other = np.nonzero((label != np.arange(len(both))) & (both != both[label]))[0]
    return both[other], both[label[other]]


def links(prints: DataFrame, radius: int = 3, parts: int = 4, tile: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``prints(fp)`` that connect all pairs within the radius."""
    if 64 % parts or radius < 0:
        raise ValueError("parts must divide 64 and the radius must not be negative")
    sized = prints.select("fp", packed(cell(F.col("fp"), parts)).alias("cell"))
    # at most (64 / parts + 1) ** parts cells, whatever the input
    directory = stored(sized.groupBy("cell").agg(F.count("*").alias("n")).select(
        "cell", F.ceil(F.col("n") / tile).cast("int").alias("subs")), "cells")
    tiles = stored(sized.join(F.broadcast(directory), "cell")
                   .select("cell", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int").alias("sub"), "fp")
                   .groupBy("cell", "sub").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = half_ball(parts, radius)
    codes = F.array(*[F.lit(sum(d * 256 ** (parts - 1 - k) for k, d in enumerate(step))).cast("long") for step in steps])
    near = directory.select("cell", "subs", F.explode(codes).alias("step"))
    other = directory.select(F.col("cell").alias("to"), F.col("subs").alias("to_subs"))
    pairs = (near.withColumn("to", F.col("cell") + F.col("step")).join(other, "to")
             .select("cell", "to", "subs", "to_subs", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
             .select("cell", "to", "sub", F.explode(F.sequence(F.lit(0), F.col("to_subs") - 1)).alias("to_sub"))
             .where("cell <> to OR sub <= to_sub"))
    left = tiles.select("cell", "sub", F.col("fps").alias("a"))
    right = tiles.select(F.col("cell").alias("to"), F.col("sub").alias("to_sub"), F.col("fps").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(0), batch.column(1)
            found = [forest(one[k].values.to_numpy().view(np.uint64), two[k].values.to_numpy().view(np.uint64), radius)
                     for k in range(batch.num_rows)]
            xs, ys = (np.concatenate([f[side] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(xs), pa.array(ys)], names=["a", "b"])
    return (pairs.join(left, ["cell", "sub"]).join(right, ["to", "to_sub"]).select("a", "b")
            .mapInArrow(run, "a long, b long"))


def near_copies(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, parts: int = 4, tile: int = 4096) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (the smallest doc_id that links reach)."""
    prints = stored(fingerprints(docs, shingle, seed), "prints")
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    roots = components(links(groups.select("fp"), radius, parts, tile))
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the first of their component; rows that repeat a doc_id stay together, a null doc_id stays."""
    kept = near_copies(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
