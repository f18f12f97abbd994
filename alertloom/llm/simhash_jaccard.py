"""Near copies at a stated Jaccard similarity of word shingles: wide SimHash candidates, verified exactly.

Every distinct set of shingle hashes (ASCII lower case, ``shingle`` words, one shingle for a shorter text) gets a SimHash of
four 64-bit words. At Jaccard 0.8 the cosine is 0.889 at least, so a bit differs with probability 0.152 at most: 9.7 of 64 and
38.8 of 256 bits are expected. ``FIRST`` and ``WHOLE`` lie about 4.5 deviations above, so a pair is missed about once in 10^4
or less. A set is at least ``similarity`` as large as the set it is so similar to: distinct sets are laid out in cells by size, and
tiles of a cell meet those of the same cell and of the next; no other pair can be a link. Links gather candidate groups; inside
a group all pairs within the radii are compared by their exact Jaccard similarity, tile by tile, unless already joined.

Defined cases: texts without words are one group; rows with a null doc_id link nothing; rows that repeat a doc_id join all
sets of that doc_id. Sets are named by the XXH64 of their sorted hashes. Work: comparisons grow with the square of the distinct
sets of about equal size. A cell or a group is cut into a few tiles whatever its size, and into more only where a tile would
outgrow a task, so a set is sent a bounded number of times up to there, and once per ``BOUND`` sets of its cell beyond.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import components, stored
from alertloom.llm.simhash_tiles import CHUNK, LOWER

WORDS = 4
FIRST, WHOLE = 22, 64
#: Sizes of a cell differ by less than this factor; similar sets lie in one cell or in the next.
STEP = 1.25
#: The most members and the most hashes of a tile, and into how many tiles a cell and a group are cut below that.
BOUND, BOUND_HASHES = 1 << 16, 1 << 20
CELL_PARTS, GROUP_PARTS = 4, 16
#: Odd factors that derive the further words of a fingerprint from one hash.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingles(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    hashed = xxhash.xxh64_intdigest
    n = max(len(found) - shingle + 1, 1) if found else 0
    return np.unique(np.fromiter((hashed(b" ".join(found[i:i + shingle]), seed) for i in range(n)), np.uint64, n))


def sketch(hashes: np.ndarray) -> list[int]:
    """SimHash of a set, in words of 64 bits."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK]
        mixed = [part]
        for factor in FACTORS:
            x = (part ^ (part >> np.uint64(29))) * np.uint64(factor)
            mixed.append((x ^ (x >> np.uint64(32))) * np.uint64(FACTORS[0]) ^ (x >> np.uint64(27)))
        bits = np.unpackbits(np.stack(mixed, axis=1).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int, seed: int, sets: bool = False) -> DataFrame:
    """``doc_id, node, size, f0..f3`` of every row, or ``node, hashes`` with ``sets``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), shingle, seed) for t in batch.column(1)]
            node = pa.array([xxhash.xxh64_intdigest(h.tobytes(), seed) for h in own], pa.uint64()).view(pa.int64())
            if sets:
                yield pa.RecordBatch.from_arrays([node, pa.array([h.view(np.int64) for h in own], pa.list_(pa.int64()))], names=["node", "hashes"])
                continue
            f = np.array([sketch(h) for h in own], np.int64).reshape(-1, WORDS)
            size = pa.array([len(h) for h in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), node, size, *[pa.array(f[:, k]) for k in range(WORDS)]],
                                             names=["doc_id", "node", "size", *[f"f{k}" for k in range(WORDS)]])
    columns = "node long, hashes array<long>" if sets else "doc_id long, node long, size long, " + ", ".join(f"f{k} long" for k in range(WORDS))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` of the pairs of two arrays of fingerprints that lie within the radii."""
    i, j = np.nonzero(np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) <= FIRST)
    whole = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64)
    return i[whole <= WHOLE], j[whole <= WHOLE]


class Groups:
    """Union by smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Tile:
    """The members of one tile, smallest sets first."""

    def __init__(self, members: pa.StructArray):
        def values(name: str) -> np.ndarray:
            return members.field(name).to_numpy(zero_copy_only=False)
        order = np.argsort(values("size"), kind="stable")
        self.size, self.node = values("size")[order], values("node")[order]
        self.prints = np.stack([values(f"f{k}") for k in range(WORDS)], axis=1).view(np.uint64)[order]
        self.order, self.members = order, members

    def hashes(self) -> list[np.ndarray]:
        column = self.members.field("hashes")
        return [column[k].values.to_numpy() for k in self.order.tolist()]


def candidates(a: Tile, b: Tile, similarity: float, rows: int = 256, wide: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two tiles that are within the radii and of sizes that allow ``similarity``; of one tile with itself, each
    pair once. A block of ``rows`` meets the sizes in its reach, ``wide`` of them at a time."""
    least, reach = similarity * b.size, similarity * a.size
    for at in range(0, len(a.size), rows):
        upto = min(at + rows, len(a.size))
        begin = at if a is b else int(np.searchsorted(b.size, reach[at]))
        end = int(np.searchsorted(least, a.size[upto - 1], "right"))
        for to in range(begin, end, wide):
            i, j = close(a.prints[at:upto], b.prints[to:min(to + wide, end)])
            i, j = i + at, j + to
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def spanned(a: Tile, b: Tile, similarity: float) -> list[tuple[int, int]]:
    """Spanning links of the candidates between two tiles."""
    shift = 0 if a is b else len(a.size)
    label = np.arange(shift + len(b.size))
    for i, j in candidates(a, b, similarity):
        j = j + shift
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
    nodes = a.node if a is b else np.concatenate([a.node, b.node])
    other = np.nonzero(label != np.arange(len(label)))[0]
    return list(zip(nodes[other].tolist(), nodes[label[other]].tolist()))


def verified(a: Tile, b: Tile, similarity: float) -> list[tuple[int, int]]:
    """Spanning links between two tiles of the candidates whose sets are so similar."""
    shift = 0 if a is b else len(a.size)
    groups, links, one = Groups(shift + len(b.size)), [], a.hashes()
    two = one if a is b else b.hashes()
    for places in candidates(a, b, similarity):
        for i, j in zip(*(x.tolist() for x in places)):
            if groups.root(i) == groups.root(j + shift):
                continue
            x, y = one[i], two[j]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common < similarity * (len(x) + len(y) - common):
                continue
            groups.join(i, j + shift)
            links.append((int(a.node[i]), int(b.node[j])))
    return links


def tile_pairs(members: DataFrame, own: list[str], weight: Column, tile: int, most: int, bound: int, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of tiles that can hold links inside a ``root`` of ``members(root, cell, node, size, own)``; ``b`` is null for a tile
    with itself.

    A cell gets a tile per ``tile`` members, ``most`` at most, and more only where a tile would hold more than ``bound`` by ``weight``.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    subs = members.groupBy("root", "cell").agg(F.greatest(F.ceil(F.sum(weight) / bound), F.least(F.ceil(F.count("*") / tile), F.lit(most)), F.lit(1))
                                               .cast("int").alias("subs"))
    tiles = stored(members.join(subs, ["root", "cell"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
                   .groupBy("root", "cell", "sub").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n"),
                                                       F.collect_list(F.struct("node", "size", *own)).alias("m")), "tiles")
    # what says which tiles meet is one short row per tile; the border of a cell may be off by a rounding
    left = tiles.select("root", F.col("cell").alias("a_cell"), F.col("sub").alias("a_sub"), "high", "n", F.explode(F.sequence("cell", F.col("cell") + 2)).alias("b_cell"))
    right = tiles.select("root", F.col("cell").alias("b_cell"), F.col("sub").alias("b_sub"), "low")
    same = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_sub") == F.col("b_sub"))
    apart = (F.col("a_cell") < F.col("b_cell")) | (F.col("a_sub") < F.col("b_sub"))
    key = ["root", "a_cell", "a_sub", "b_cell", "b_sub"]
    pairs = stored(left.join(right, ["root", "b_cell"]).where((same & (F.col("n") > 1)) | apart)
                   .where(F.col("high") >= F.col("low") * F.lit(float(similarity))).select(*key, same.alias("same")), "pairs")

    def side(s: str) -> DataFrame:
        placed = tiles.select("root", F.col("cell").alias(f"{s}_cell"), F.col("sub").alias(f"{s}_sub"), F.col("m").alias(s))
        met = pairs if s == "a" else pairs.where("NOT same")
        return met.join(placed, ["root", f"{s}_cell", f"{s}_sub"]).select(*key, s).repartition(n, *key)
    return side("a").join(side("b"), key, "left").select("a", "b")


def tile_links(pairs: DataFrame, links: Callable[[Tile, Tile, float], list[tuple[int, int]]], similarity: float) -> DataFrame:
    """Links ``(a, b)`` that ``links`` finds between the tiles of every pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                one = Tile(batch.column(0)[row].values)
                found += links(one, Tile(batch.column(1)[row].values) if batch.column(1)[row].is_valid else one, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return pairs.mapInArrow(run, "a long, b long")


def keep_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, seed: int = 42, tile: int = 4096) -> DataFrame:
    """The documents that are the first of their group of near copies; a null doc_id stays."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("the radii hold for similarities from 0.8 to 1")
    known = docs.where("doc_id IS NOT NULL")
    own = [f"f{k}" for k in range(WORDS)]
    prints = stored(sketches(known, shingle, seed), "prints")
    nodes = stored(prints.groupBy("node", "size", *own).agg(F.min("doc_id").alias("doc")), "nodes")
    cell = F.floor(F.log(STEP, F.greatest("size", F.lit(1)))).cast("int").alias("cell")
    near = components(tile_links(tile_pairs(nodes.select(F.lit(0).alias("root"), cell, "node", "size", *own), own, F.lit(1), tile, CELL_PARTS, BOUND, similarity),
                                 spanned, similarity))
    members = stored(nodes.join(near, "node"), "members")
    # the sets of candidates only, from one document that holds each
    texts = known.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(sketches(texts, shingle, seed, sets=True).dropDuplicates(["node"]), "sets")
    candidate = members.join(sets, "node").select("root", F.lit(0).alias("cell"), "node", "size", "hashes", *own)
    links = tile_links(tile_pairs(candidate, [*own, "hashes"], F.col("size"), 256, GROUP_PARTS, BOUND_HASHES, similarity), verified, similarity)
    # rows that repeat a doc_id hold its sets together
    held = prints.select("doc_id", "node").distinct()
    first = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("doc_id", "a")
    own_links = held.join(first, "doc_id").select("a", F.col("node").alias("b"))
    roots = components(links.unionByName(own_links))
    named = nodes.select("node", "doc").join(roots, "node", "left").select("doc", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min("doc").alias("doc_id")).select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
