"""MinHash near-dedup by fast similarity sketching.

A set of shingles is thrown into the bins of its sketch round by round. In the first ``size`` rounds each element picks a bin by
its hash, in the next ``size`` rounds all elements go to the bin of the round's number, so every bin is full in the end. A bin
keeps its least value, earlier rounds first, and rounds end when no bin is empty. Equal bins of two sets are as likely as the
sets are similar, with the concentration of independent draws, at a cost near the size of the set.

Bins are banded: sets that agree in a whole band are candidates. Equal sets are folded before. A set is first compared with
the first member of each of its buckets, on the full sets. Buckets whose members are not all connected by that are finished by
all pairs of unconnected members: as rows where a bucket holds at most ``SMALL`` sets, otherwise in tiles of bounded weight,
two a task, by products of incidence matrices, from which only spanning links come out. No bucket is cut short.

Chance: a pair at exactly the threshold 0.8 shares no band with probability (1 - 0.8 ** 5) ** 48 = 5e-9, less above it.
Shingles are held as 64-bit hashes and texts found again by 128 bits.

Defined cases: a text without words, null or empty, has an empty set, is linked with nothing and stays; fewer words than a
shingle make one shingle; repeated rows are copies of each other; a null doc_id is labelled with its class and names it only if
all members are null; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import components, stored

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BANDS, ROWS = 48, 5
SMALL = 32
TILE_SETS, TILE_WEIGHT = 256, 1 << 18
SLOTS = 23
WORK = 4096
U = np.uint64


def shingles(text: str | None, width: int = 2, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, U)
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(len(found) - width + 1, 1)
    hashed = xxhash.xxh64_intdigest
    spans = zip((ends - sizes)[:n].tolist(), ends[min(width, len(found)) - 1:].tolist())
    return np.unique(np.fromiter((hashed(joined[a:b], seed) for a, b in spans), U, n))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sketch(values: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The filled bins of a set that is not empty: round number above, value below."""
    bins = np.full(size, np.iinfo(U).max, U)
    at_once = max(WORK // len(values), 1)
    for first in range(0, 2 * size, at_once):
        rounds = np.arange(first, min(first + at_once, 2 * size), dtype=U)[:, None]
        drawn = mixed(values[None, :] ^ mixed(rounds + U(0x9E3779B97F4A7C15)))
        place = np.where(rounds < U(size), ((drawn >> U(40)) * U(size)) >> U(24), rounds - U(size)).astype(np.int64)
        np.minimum.at(bins, place.ravel(), ((rounds << U(40)) | (drawn & U((1 << 40) - 1))).ravel())
        if (bins != np.iinfo(U).max).all():
            break
    return bins


def band_keys(bins: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key per band, different from band to band."""
    keys = mixed(np.arange(1, bands + 1, dtype=U))
    for column in bins.reshape(bands, -1).T:
        keys = mixed(keys ^ column) + U(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def text_keys() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def prints(docs: DataFrame, width: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, t1, t2`` (hashes of the text), ``digest`` (of the set), ``n`` (its size) and ``keys`` of the bands of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column(3):
                values = shingles(text.as_py(), width)
                digests.append(xxhash.xxh128_digest(values.tobytes()))
                sizes.append(len(values))
                keys.append(band_keys(sketch(values, bands * rows), bands) if len(values) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t1", "t2", "digest", "n", "keys"])
    return docs.select(F.col("doc_id").cast("long"), *text_keys(), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, t1 long, t2 long, digest binary, n long, keys array<long>")


def alike(a: Column, b: Column, percent: int) -> Column:
    """False for set sizes that can not reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, values`` for ``wanted(node, t1, t2)``: the shingle hashes, read again from the texts. A bitmap of 2 ** SLOTS bits,
    whatever the input, holds back texts that are not wanted before any is shuffled."""
    bit = f"cast(pmod(t1, {1 << SLOTS}) % 64 as int)"
    page = F.shiftright(F.pmod(F.col("t1"), F.lit(1 << SLOTS)), 6).alias("page")
    bits = stored(wanted.groupBy(page).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits")), "bits")
    texts = docs.select(*text_keys(), F.col("text").cast("string").alias("text")).withColumn("page", page).join(F.broadcast(bits), "page").where(
        F.expr(f"getbit(bits, {bit}) = 1"))
    once = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(text.as_py(), width).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["node", "values"])
    return once.join(wanted, ["t1", "t2"]).select("node", "text").mapInArrow(run, "node long, values array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = one.values.to_numpy(), two.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    left, right = (sets.select(F.col("node").alias(side), F.col("values").alias(f"v{side}")) for side in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def spanning(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Label of each of ``size`` places when places ``i`` and ``j`` are linked: the least of its component."""
    label = np.arange(size)
    while True:
        x, y = label[i], label[j]
        open_ = x != y
        if not open_.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (label[label] != label).any():
            label = label[label]


def overlaps(one: list[np.ndarray], two: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of incidence matrices over blocks of shared values."""
    flat, flat2 = np.concatenate(one), np.concatenate(two)
    shared = np.intersect1d(flat, flat2)
    counts = np.zeros((len(one), len(two)), np.float32)

    def marks(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        known = at < len(shared)
        known[known] = shared[at[known]] == flat[known]
        order = np.argsort(at[known], kind="stable")
        return at[known][order], owner[known][order]
    (at, owner), (at2, owner2) = marks(flat, one), marks(flat2, two)
    for low in range(0, len(shared), block):
        tables = []
        for places, owners, n in ((at, owner, len(one)), (at2, owner2, len(two))):
            cut = slice(*np.searchsorted(places, (low, low + block)))
            table = np.zeros((n, min(block, len(shared) - low)), np.float32)
            table[owners[cut], places[cut] - low] = 1
            tables.append(table)
        counts += tables[0] @ tables[1].T
    return counts


def tile_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links ``a, b`` of all similar pairs inside each group of ``members(grp, node, n, label)``. Size classes grow by
    the reciprocal of the similarity, so that similar sets stand in one class or in neighbours."""
    sized = members.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    directory = stored(sized.groupBy("grp", "cls").agg(F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_WEIGHT)).cast("int").alias("subs")), "classes")
    tiles = stored(sized.join(directory, ["grp", "cls"]).join(sets, "node").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
                   .groupBy("grp", "cls", "sub").agg(F.collect_list(F.struct("node", "label", "values")).alias("tile")), "tiles")
    near = directory.select("grp", F.col("cls"), "subs", F.explode(F.array(F.col("cls"), F.col("cls") + 1)).alias("cls2"))
    other = directory.select("grp", F.col("cls").alias("cls2"), F.col("subs").alias("subs2"))
    pairs = (near.join(other, ["grp", "cls2"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
             .withColumn("sub2", F.explode(F.sequence(F.lit(0), F.col("subs2") - 1))).where("cls <> cls2 OR sub <= sub2"))
    left = tiles.withColumnRenamed("tile", "one")
    right = tiles.select("grp", F.col("cls").alias("cls2"), F.col("sub").alias("sub2"), F.col("tile").alias("two"))

    def links(one: pa.StructScalar, two: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        nodes, labels, sets_ = [], [], []
        for tile in (one.values, two.values):
            nodes.append(tile.field("node").to_numpy())
            labels.append(tile.field("label").to_numpy())
            sets_.append([v.values.to_numpy() for v in tile.field("values")])
        if len(np.unique(np.concatenate(labels))) == 1:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = overlaps(*sets_).astype(np.int64)
        whole = np.array([len(v) for v in sets_[0]])[:, None] + np.array([len(v) for v in sets_[1]])[None, :] - both
        i, j = np.nonzero((100 * both >= percent * whole) & (labels[0][:, None] != labels[1][None, :]))
        every = np.concatenate(nodes)
        label = spanning(i, j + len(nodes[0]), len(every))
        moved = np.nonzero(label != np.arange(len(every)))[0]
        return every[moved], every[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                x, y = links(one, two)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
    return (pairs.join(left, ["grp", "cls", "sub"]).join(right, ["grp", "cls2", "sub2"]).select("one", "two").mapInArrow(run, "a long, b long"))


def set_links(groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the distinct sets ``groups(node, n, t1, t2, keys)`` that connect every similar pair which shares a band."""
    rows = groups.select("node", "n", F.explode("keys").alias("key"))
    busy = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("top"), F.count("*").alias("held")).where("held > 1")
    members = stored(rows.join(busy.select("key", F.col("top.node").alias("leader"), F.col("top.n").alias("n_leader"), "held"), "key"), "members")
    wanted = groups.join(members.select("node").distinct(), "node", "left_semi").select("node", "t1", "t2")
    sets = stored(sets_of(docs, wanted, width), "sets")
    star = members.where("node <> leader").where(alike(F.col("n"), F.col("n_leader"), percent)).select(
        F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(verified(star, sets, percent), "links")
    roots = components(first).select("node", F.col("root").alias("label"))
    labelled = stored(members.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rest = stored(labelled.join(open_, "key"), "rest")
    few = rest.where(F.col("held") <= SMALL)
    one, two = (few.select("key", "leader", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "label")]) for side in "ab")
    pairs = one.join(two, ["key", "leader"]).where("node_a < node_b AND label_a <> label_b AND node_a <> leader").where(
        alike(F.col("n_a"), F.col("n_b"), percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    second = stored(verified(pairs, sets, percent), "links")
    many = rest.where(F.col("held") > SMALL)
    grouped = components(many.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    crowd = many.select("node", "n", "label").distinct().join(grouped.withColumnRenamed("root", "grp"), "node")
    third = stored(tile_links(stored(crowd, "crowd"), sets, percent), "links")
    return first.unionByName(second).unionByName(third)


def near_copies(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    every = stored(prints(docs, width, bands, rows), "prints")
    groups = stored(every.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "first", "t.t1", "t.t2", "n", "keys"), "groups")
    roots = components(set_links(groups, docs, width, percent))
    named = groups.select("node", "digest", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("digest", "component_id")
    found = every.where("n > 0").join(labels, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
