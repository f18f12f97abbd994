"""Repeated passages by sparse suffix arrays.

A passage of ``least`` words that stands in two different texts is found through the suffixes that start at minimiser
positions: of every ``least - gram + 1`` neighbouring word ``gram``-s the first smallest by hash is retained, so texts retain
the same position of a shared window. Retained suffixes whose gram stands in one text only are left out. The rest is sorted by
its next ``least`` words across the cluster; the longest match of a suffix to the right is the one with a neighbour, and from
it the windows are extended to the left as far as they have their minimum there. An exact check of these windows by hash
follows, so a match needs left and right in the same other text. The result is exact for 64-bit hashes of words.

Copies of one text are one text here; a text that several rows hold is repeated as a whole. Defined cases: a null or short text
has no passage; a null doc_id is carried; a repetition inside one text alone does not count; rows of one doc_id get their own rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.bpe_prefix import slices
from alertloom.llm.common import stored, words

LEAST = 50
GRAM = 10
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the words per text. Each distinct word is hashed once."""
    cut = pc.ascii_split_whitespace(texts)
    flat = cut.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.empty(0, bool)
    per_text = np.diff(np.concatenate([[0], np.cumsum(real)])[cut.offsets.to_numpy()])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return (table[coded.indices.to_numpy()] if len(table) else np.empty(0, np.uint64)), per_text


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` neighbouring values, modulo 2 ** 64."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    powers = np.multiply.accumulate(np.full(width, BASE, np.uint64))
    out = np.zeros(n - width + 1, np.uint64)
    done, span, part = 0, 1, values.copy()  # part: hashes of ``span`` values; widths add up by their binary digits
    while True:
        if width & span:
            out += part[done:done + len(out)] * (powers[done - 1] if done else np.uint64(1))
            done += span
        if done == width:
            return mix(out)
        part = part[:len(part) - span] + part[span:] * powers[span - 1]
        span *= 2


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of every ``width`` neighbours."""
    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)
    span, part = 1, np.arange(len(values))
    n = len(values) - width + 1
    while span * 2 <= width:
        part = better(part[:len(part) - span], part[span:])
        span *= 2
    return better(part[:n], part[width - span:width - span + n])


def minimisers(hashes: np.ndarray, sizes: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Retained positions of a batch of texts, their gram hashes, and the first and last window that has its minimum there.

    A window's minimum depends on its own words only, so equal windows of any two texts retain the same place of them."""
    if len(hashes) < least:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    grams = windows(hashes, gram)
    place = leftmost_least(grams, least - gram + 1)
    start = np.arange(len(place))
    inside = np.repeat(np.cumsum(sizes), sizes)[:len(place)] - start >= least  # the window stays in its text
    place, start = place[inside], start[inside]
    new = np.nonzero(np.diff(place, prepend=-1))[0]
    return place[new], grams[place[new]], start[new], start[np.append(new[1:], len(place)) - 1] if len(new) else start


def retained(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """``gram, t1, pos`` of the retained positions of ``texts(t1, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            hashes, sizes = word_hashes(batch.column(1))
            at, grams, _, _ = minimisers(hashes, sizes, least, gram)
            starts = np.cumsum(sizes) - sizes
            row = np.searchsorted(np.cumsum(sizes), at, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), batch.column(0).take(pa.array(row)),
                                              pa.array((at - starts[row]).astype(np.int32))], names=["gram", "t1", "pos"])
    return texts.mapInArrow(run, "gram long, t1 long, pos int")


def suffixes(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """``t1, pos, ahead, wins`` for every position of ``pos`` of ``texts(t1, text, pos)``: the next words by 32-bit hashes, and the
    hashes of the windows that have their minimum here, from the first on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            hashes, sizes = word_hashes(batch.column(1))
            at, _, left, last = minimisers(hashes, sizes, least, gram)
            starts = np.cumsum(sizes) - sizes
            row = np.searchsorted(np.cumsum(sizes), at, side="right")
            asked = batch.column(2)
            wanted = np.asarray(asked.flatten(), np.int64) + np.repeat(starts, np.diff(asked.offsets.to_numpy()))
            pick = np.isin(at, wanted)
            at, left, last, row = at[pick], left[pick], last[pick], row[pick]
            wins = windows(hashes, least).view(np.int64)
            short = np.concatenate([(hashes >> np.uint64(32)).astype(np.uint32), np.zeros(least, np.uint32)])
            for lo in range(0, len(at), 20_000):
                a, b, c, r = (x[lo:lo + 20_000] for x in (at, left, last, row))
                ends = (starts + sizes)[r]
                ahead = short[a[:, None] + np.arange(least)]
                ahead[a[:, None] + np.arange(least) >= ends[:, None]] = 0
                n = c - b + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                where = np.repeat(b - offsets[:-1], n) + np.arange(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(r)), pa.array((a - starts[r]).astype(np.int32)), pa.array((b - starts[r]).astype(np.int32)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * least), len(a), [None, pa.py_buffer(np.ascontiguousarray(ahead.astype(">u4")))]).cast(pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(wins[where] if len(where) else np.empty(0, np.int64)))],
                    names=["t1", "pos", "first", "ahead", "wins"])
    return texts.mapInArrow(run, "t1 long, pos int, first int, ahead binary, wins array<long>")


def extended(sorted_rows: DataFrame, least: int) -> DataFrame:
    """``win, t1, start``: the windows that the neighbours in the sorted suffixes leave possible. A suffix at the edge of a task
    has an unknown neighbour and keeps all its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: pa.RecordBatch, reach: np.ndarray) -> pa.RecordBatch:
            wins, first, pos = rows.column(4), np.asarray(rows.column(2), np.int64), np.asarray(rows.column(1), np.int64)
            n = np.diff(wins.offsets.to_numpy())
            start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ok = start + least <= np.repeat(pos + reach, n)
            flat = wins.flatten().to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([pa.array(flat[ok]), rows.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)[ok])),
                                               pa.array(start[ok].astype(np.int32))], names=["win", "t1", "start"])
        held, before = None, None  # the last row waits for its neighbour below
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            data = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint32).reshape(-1, least)
            match = np.cumprod(data[1:] == data[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            up = np.concatenate([[least if before is None else before], match])
            down = np.concatenate([match, [least]])
            reach = np.maximum(up, down)
            if len(rows) > 1:
                yield emit(rows.slice(0, len(rows) - 1), reach[:-1])
            held, before = rows.slice(len(rows) - 1), int(up[-1])
        if held is not None:
            yield emit(held, np.array([least]))
    return sorted_rows.select("t1", "pos", "first", "ahead", "wins").mapInArrow(run, "win long, t1 long, start int")


def passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``doc_id, start, end, n_words`` (word positions, end exclusive): the words of each document that a window of ``least`` words
    covers which stands in another document too, as maximal runs."""
    if not 0 < gram <= least:
        raise ValueError("a gram must be from 1 to the least words long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), text.alias("text"))
    found = stored(retained(keyed.select("t1", "text"), least, gram), "grams")
    shared = found.groupBy("gram").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a <> b").select("gram")
    places = found.join(shared, "gram").groupBy("t1").agg(F.collect_set("pos").alias("pos"))
    sizes = stored(keyed.select("doc_id", "t1", F.size(words(F.col("text"))).cast("long").alias("n_words")), "sizes")
    kinds = sizes.groupBy("t1").agg(F.min(F.struct("doc_id")).alias("one"), F.count("*").alias("rows"))
    asked = stored(places.join(kinds, "t1").select("t1", "one", "pos"), "places")
    texts = keyed.join(asked, "t1").where(F.col("doc_id").eqNullSafe(F.col("one.doc_id"))).select("t1", "text", "pos")
    rows = stored(suffixes(texts, least, gram), "suffixes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "ahead", "t1", "pos").sortWithinPartitions("ahead", "t1", "pos")
    wins = stored(extended(ordered, least), "windows")
    twice = wins.groupBy("win").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a <> b").select("win")
    hits = wins.join(twice, "win").select("t1", "start").distinct()
    order = W.partitionBy("t1").orderBy("start")
    fresh = (F.col("start") > F.lag("start").over(order) + least).cast("int")
    runs = (hits.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy("t1", "run").agg(F.min("start").cast("long").alias("start"), (F.max("start") + least).cast("long").alias("end")))
    single = kinds.where("rows = 1").select("t1")
    parts = sizes.join(runs.join(single, "t1").select("t1", "start", "end"), "t1").select("doc_id", "start", "end", "n_words")
    whole = sizes.join(kinds.where("rows > 1").select("t1"), "t1").where(F.col("n_words") >= least).select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), "n_words")
    return parts.unionByName(whole)
