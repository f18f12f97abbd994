"""Spelling variant grouping by pivotal grams.

Words are counted in tasks and folded once over the corpus. Two words are near when one code point is inserted, deleted or
replaced. Such an edit harms at most two neighbouring bigrams, so of a word's three rarest bigrams (its prefix, with all places
of the third one) two do not overlap: the pivots, chosen by dynamic programming for the least frequency. One pivot survives in
the other word. It stands in that word's prefix when that prefix reaches at least as far in the order of rarity; the comparison
of the last ranks says which of the two words asks with its pivots. The edit lies on one side of the surviving pivot, so its
place counted from the other end is the same in both words, and one half of the edited side is intact too. Length, place and up
to ``CONTEXT`` letters of the intact parts are the key of the join; pairs are verified by edit distance inside it, so only near
pairs become rows. Nothing is capped.

A word's form is its most frequent near word if that is ``ratio`` times as frequent, and forms are followed to their root by
pointer doubling: counts grow by ``ratio`` at each step, which bounds the rounds.

Defined cases: a null or empty text holds no words; a null doc_id reads as the empty text in the checksum; repeated rows are
counted again; ties between forms go to the smallest word in code-point order; an empty table gives no rows; other columns are
ignored. A run of any length is one word, and its keys are linear in its length.
"""
from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER = {c: c + 32 for c in range(65, 91)}
CONTEXT = 8
HELD = 200_000
LONG = 64  # longer words are joined by their hash and their texts compared afterwards, as they have many keys
SPOILT = 31


def spoilt(doc: object, run: str, every: int = SPOILT) -> str:
    """The run as it is read: where the checksum of document and run is a multiple of ``every``, one code point is missing."""
    code = zlib.crc32(run.encode("utf-8"), zlib.crc32(f"{'' if doc is None else doc}:".encode()))
    if code % every:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least: int = 7, copies: int = 2, every: int = SPOILT) -> DataFrame:
    """``word, n`` of all words of ``least`` code points that occur ``copies`` times or more."""
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def emit(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, n in Counter(pattern.findall(text.as_py() or "")).items():
                    word = spoilt(doc, found.translate(UPPER), every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield emit(held)
                    held = Counter()
        yield emit(held)
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= copies)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and number of words of every bigram, rare ones first. The alphabet bounds it: at most 90 * 90 entries."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2))))
    found = words.where(F.length("word") > 1).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r.gram: (k, r.n) for k, r in enumerate(sorted(found, key=lambda r: (r.n, r.gram)))}


def pivots(places: list[tuple[int, int]], picks: int = 2, width: int = 2) -> list[int]:
    """Starts of ``picks`` grams that do not overlap with the least total cost, of ``(start, cost)`` by rising start."""
    best: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] * (len(places) + 1)]
    before = [0] * len(places)  # how many grams end before this one starts
    for k, (start, _) in enumerate(places):
        low = before[k - 1] if k else 0
        while places[low][0] + width <= start:
            low += 1
        before[k] = low
    for _ in range(picks):
        row: list[tuple[float, tuple[int, ...]]] = [(math.inf, ())]
        for k, (start, cost) in enumerate(places):
            rest, chosen = best[-1][before[k]]
            row.append(min(row[-1], (rest + cost, (*chosen, start))))
        best.append(row)
    return list(best[-1][-1][1])


def left_keys(word: str, at: int, size: int) -> list[str]:
    """Keys of a gram at ``at`` whose left side is intact, in a word of ``size`` letters: what follows the gram is cut in half
    there, and one half is intact too."""
    rest = size - at - 2
    half = rest // 2
    name = f"L{at}:{size}:{word[max(at - CONTEXT, 0):at + 2]}"
    return [f"{name}|{word[at + 2:at + 2 + half][:CONTEXT]}", f"{name}-{word[len(word) - rest + half:][-CONTEXT:]}"]


def right_keys(word: str, end: int, size: int) -> list[str]:
    """The same of a gram that starts ``end`` letters before the end, whose right side is intact."""
    at, rest = len(word) - end, size - end
    half = rest // 2
    name = f"R{end}:{size}:{word[at:at + 2 + CONTEXT]}"
    return [f"{name}|{word[:half][:CONTEXT]}", *([f"{name}-{word[at - rest + half:at][-CONTEXT:]}"] if at >= rest - half else [])]


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[str], list[str]]:
    """Last rank of the prefix, keys of its grams, and keys that the pivots ask for: an edit right of the first pivot leaves
    it and its left side, any other edit leaves the second pivot and its right side."""
    size = len(word)
    ranked = [(order[word[i:i + 2]], i) for i in range(size - 1)]
    last = heapq.nsmallest(3, (r for (r, _), _ in ranked))[-1]
    prefix = [(i, n) for (r, n), i in ranked if r <= last]
    held = [key for i, _ in prefix for key in left_keys(word, i, size) + right_keys(word, size - i, size)]
    first, second = pivots(prefix)
    asked = [key for other in (size - 1, size, size + 1) if other >= first + 2 for key in left_keys(word, first, other)]
    asked += [key for other in (size - 1, size, size + 1) if other >= size - second for key in right_keys(word, size - second, other)]
    return last, held, asked


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a, n_a, b, n_b`` (a < b) of ``words(word, n)`` at exactly one edit, each once. Words need four code points."""
    order = gram_order(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signature(w, order) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([m[0] for m in made], pa.int32()), *[
                pa.array([m[k] for m in made], pa.list_(pa.string())) for k in (1, 2)]], names=["word", "n", "last", "held", "asked"])
    signed = stored(words.select("word", "n").mapInArrow(run, "word string, n long, last int, held array<string>, asked array<string>"), "grams")
    short = F.when(F.length("word") <= LONG, F.col("word"))
    code = F.when(F.length("word") > LONG, F.xxhash64("word"))
    rows = signed.select(short.alias("word"), code.alias("id"), "n", "last", "held", "asked")
    held = rows.select("word", "id", "n", "last", F.explode("held").alias("text")).select("word", "id", "n", "last", F.xxhash64("text").alias("key"))
    asked = rows.select(F.col("word").alias("word2"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("last").alias("last2"), F.explode("asked").alias("text")).select(
        "word2", "id2", "n2", "last2", F.xxhash64("text").alias("key"))
    both = F.col("word").isNotNull() & F.col("word2").isNotNull()
    other = ~F.col("word").eqNullSafe(F.col("word2")) | ~F.col("id").eqNullSafe(F.col("id2"))
    met = stored(held.join(asked, "key").where(F.col("last2") <= F.col("last")).where(F.when(both, F.levenshtein("word", "word2", 1) == 1).otherwise(other))
                 .select("word", "id", "n", "word2", "id2", "n2").distinct(), "met")
    texts = signed.where(F.length("word") > LONG).select(F.xxhash64("word").alias("id"), F.col("word").alias("text"))
    far = (met.where(~both).join(texts, "id", "left").join(texts.select(F.col("id").alias("id2"), F.col("text").alias("text2")), "id2", "left")
           .select(F.coalesce("word", "text").alias("word"), "n", F.coalesce("word2", "text2").alias("word2"), "n2").where(F.levenshtein("word", "word2", 1) == 1))
    swap = F.col("word") > F.col("word2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.where(both).select("word", "n", "word2", "n2").unionByName(far).select(
        pick("word", "word2").alias("a"), pick("n", "n2").alias("n_a"), pick("word2", "word").alias("b"), pick("n2", "n").alias("n_b")).distinct()


def forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n`` of every word."""
    pairs = near_pairs(words)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("top"))
    chosen = (-F.col("top.m")) >= F.col("n") * ratio
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("top.near")).alias("form"), F.when(chosen, -F.col("top.m")).cast("long").alias("form_n"))


def roots(found: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, root`` of the words of ``found(word, n, form)`` that have a form."""
    most = found.agg(F.max("n")).first()[0] or 1
    steps = max(math.ceil(math.log(most, ratio)), 1) if ratio > 1 else 64
    ahead = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(math.ceil(math.log2(steps)), 1)):
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = stored(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return ahead


def groups(docs: DataFrame, least: int = 7, copies: int = 2, ratio: int = 10, every: int = SPOILT) -> DataFrame:
    """Every word of the corpus with its form and root: ``word, n, n_near, form, form_n, root``."""
    if least < 4 or ratio < 2:
        raise ValueError("words need four code points and the ratio must be two or more")
    found = stored(forms(stored(word_counts(docs, least, copies, every), "words"), ratio), "forms")
    return found.join(roots(found, ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))
