"""Quality rules by a hashed n-gram log-likelihood ratio between trusted and raw text.

Tokens are runs of letters and digits, or of other signs. Unigrams and bigrams fall into ``buckets`` by hash. Two smoothed
multinomials, one over the trusted documents and one over all of them, give each bucket a weight (a logarithm of the ratio in
millionths, an integer, so that sums do not depend on order). A document's score is the mean weight of its n-grams, and one
threshold decides on every document. The weights are one array of ``buckets`` longs, whatever the corpus.

Defined cases: a null or blank text has no words and fails the base rules; without trusted text all scores are zero; several
labels of one document count as trusted only if all are; a null doc_id is never trusted; repeated rows are judged alike.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import aside, let, stored, words

TOKEN = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+"
BUCKETS = 1 << 16
THRESHOLD = -0.3
MICRO = 1_000_000


def repeat_words(found: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    def covered(ordered: Column) -> Column:
        same = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda k: F.coalesce(
            F.get(ordered, k)["h"] == F.get(ordered, k - 1)["h"], F.lit(False)) | F.coalesce(
            F.get(ordered, k)["h"] == F.get(ordered, k + 1)["h"], F.lit(False)))
        places = F.sort_array(F.transform(same, lambda k: F.get(ordered, k)["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(places, start, lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")), lambda acc: acc["total"])

    def marked(hashes: Column) -> Column:
        tagged = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(tagged), covered))
    windows = F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.xxhash64(
        F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))
    return F.when(F.size(found) < 4, F.lit(0)).otherwise(let(windows, marked)).cast("long")


def base_rules(text: Column) -> Column:
    """Struct of the rule counts of a whole text."""
    def counts(found: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        repeated = let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own)))
        return F.struct(
            F.size(found).cast("long").alias("n_words"),
            F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
            F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
            F.when(text.isNull(), F.lit(0)).otherwise(repeated).cast("long").alias("n_dup_lines"),
            repeat_words(found).alias("n_repeat_words"))
    return let(words(text), counts)


def grams(text: Column, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of a text."""
    def both(tokens: Column) -> Column:
        n = F.size(tokens)
        ones = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
        twos = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.pmod(
            F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1)), F.lit(buckets)).cast("int"))
        return F.when(n < 2, ones).otherwise(F.concat(ones, twos))
    return let(F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")), both)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that every label calls good and none toxic."""
    return (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("low"), F.max("toxic").alias("high"))
            .where("low = 1 AND coalesce(high, 0) = 0").select("doc_id", F.lit(1).alias("trusted")))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> DataFrame:
    """``(bucket, weight)`` for every bucket seen, from the counts of all documents; at most ``buckets`` rows."""
    marked = docs.select("doc_id", "text").join(trusted.hint("shuffle_hash"), "doc_id", "left")
    counts = stored(marked.select("trusted", F.explode(grams(F.col("text"), buckets)).alias("bucket"))
                    .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good")), "counts")
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))
    share = lambda part, whole: F.log((F.col(part) + smooth) / (F.col(whole) + smooth * buckets))
    return counts.join(F.broadcast(totals), F.lit(True)).select("bucket", F.when(F.col("all_good") > 0, F.round(
        MICRO * (share("good", "all_good") - share("raw", "all_raw"))).cast("long")).otherwise(F.lit(0)).alias("weight"))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with a struct ``_verdict``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score (mean weight in millionths), kept. It takes the place of an input column of that name."""
    docs = docs.drop("_verdict")
    return judged(docs, labels, buckets, threshold).select(*aside(docs)[1], "_verdict")


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``judge`` with the input's columns under the names of ``aside``. Scores are summed per distinct text: copies do not change a mean."""
    key = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("_t2")]
    docs = docs.withColumn("text", F.col("text").cast("string"))
    table = stored(weights(docs, trusted_ids(labels), buckets), "weights")
    # keys and grams stand in a projection of their own: beside explode they would be computed again for every gram
    scores = (docs.select(*key, grams(F.col("text"), buckets).alias("_grams"))
              .select("_t1", "_t2", F.explode("_grams").alias("bucket"))
              .join(F.broadcast(table), "bucket")  # at most ``buckets`` rows
              .groupBy("_t1", "_t2").agg(F.round(F.sum("weight") / F.count("*")).cast("long").alias("_score")))
    rules = docs.select(*aside(docs)[0], base_rules(F.col("text")).alias("_rules"), *key)
    scored = rules.join(scores, ["_t1", "_t2"], "left")
    n, again, score = F.col("_rules.n_words"), F.col("_rules.n_repeat_words"), F.coalesce("_score", F.lit(0))
    failed = (n < 50) | (100 * again > 50 * n)
    verdict = F.struct(*[F.col(f"_rules.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                       failed.alias("base_failed"), score.alias("score"), (~failed & (score >= round(threshold * MICRO))).alias("kept"))
    return scored.withColumn("_verdict", verdict).drop("_t1", "_t2", "_rules", "_score")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    return judged(docs, labels, **options).where("_verdict.kept").select(*aside(docs)[1])
