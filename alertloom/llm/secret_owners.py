"""Secret scans with corpus-wide ownership frequency.

Base spans come from three fixed expressions. Every candidate value, and every key-like token besides, is hashed and counted
over the corpus by distinct repositories and distinct owners. A value that several owners hold is an example that people
copied; one that a single owner holds and that looks like a key is reported once more as a ``live`` span. Base spans stay.

Positions are sums of lengths: a text is split at its matches, and the lengths of gaps and matches are added up by a window
over the matches of one distinct text, so copies are scanned once per row but placed once. Defined cases: a null or empty
text has no spans; repeated rows give equal rows; a null owner or repository counts as one of its own kind.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.llm.common import let, stored

# fixed expressions
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# the method's own: tokens that look like keys
KEYLIKE = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", KEYLIKE))
MOST_OWNERS = 1
LEAST_LIVE = 8
HIT = "array<struct<kind:int,i:int,gap:bigint,size:bigint,own:bigint,v1:bigint,v2:bigint,digit:boolean>>"


def hits(text: Column, number: int, pattern: str) -> Column:
    """Array of the matches of one kind: gap before the match, its length, the secret's length and its hash."""
    group = 2 if pattern == ASSIGN else 0

    def rows(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        each = lambda gaps, own: F.transform(found, lambda m, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("size"),
            F.length(F.get(own, i)).cast("long").alias("own"), F.xxhash64(F.get(own, i)).alias("v1"), F.xxhash64(F.lit(1), F.get(own, i)).alias("v2"),
            F.get(own, i).rlike("[0-9]").alias("digit")))
        placed = let(F.split(text, pattern, -1), lambda gaps: let(values, lambda own: each(gaps, own)))
        return F.when(F.size(found) > 0, placed)
    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rows).cast(HIT), F.array().cast(HIT))


def counted(marks: str, kind: int) -> Column:
    return F.size(F.filter(marks, lambda m: m["kind"] == kind)).cast("long")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", most_owners: int = MOST_OWNERS) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = [hits(text, k, p) for k, (_, p) in enumerate(KINDS)]
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"),
                              F.col(owner).cast("string").alias("owner"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
                              F.concat(*every).alias("hits")), "hits")
    some = rows.where(F.size("hits") > 0)
    # one row per match of each distinct text; copies of a text agree, so the first will do
    matches = (some.select("t1", "t2", F.explode("hits").alias("h")).groupBy("t1", "t2", "h.kind", "h.i")
               .agg(*[F.first(f"h.{c}").alias(c) for c in ("gap", "size", "own", "v1", "v2", "digit")]))
    so_far = W.partitionBy("t1", "t2", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    spans = stored(matches.select("t1", "t2", "kind", (end - F.col("size")).alias("start"), end.alias("end"), (end - F.col("own")).alias("inner"),
                                  "own", "v1", "v2", "digit")
                   .where("kind <> 0 OR own >= 6"), "spans")
    holders = (some.select("t1", "t2", "repository", "owner").distinct().join(spans.select("t1", "t2", "v1", "v2").distinct(), ["t1", "t2"])
               .groupBy("v1", "v2", "owner", "repository").agg(F.lit(1).alias("one"))
               .groupBy("v1", "v2", "owner").agg(F.count("*").alias("repositories"))
               .groupBy("v1", "v2").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")))
    judged = spans.join(holders, ["v1", "v2"])
    live = judged.where((F.col("owners") <= most_owners) & (F.col("own") >= LEAST_LIVE) & (F.col("digit") | (F.col("kind") > 0)))
    added = live.select("t1", "t2", F.col("inner").alias("start"), F.lit(len(KINDS)).alias("kind"), "end").distinct()
    marks = judged.where(F.col("kind") < 3).select("t1", "t2", "start", "kind", "end", (F.col("owners") > most_owners).cast("int").alias("example"))
    both = marks.unionByName(added.withColumn("example", F.lit(0)))
    names = F.array(*[F.lit(n) for n, _ in KINDS], F.lit("live"))
    show = lambda marks: F.array_join(F.transform(marks, lambda m: F.concat_ws(
        ":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")
    per_text = (both.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"), F.sum("example").alias("n_examples"))
                .select("t1", "t2", "n_examples", F.filter("all", lambda m: m["kind"] < 3).alias("base"), "all")
                .select("t1", "t2", "n_examples", *[counted("base", k).alias(f"n_{n}") for k, (n, _) in enumerate(KINDS[:3])],
                        counted("all", len(KINDS)).alias("n_live"),
                        show(F.col("base")).alias("base"), show(F.col("all")).alias("spans")))
    out = rows.select("doc_id", "t1", "t2").join(per_text, ["t1", "t2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_examples"))

