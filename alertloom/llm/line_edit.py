"""Line dedup by a segment-partition edit join.

Lines of at least ``least`` characters take part; with ``fold`` all lines that are not blank and have so many characters are
folded when equal, and only the longer ones are compared by edits. Equal lines are folded first. A line is cut into ``radius + 1`` even
segments; within the radius one of them must stand unchanged in the other line, at a start that lengths and segment number
bound. Keys are the hash of (length, segment number, segment), probes the same of the substrings that a longer or equal line
may hold. Candidate pairs are verified by a banded bit-parallel edit distance of 2 * radius + 1 bits, one step per character.
All of it is DataFrame expressions.

A line is dropped when an equal line stands earlier (in the same text, or in a text of a smaller doc_id), or when it links to
a line that comes before it in the order (smallest doc_id holding the line, hash).

Defined cases: a null text stays null and an empty text empty; rows without a doc_id are returned as they are and take part in
nothing; rows that repeat a doc_id are treated as one document's and only their inner repeats are dropped; other columns stay.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import aside, components, let, stored

RADIUS = 2
LEAST = 24
FOLD = 1
SLOTS = 23
PIECES = 16
LETTERS = "etaoinsrhldcumf"
CIRCLE = 0x8CEF7310  # the codes of 0 to 7, four bits each


def takes_part(line: Column, least: int, fold: int | None) -> Column:
    return F.length(line) >= least if fold is None else (F.length(line) >= fold) & line.rlike("[^\\x20\\x09-\\x0D]")


def own_lines(text: Column, least: int, fold: int | None = None) -> Column:
    """Distinct lines of a text that take part."""
    return F.filter(F.array_distinct(F.split(text, "\n", -1)), lambda line: takes_part(line, least, fold))


def line_rows(docs: DataFrame, least: int = LEAST, fold: int | None = None) -> DataFrame:
    """``doc, line``: the distinct lines of every row that has a doc_id."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.explode(own_lines(F.col("text").cast("string"), least, fold)).alias("line"))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """``line, sign``: each line of ``rows(doc, line)`` with the codes of its letter counts."""
    return signed(rows.select("line")).groupBy("line", "sign").agg(F.lit(1).alias("one")).drop("one")


def segment(size: Column, radius: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``k`` (from 0) of a line of ``size`` characters: the last ones are longer."""
    base, extra = F.floor(size / (radius + 1)).cast("int"), F.pmod(size, F.lit(radius + 1)).cast("int")
    longer = F.greatest(F.lit(0), extra - (radius + 1 - k))
    return (base * k + longer + 1).cast("int"), (base + F.when(extra >= radius + 1 - k, 1).otherwise(0)).cast("int")


def keys(line: Column, size: Column, radius: int) -> tuple[Column, Column]:
    """Arrays of the index keys and of the probe keys of a line."""
    index, probes = [], []
    for k in range(radius + 1):
        start, width = segment(size, radius, k)
        index.append(F.xxhash64(size, F.lit(k), F.substring(line, start, width)))
    for gap in range(radius + 1):
        other = (size - gap).cast("int")
        for k in range(radius + 1):
            start, width = segment(other, radius, k)
            low, high = max(-k, gap - (radius - k)), min(k, gap + (radius - k))
            for move in range(low, high + 1):
                # never outside the line: the segments before and after have a character for every move
                probes.append(F.xxhash64(other, F.lit(k), F.substring(line, start + move, width)))
    return F.array(*index), F.array(*probes)


def code(count: Column) -> Column:
    """Four bits for a count modulo 8, such that the codes of two counts differ in as many bits as the counts are apart on that circle."""
    return F.call_function("shiftrightunsigned", F.lit(CIRCLE), (count.bitwiseAND(F.lit(7)) * 4).cast("int")).bitwiseAND(F.lit(15)).cast("long")


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sign``: the codes of how often each of ``LETTERS`` stands in the line, and of its other characters. A letter is
    counted by taking it away, each from what the letters before it left: in projections of their own, so each is done once."""
    names = list(rows.columns)
    left = rows.withColumns({"left": F.col("line"), "sign": F.lit(0).cast("long")})
    for k, c in enumerate(LETTERS):
        left = left.select(*names, "left", "sign", F.replace("left", F.lit(c)).alias("next"))
        n = F.octet_length("left") - F.octet_length("next")
        left = left.select(*names, F.col("next").alias("left"), F.col("sign").bitwiseOR(F.shiftleft(code(n), 4 * k)).alias("sign"))
    return left.select(*names, F.col("sign").bitwiseOR(F.shiftleft(code(F.length("left")), 4 * len(LETTERS))).alias("sign"))


def may_link(a: Column, b: Column, radius: int) -> Column:
    """False only for lines that no ``radius`` edits turn into each other: an edit takes one character at most and adds one at most,
    so it moves the counts of two classes by one, and two bits of the signs."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * radius


def distance(a: Column, b: Column, radius: int) -> Column:
    """Edit distance of two texts whose lengths differ by at most the radius, exact up to the radius, larger beyond it.

    Bit t of the band stands for row j - radius + t in column j. On a diagonal a step costs nothing where the diagonal delta
    is zero, so the distance is read along the diagonal of the last cell."""
    width = 2 * radius + 1
    mask = F.lit((1 << width) - 1).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    start = F.lit(((1 << (radius + 1)) - 1) << radius).cast("long")

    def run(rows: Column, columns: Column) -> Column:
        lean = F.size(rows) - F.size(columns)
        bit = (lean + radius).cast("int")

        def step(state: Column, item: Column) -> Column:
            same = zero
            for t in range(width):
                same = same + F.when(F.get(rows, item["j"] - radius + t) == item["c"], F.lit(1 << t).cast("long")).otherwise(zero)

            def deltas(eq: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                return (((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn)).bitwiseAND(mask)

            def move(d: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(mask))
                hn = d.bitwiseAND(vp)
                down = F.shiftrightunsigned(d, 1)
                cost = F.when(item["j"] >= F.greatest(F.lit(0), -lean), one - bit_of(d, bit)).otherwise(zero)
                return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                                down.bitwiseAND(hp).alias("vn"), (state["cost"] + cost).alias("cost"))
            # a diagonal never grows cheaper: beyond the radius nothing is left to learn
            return F.when(state["cost"] > radius, state).otherwise(let(let(same, deltas), move))
        items = F.transform(columns, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        first = F.struct(start.alias("vp"), zero.alias("vn"), F.abs(lean).cast("long").alias("cost"))
        return F.aggregate(items, first, step, lambda s: s["cost"])
    return let(F.filter(F.split(a, "", -1), lambda c: c != ""), lambda rows: let(F.filter(F.split(b, "", -1), lambda c: c != ""), lambda cols: run(rows, cols)))


def same_pieces(a: Column, b: Column, radius: int) -> Column:
    """False only beyond the radius: of ``PIECES`` even pieces of a line at most ``radius`` meet an edit, and each other one stands
    in the other line at most ``radius`` places away."""
    found = F.lit(0)
    for k in range(PIECES):
        start = F.floor(F.length(a) * k / PIECES).cast("int") + 1
        width = F.floor(F.length(a) * (k + 1) / PIECES).cast("int") - start + 1
        found = found + F.contains(F.substring(b, F.greatest(F.lit(1), start - radius), width + 2 * radius), F.substring(a, start, width)).cast("int")
    return found >= PIECES - radius


def bit_of(value: Column, bit: Column) -> Column:
    """One bit of a long at a place that differs by row."""
    return F.call_function("getbit", value, bit).cast("long")


def links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``doc_a, hash_a, doc_b, hash_b`` of different lines of ``rows(doc, line)`` within the radius, each once; doc is the
    smallest that holds the line. Lines need ``radius + 1`` characters."""
    tagged = distinct_lines(rows).select(F.xxhash64("line").alias("hash"), "line", F.length("line").alias("size"), "sign")
    index, probe = keys(F.col("line"), F.col("size"), radius)
    # the arrays stand in projections of their own, where lengths and segments are computed once; explode takes an expression
    # on them, as for a plain column Spark adds a filter that would compute the array a second time
    left = tagged.select("hash", "sign", probe.alias("keys")).select("hash", "sign", F.explode(F.array_distinct("keys")).alias("key"))
    right = tagged.select(F.col("hash").alias("hash2"), F.col("sign").alias("sign2"), index.alias("keys")).select(
        "hash2", "sign2", F.explode(F.array_distinct("keys")).alias("key"))
    # the counts of letters are compared inside the join: variants of one line that share a segment but differ in a word
    # are not made into rows
    met = left.join(right, "key").where("hash <> hash2").where(may_link(F.col("sign"), F.col("sign2"), radius))
    pairs = stored(met.select(F.least("hash", "hash2").alias("hash_a"), F.greatest("hash", "hash2").alias("hash_b")).distinct(), "pairs")
    # the texts of candidate lines only: a bitmap of 2 ** SLOTS bits in 2 ** (SLOTS - 6) rows, whatever the number of pairs,
    # lets the others go before anything is shuffled; a line that it lets through by chance meets no pair
    slot = lambda h: F.pmod(F.col(h), F.lit(1 << SLOTS))
    wanted = pairs.select(F.explode(F.array("hash_a", "hash_b")).alias("hash")).select(slot("hash").alias("s"))
    bits = stored(wanted.groupBy(F.shiftright("s", 6).alias("page")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")), "bits")
    texts = (rows.select("doc", "line", F.xxhash64("line").alias("hash")).withColumn("s", slot("hash")).withColumn("page", F.shiftright("s", 6))
             .join(F.broadcast(bits), "page").where(bit_of(F.col("bits"), F.expr("cast(s % 64 as int)")) == 1)
             .groupBy("hash", "line").agg(F.min("doc").alias("doc")))
    texts = stored(texts, "texts")
    a, b = (texts.select(*[F.col(c).alias(f"{c}_{side}") for c in ("doc", "hash", "line")]) for side in "ab")
    both = pairs.join(a, "hash_a").join(b, "hash_b")
    one, two = F.col("line_a"), F.col("line_b")
    # the pieces are compared in compiled code and leave few pairs to the distance, which is exact
    found = both.where(F.when(same_pieces(one, two, radius), distance(one, two, radius)) <= radius)
    ahead = F.struct("doc_a", "hash_a") < F.struct("doc_b", "hash_b")
    pick = lambda c, x, y: F.when(ahead, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    return found.select(*[pick(c, *sides).alias(f"{c}_{sides[0]}") for sides in ("ab", "ba") for c in ("doc", "hash")])


def line_links(docs: DataFrame, radius: int, least: int, fold: int | None) -> DataFrame:
    """The written links between the lines of at least ``least`` characters."""
    if not 0 < radius < 31 or least <= radius:
        raise ValueError("the radius must be from 1 to 30 and lines longer than it")
    return stored(links(line_rows(docs, least, fold).where(F.length("line") >= least), radius), "links")


def decisions(docs: DataFrame, found: DataFrame, least: int = LEAST, fold: int | None = None) -> DataFrame:
    """Lines with something to say: ``h1, h2`` (hashes), the first document, whether the line goes as a near copy, its links, and
    whether it has ``least`` characters."""
    rows = line_rows(docs, least, fold)
    ends = found.select(F.col("doc_a").alias("doc"), F.col("hash_a").alias("h1"), F.lit(0).alias("near")).unionByName(
        found.select(F.col("doc_b").alias("doc"), F.col("hash_b").alias("h1"), F.lit(1).alias("near")))
    linked = ends.groupBy("doc", "h1").agg(F.max("near").alias("near"), F.count("*").alias("n_links"))
    coded = (rows.select("doc", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), (F.length("line") >= least).alias("long"))
             .groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.count("*").alias("n_docs"), F.max("long").alias("long")))
    return stored(coded.join(linked, ["doc", "h1"], "left").where("n_docs > 1 OR n_links > 0")
                  .select("h1", "h2", "doc", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "long"), "decisions")


def told_lines(docs: DataFrame, found: DataFrame, least: int, fold: int | None) -> DataFrame:
    """Every document's lines with something to say: ``doc_id`` and the columns of ``decisions``."""
    told = decisions(docs, found, least, fold)
    held = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.transform(own_lines(F.col("text").cast("string"), least, fold), lambda line: F.struct(
        F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")))).alias("l"))
    return held.select("doc_id", "l.h1", "l.h2").join(told, ["h1", "h2"])


def losses(told: DataFrame) -> DataFrame:
    """Per document with such lines: ``doc_id, gone`` (h1, h2 of the lines it loses), n_equal, n_near, n_links."""
    equal = F.col("doc") != F.col("doc_id")
    rows = told.groupBy("doc_id", "h1", "h2").agg(F.max(equal.cast("int")).alias("equal"), F.max("near").alias("near"), F.max("n_links").alias("n_links"))
    goes = (F.col("equal") == 1) | (F.col("near") == 1)
    return rows.groupBy("doc_id").agg(
        F.collect_list(F.when(goes, F.struct("h1", "h2"))).alias("gone"), F.sum("equal").alias("n_equal"),
        F.sum(F.when(F.col("equal") == 0, F.col("near")).otherwise(0)).alias("n_near"), F.sum("n_links").alias("n_links"))


def counts(docs: DataFrame, told: DataFrame, least: int, fold: int | None) -> DataFrame:
    """The columns of ``report``."""
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    inner = let(F.filter(lines, lambda line: takes_part(line, least, fold)), lambda own: F.size(own) - F.size(F.array_distinct(own)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                       F.when(F.col("doc_id").isNull() | F.col("text").isNull(), 0).otherwise(inner).cast("long").alias("n_inner"))
    return base.join(losses(told).drop("gone"), "doc_id", "left").select("doc_id", "n_lines", "n_inner", *[
        F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_equal", "n_near", "n_links")])


def report(docs: DataFrame, radius: int = RADIUS, least: int = LEAST, fold: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_lines`` (all), ``n_inner`` (repeats inside the text), ``n_equal`` (lines that an earlier
    document has), ``n_near`` (other lines that link to an earlier line), ``n_links`` (links of its lines)."""
    return counts(docs, told_lines(docs, line_links(docs, radius, least, fold), least, fold), least, fold)


def classes(docs: DataFrame, radius: int = RADIUS, least: int = LEAST, fold: int | None = None) -> DataFrame:
    """``report`` with ``class_id``: the smallest document that equal lines of ``least`` characters and line links reach. Shorter
    equal lines are counted but hold no class together; a null doc_id has no class."""
    found = line_links(docs, radius, least, fold)
    told = stored(told_lines(docs, found, least, fold), "told")
    edges = told.where("long AND doc <> doc_id").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    roots = components(edges.unionByName(found.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))))
    named = counts(docs, told, least, fold).join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return named.withColumn("class_id", F.coalesce("root", "doc_id")).drop("root")


def dedup(docs: DataFrame, radius: int = RADIUS, least: int = LEAST, fold: int | None = None) -> DataFrame:
    """The documents with the lines that stay."""
    lost = losses(told_lines(docs, line_links(docs, radius, least, fold), least, fold)).select(F.col("doc_id").alias("_doc"), F.col("gone").alias("_gone"))

    def kept(lines: Column, gone: Column) -> Column:
        first = F.filter(F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda e: ~takes_part(e["line"], least, fold) | (
            (F.array_position(lines, e["line"]) == e["i"] + 1) & ~F.array_contains(gone, F.struct(F.xxhash64(e["line"]).alias("h1"), F.xxhash64(F.lit(1), e["line"]).alias("h2")))))
        return F.array_join(F.transform(first, lambda e: e["line"]), "\n")
    none = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
    there, back = aside(docs)
    number, whole = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    text = let(F.split(whole.cast("string"), "\n", -1), lambda lines: let(F.coalesce("_gone", none), lambda gone: kept(lines, gone)))
    joined = docs.select(*there).join(lost, number == F.col("_doc"), "left")
    kept_text = F.when(number.isNull() | whole.isNull(), whole).otherwise(text).alias("text")
    return joined.select(*[kept_text if c == "text" else was for c, was in zip(docs.columns, back)])
