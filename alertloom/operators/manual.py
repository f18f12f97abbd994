"""Operations manuals: sections, mentions, the term index, the card, and the choice of sections for an incident.

Files are at most 5 MiB each, so what happens inside one file is small; work is spread over files.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.text import confirmed_on, estimate_tokens, extract_terms, fold, once
from alertloom.operators.scans import carry, settled
from alertloom.settings import Settings

# A fenced block: the closing line repeats the opening mark, at least as long, with nothing after it.
FENCED = (r"(?md)^ {0,3}(?:(`{3,}+)[^\n]*\n[\s\S]*?^ {0,3}\1`*[ \t]*$|(~{3,}+)[^\n]*\n[\s\S]*?^ {0,3}\2~*[ \t]*$)")
FENCE_OPEN = r"(?md)^ {0,3}(?:`{3,}|~{3,})"
HEADING = r"^(#{1,3})[ \t]+([^ \t].*)$"
RIGHT_BLANKS = r"(?U)\s+\z"


def no_fence(text: Column) -> Column:
    """True for most texts: they hold no mark of a fence, and none of the patterns of fences has to look at them."""
    return ~(F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~")))


def has_open_fence(text: Column) -> Column:
    """Is some fence of the text never closed?"""
    return F.when(no_fence(text), False).otherwise(F.exists(F.split(text, FENCED, -1), lambda outside: outside.rlike(FENCE_OPEN)))


def _bare(line: Column) -> Column:
    """Line without the blanks at its end; only one that ends with a blank is searched."""
    return F.when(F.substring(line, -1, 1).rlike(r"(?U)\s"), F.regexp_replace(line, RIGHT_BLANKS, "")).otherwise(line)


def _lines(text: Column) -> Column:
    """Lines with their number from 1, whether they are code, and whether they belong to a diagram. The text is cut once; every
    piece of it is then looked at once."""
    plain, none = no_fence(text), F.array().cast("array<string>")
    return once(F.when(plain, F.array(text)).otherwise(F.split(text, FENCED, -1)), lambda outside: once(
        F.when(plain, none).otherwise(F.regexp_extract_all(text, F.lit(FENCED), F.lit(0))), lambda blocks: _numbered(outside, blocks)))


def _numbered(outside: Column, blocks: Column) -> Column:
    n = F.size(blocks)

    def plain(i: Column) -> Column:
        piece = F.element_at(outside, i + 1)
        inner = (i > 0) & (i < n)
        body = F.when(i > 0, F.regexp_replace(piece, r"\A\n", "")).otherwise(piece)
        body = F.when(i < n, F.regexp_replace(body, r"\n\z", "")).otherwise(body)
        none = (inner & (piece == "\n")) | ((n > 0) & (piece == ""))
        return F.when(none, F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))

    def fenced(i: Column) -> Column:
        return F.when(i < n, F.split(F.try_element_at(blocks, i + 1), "\n", -1)).otherwise(F.array().cast("array<string>"))

    def tagged(lines: Column, code: bool, diagram: Column) -> Column:
        return F.transform(lines, lambda x: F.struct(
            (x if code else _bare(x)).alias("line"), F.lit(code).alias("code"), diagram.alias("diagram")))

    def is_diagram(i: Column) -> Column:
        info = F.lower(F.regexp_extract(F.try_element_at(blocks, i + 1), r"^ {0,3}(?:`+|~+)[ \t]*([^ \n]*)", 1))
        return F.coalesce((info == "mermaid") | info.startswith("mermaid{"), F.lit(False))
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(
        tagged(plain(i), False, F.lit(False)), tagged(fenced(i), True, is_diagram(i))))
    return F.transform(F.flatten(parts), lambda x, i: F.struct(
        (i + 1).alias("no"), x["line"].alias("line"), x["code"].alias("code"), x["diagram"].alias("diagram")))


def split_sections(files: DataFrame) -> DataFrame:
    """``files(file, text)`` to sections at headings of level 1 to 3. A file with a fence that is never closed gives none;
    ``split_rejects`` lists it. Sectioning stays inside the row of the file; only finished sections are shuffled."""
    good = settled(files.select("file", "text"), "text").where(~has_open_fence(F.col("text")))
    numbered = good.select("file", F.filter(_lines(F.col("text")), lambda x: ~x["diagram"]).alias("a"))
    # of blank lines outside code only the first in a row stays
    kept = numbered.select("file", F.filter("a", lambda x, i: x["code"] | (x["line"] != "") | (i == 0) | F.coalesce(
        F.get(F.col("a"), i - 1)["code"] | (F.get(F.col("a"), i - 1)["line"] != ""), F.lit(True))).alias("a"))

    def level(x: Column) -> Column:
        mark = F.regexp_extract(x["line"], HEADING, 1)
        return F.when(~x["code"] & x["line"].startswith("#") & (F.length(x["line"]) <= 200), F.length(mark)).otherwise(0)
    levelled = kept.select("file", F.transform("a", lambda x: F.struct(
        x["no"].alias("no"), x["line"].alias("line"), level(x).alias("level"), ((x["line"] != "") | x["code"]).alias("full"))).alias("a"))
    indexed = levelled.select("file", "a", F.filter(F.transform("a", lambda x, i: F.when(x["level"] > 0, i)), lambda i: i.isNotNull()).alias("heads"),
                              F.try_element_at(F.filter(F.transform("a", lambda x, i: F.when(x["full"], i)), lambda i: i.isNotNull()), F.lit(1)).alias("first"))
    # text before the first heading is a section of its own
    starts = F.when(F.col("first").isNull(), F.array().cast("array<int>")).when(
        F.array_contains("heads", F.col("first")), F.col("heads")).otherwise(F.concat(F.array("first"), F.col("heads")))
    placed = indexed.select("file", "a", starts.alias("starts"))
    cut = placed.select("file", F.posexplode(F.transform("starts", lambda s, k: F.struct(
        F.get(F.col("a"), s)["no"].alias("line"), F.get(F.col("a"), s)["level"].alias("level"), F.get(F.col("a"), s)["line"].alias("head"),
        F.array_join(F.transform(F.slice(F.col("a"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("a")) - s),
                                 lambda x: x["line"]), "\n").alias("text")))).alias("ord", "s"))
    heading = F.regexp_replace(F.regexp_extract(F.col("s.head"), HEADING, 2), RIGHT_BLANKS, "")
    heading = F.regexp_replace(F.regexp_replace(heading, r"[ \t]+#+$", ""), RIGHT_BLANKS, "")
    stem = F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", "")
    out = cut.select("file", "ord", F.col("s.line").alias("line"), F.col("s.level").alias("level"),
                     F.when(F.col("s.level") > 0, heading).otherwise(stem).alias("heading"),
                     F.trim("s.text", F.lit("\n")).alias("text"))
    above = F.last(F.when(F.col("level").isin(1, 2), F.struct("level", "heading")), ignorenulls=True).over(
        W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("_above", above).withColumn("parent", F.when(
        (F.col("level") == 3) & (F.col("_above.level") == 2), F.col("_above.heading")).otherwise("")).drop("_above")
    return section_id(out)


def split_rejects(files: DataFrame) -> DataFrame:
    return files.where(has_open_fence(F.col("text"))).select("file", F.lit("fence is never closed").alias("reason"))


def section_id(sections: DataFrame) -> DataFrame:
    """Id from file, parent, heading and how often that pair came before; it survives edits of the text."""
    nth = F.row_number().over(W.partitionBy("file", "parent", "heading").orderBy("ord")) - 1
    slug = F.lower(F.replace(F.regexp_replace("file", r"\.[^./]*$", ""), F.lit("/"), F.lit("-")))
    digest = F.sha2(F.concat_ws("\n", "file", "parent", "heading", nth.cast("string")), 256)
    return sections.withColumn("id", F.concat(slug, F.lit("-"), F.substring(digest, 1, 10)))


_CLOSED = (r"^ {0,3}(?:(`{3,}+)[^\n]*\n[\s\S]*?^ {0,3}\1[^\n]*$|(~{3,}+)[^\n]*\n[\s\S]*?^ {0,3}\2[^\n]*$)")


def without_code(text: Column) -> Column:
    """Text outside fenced blocks; a fence that is never closed runs to the end."""
    inner = F.regexp_replace(text, f"(?md){_CLOSED}\\n", "")
    last = F.regexp_replace(inner, f"(?md)\\n?{_CLOSED}\\z", "")
    return F.when(no_fence(text), text).otherwise(F.regexp_replace(last, r"(?md)\n?^ {0,3}(?:`{3,}|~{3,})[\s\S]*\z", ""))


def word_pattern(word: str) -> str:
    """ASCII words match between non-letters in any case, other words as they are."""
    quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?i)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])" if word.isascii() else quoted


def body_of(text: Column) -> Column:
    """Everything after the first line."""
    return F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise("")


def _may_cross(a: str, b: str) -> bool:
    """Can a mention of ``a`` end inside a mention of ``b`` that goes on behind it?"""
    return any(a[-k:] == b[:k] and not a[-k - 1].isalnum() and not b[k].isalnum() for k in range(1, min(len(a), len(b))))


def _apart(words: list[str]) -> bool:
    """ASCII words of which none crosses another: a mention lies inside a longer one or beside it, so two mentions are two places."""
    low = [w.lower() for w in words]
    return all(w.isascii() and "\\" not in w and w for w in low) and not any(_may_cross(a, b) for a in low for b in low if a != b)


def _inside(a: str, b: str) -> bool:
    """Does a mention of ``b`` hold one of ``a``?"""
    ends = lambda i: (i == 0 or not b[i - 1].isalnum()) and (i + len(a) == len(b) or not b[i + len(a)].isalnum())
    return any(b.startswith(a, i) and ends(i) for i in range(len(b) - len(a) + 1))


def _one_look(recipes: list[tuple[str, ...]]) -> bool:
    """Can the words of all recipes be found together? None may cross another, and none of one recipe lie inside one of another
    recipe, where it would be found for one of them only."""
    low = [{w.lower() for w in words} for words in recipes]
    alone = not any(a != b and _inside(a, b) for own in low for other in low if other is not own for a in own for b in other)
    return all(recipes) and alone and _apart([w for words in recipes for w in words])


def _mentions(text: Column, words: set[str]) -> Column:
    """All mentions of the words in order, in lower case. What starts no word is passed over by its letter."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    starts = "".join(f"\\x{{{ord(c):X}}}" for c in sorted({x for w in ordered for x in (w[0].lower(), w[0].upper())}))
    one = f"(?i)(?=[{starts}])(?<![A-Za-z0-9])(?>" + "|".join(f"\\Q{w}\\E(?![A-Za-z0-9])" for w in ordered) + ")"
    return F.transform(F.regexp_extract_all(text, F.lit(one), F.lit(0)), F.lower)


def mention_strength(heading: Column, body: Column, words: tuple[str, ...]) -> Column:
    """2 when a word is in the heading, 1 when the body mentions the words twice or more, else 0. Longer words are counted
    first and taken out, so that a part of them is not counted again."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    if ordered and _apart(ordered):
        # one look that ends at the second mention
        one = "(?<![A-Za-z0-9])(?>" + "|".join(f"\\Q{w}\\E(?![A-Za-z0-9])" for w in ordered) + ")"
        return F.when(heading.rlike("(?i)" + one), 2).when(body.rlike(f"(?i){one}[\\s\\S]*?{one}"), 1).otherwise(0)
    in_heading = F.lit(False)
    for w in ordered:
        in_heading = in_heading | heading.rlike(word_pattern(w))
    total, rest = F.lit(0), body
    for w in ordered:
        total = total + F.regexp_count(rest, F.lit(word_pattern(w)))
        rest = F.regexp_replace(rest, word_pattern(w), " ")
    # most bodies mention nothing; one look for any of the words spares them the counting
    some = body.rlike("(?i)" + "|".join("\\Q" + w.replace("\\E", "") + "\\E" for w in ordered))
    return F.when(in_heading, 2).when(some & (total >= 2), 1).otherwise(0)


def detect_mentions(sections: DataFrame, recipe: dict[str, tuple[str, ...]], name: str, prose: bool = False) -> DataFrame:
    """Map column ``name`` from every recipe entry a section mentions to its strength. The recipe is a hand-written list, so
    it becomes part of the expression: no join and no shuffle."""
    return detect_all(sections, {name: (recipe, prose)})


def detect_all(sections: DataFrame, recipes: dict[str, tuple[dict[str, tuple[str, ...]], bool]]) -> DataFrame:
    """``detect_mentions`` for several columns, ``{name: (recipe, prose)}``. Where the words allow it, a heading and a body are looked
    at once for all words of all recipes; a body with code is looked at once more for those that count in prose only."""
    words = [v for recipe, _ in recipes.values() for v in recipe.values()]
    if not words or not _one_look(words):
        if len(recipes) > 1:
            for name, one in recipes.items():
                sections = detect_all(sections, {name: one})
            return sections
        (name, (recipe, prose)), = recipes.items()
        tagged = sections.withColumn("_body", body_of(without_code(F.col("text")) if prose else F.col("text")))
        found = F.array(*[F.struct(F.lit(k).alias("k"), mention_strength(F.col("heading"), F.col("_body"), v).alias("v"))
                          for k, v in sorted(recipe.items())])
        return tagged.withColumn(name, F.map_from_entries(F.filter(found, lambda e: e["v"] > 0))).drop("_body")
    every = {w.lower() for v in words for w in v}
    strict = {w.lower() for recipe, prose in recipes.values() if prose for v in recipe.values() for w in v}
    text = F.col("text")
    looks = {"_heading": _mentions(F.col("heading"), every), "_body": _mentions(body_of(text), every)}
    if strict:
        looks["_prose"] = F.when(~no_fence(text), _mentions(body_of(without_code(text)), strict))
    tagged = settled(sections.withColumns(looks), *looks)

    def strength(entry: tuple[str, ...], prose: bool) -> Column:
        own = [w.lower() for w in entry]
        mine = F.coalesce("_prose", "_body") if prose else F.col("_body")
        return F.when(F.arrays_overlap("_heading", F.array(*[F.lit(w) for w in own])), 2).when(
            F.size(F.filter(mine, lambda w: w.isin(own))) >= 2, 1).otherwise(0)
    maps = {name: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), strength(v, prose).alias("v")) for k, v in sorted(recipe.items())]),
                                              lambda e: e["v"] > 0)) for name, (recipe, prose) in recipes.items()}
    return tagged.withColumns(maps).drop(*looks)


def describe_sections(sections: DataFrame, hosts: dict[str, tuple[str, ...]], types: dict[str, tuple[str, ...]], preferred: tuple[str, ...],
                      today: Column) -> DataFrame:
    """Sections with hosts, types, date of confirmation, tokens, hash and whether the heading is a preferred one."""
    out = detect_all(sections, {"hosts": (hosts, False), "types": (types, True)})
    return out.withColumns({"confirmed_on": confirmed_on(F.col("text"), today), "tokens": estimate_tokens(F.col("text")),
                            "sha256": F.sha2("text", 256), "preferred": prefer_headings(F.col("heading"), preferred)})


def prefer_headings(heading: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(heading, F.lit(word))
    return hit


def term_weight(frequency: Column, total: Column) -> Column:
    """Rare terms weigh more; a term of more than half the sections has no weight."""
    return (F.when(frequency <= F.greatest(F.lit(1), F.floor(total / 20)), 3).when(frequency <= F.greatest(F.lit(2), F.floor(total / 5)), 2)
            .when(frequency <= F.greatest(F.lit(3), F.floor(total / 2)), 1).otherwise(0))


def with_terms(sections: DataFrame) -> DataFrame:
    """Sections with the terms of their heading and of their body, for ``term_index``, unless they have them. Stored so, texts need not be
    read again."""
    if "body_terms" in sections.columns:
        return sections
    return sections.withColumns({"heading_terms": extract_terms(F.col("heading")), "body_terms": extract_terms(body_of(F.col("text")))})


def term_index(sections: DataFrame) -> DataFrame:
    """Inverted index: term, section, place (heading wins over body) and weight. Terms without weight are dropped.

    Only terms of more than a twentieth of the sections weigh less than 3. They are at most twenty times the mean number of terms of
    a section, however many sections there are, so they are broadcast and the postings are neither shuffled nor sorted.
    """
    own = with_terms(sections).select("id", F.col("heading_terms").alias("h"), F.col("body_terms").alias("b"))
    postings = own.select("id", F.explode("h").alias("term"), F.lit("heading").alias("place")).unionByName(
        own.select("id", F.explode(F.array_except("b", "h")).alias("term"), F.lit("body").alias("place"))).where("term IS NOT NULL")
    total = sections.agg(F.count("*").alias("total"))
    often = (postings.groupBy("term").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row
             .select("term", term_weight(F.col("n"), F.col("total")).alias("_weight")).where("_weight < 3"))
    weighed = postings.join(F.broadcast(often), "term", "left").withColumn("weight", F.coalesce("_weight", F.lit(3)))
    return weighed.where("weight > 0").select("term", F.col("id").alias("section_id"), "place", "weight")


def resolve_hosts(names: DataFrame, aliases: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``names(key, name)`` to known hosts by folded alias, else by the part before the first dot; unknown names stay with a
    null host. ``aliases(alias, host)``; one alias may stand for several hosts."""
    norm = (lambda c: F.lower(F.trim(c))) if ascii_only else fold
    known = aliases.select(norm(F.col("alias")).alias("alias"), "host").distinct()
    asked = names.withColumn("_full", norm(F.col("name"))).withColumn("_short", F.substring_index("_full", ".", 1))
    full = asked.join(known.withColumnsRenamed({"alias": "_full", "host": "_a"}), "_full", "left")
    both = full.join(known.withColumnsRenamed({"alias": "_short", "host": "_b"}), "_short", "left")
    host = F.when(F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("_b"))
    return both.select("key", F.trim("name").alias("name"), host.alias("host")).distinct()


def pick_sections(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries(nth, file, heading)``: the section of that heading, else the one whose heading begins so. None or several
    give a row with an error."""
    wanted = entries.withColumnRenamed("heading", "wanted")
    pair = wanted.join(sections.select("file", "id", "ord", "level", "heading"), "file", "left")
    exact, begins = F.col("heading") == F.col("wanted"), F.col("heading").startswith(F.col("wanted"))
    # minima instead of lists: an entry keeps one section and two counts, however many headings match
    found = pair.groupBy("nth", "file", "wanted").agg(
        F.count_if(exact).alias("n_exact"), F.count_if(begins).alias("n_begins"),
        F.min(F.when(exact, F.struct("ord", "id", "level"))).alias("e"), F.min(F.when(begins, F.struct("ord", "id", "level"))).alias("b"))
    hits = F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.col("n_begins"))
    one = F.when(F.col("n_exact") > 0, F.col("e")).otherwise(F.col("b"))
    error = F.when(hits == 0, "not found").when(hits > 1, F.concat(hits.cast("string"), F.lit(" headings match")))
    return found.select("nth", "file", "wanted", F.when(error.isNull(), one["id"]).alias("id"), F.when(error.isNull(), one["ord"]).alias("ord"),
                        F.when(error.isNull(), one["level"]).alias("level"), error.alias("error"))


def with_children(sections: DataFrame, picked: DataFrame) -> DataFrame:
    """Picked sections with those below them: up to the next of the same or a higher level in the file."""
    s = sections.select("file", F.col("id").alias("member_id"), F.col("ord").alias("at"), F.col("level").alias("depth"))
    good = picked.where("error IS NULL").select("nth", "file", "id", "ord", "level")
    ends = (good.join(s, "file").where((F.col("at") > F.col("ord")) & (F.col("depth") <= F.col("level")))
            .groupBy("nth").agg(F.min("at").alias("stop")))
    spans = good.join(ends, "nth", "left")
    inside = (F.col("at") >= F.col("ord")) & (F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    return spans.join(s, "file").where(inside).select("nth", "file", F.col("id").alias("root_id"), "member_id", "at")


ROW_DATE = (r"(?<![0-9])(20[0-9]{2})(?:[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})|年[ \t]{0,2}([0-9]{1,2})月[ \t]{0,2}([0-9]{1,2})日?)(?![0-9])")
RULE_ROW = r"^[ \t]{0,8}\|?[ \t:|-]{0,2000}-[ \t:|-]{0,2000}$"


def table_rows(sections: DataFrame, today: Column, days: int) -> DataFrame:
    """Lines of the change tables of sections: table rows with their date and whether it lies in the last ``days`` days, and
    the two header lines of the first table."""
    lines = sections.select("id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bar, rule = F.contains(F.col("line"), F.lit("|")), F.col("line").rlike(RULE_ROW)
    order = W.partitionBy("id").orderBy("pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    no_bar = F.max(F.when(~bar, F.col("pos"))).over(before)
    last_rule = F.max(F.when(bar & rule, F.col("pos"))).over(before)
    in_table = F.coalesce(last_rule > F.coalesce(no_bar, F.lit(-1)), F.lit(False))
    tagged = lines.withColumns({"bar": bar, "rule": bar & rule, "in_table": in_table, "prev": F.lag("line").over(order)})
    opens = tagged["rule"] & ~tagged["in_table"] & F.coalesce(F.contains(F.col("prev"), F.lit("|")), F.lit(False))
    tagged = tagged.withColumn("opens", opens)
    tagged = tagged.withColumn("head_at", F.min(F.when(F.col("opens"), F.col("pos"))).over(W.partitionBy("id")))
    year = F.regexp_extract("line", ROW_DATE, 1)
    month = F.concat(F.regexp_extract("line", ROW_DATE, 2), F.regexp_extract("line", ROW_DATE, 4))
    day = F.concat(F.regexp_extract("line", ROW_DATE, 3), F.regexp_extract("line", ROW_DATE, 5))
    when_ = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    is_row = F.col("bar") & F.col("in_table") & ~F.col("rule")
    kind = F.when(is_row, "row").when((F.col("pos") == F.col("head_at")) | (F.col("pos") == F.col("head_at") - 1), "header")
    inside = when_.between(F.date_sub(today.cast("date"), days), today.cast("date"))
    return tagged.select("id", "pos", "line", kind.alias("kind"), F.when(is_row, when_).alias("row_date"),
                         F.when(is_row, F.coalesce(inside, F.lit(False))).alias("inside")).where("kind IS NOT NULL")


def recent_rows(sections: DataFrame, today: Column, days: int) -> DataFrame:
    """Counts of the rows of change tables: inside the period, outside, unreadable."""
    return table_rows(sections, today, days).where("kind = 'row'").groupBy("id").agg(
        F.count("*").alias("rows"), F.count_if("inside").alias("inside"),
        F.count_if(F.col("row_date").isNotNull() & ~F.col("inside")).alias("outside"), F.count_if(F.col("row_date").isNull()).alias("unreadable"))


def build_card(sections: DataFrame, entries: DataFrame, history: DataFrame, today: Column, days: int, cfg: Settings = Settings()) -> DataFrame:
    """The parts of the card in order, each with its tokens, the running total and whether the budget is kept.

    ``entries`` pick the fixed sections, ``history(id)`` names the section with the change table.
    """
    members = with_children(sections, pick_sections(sections, entries))
    first = members.groupBy("member_id").agg(F.min(F.struct("nth", "at")).alias("o"))
    fixed = first.join(sections.select(F.col("id").alias("member_id"), "text"), "member_id").select(
        F.col("o.nth").alias("nth"), F.col("o.at").alias("at"), "member_id", "text")
    rows = table_rows(sections.join(history, "id", "left_semi"), today, days)
    shown = rows.where("inside OR kind = 'header'").groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.count_if("inside").alias("n"))
    title = F.lit(f"## Changes of the last {days} days\n\n")
    changes = shown.select(F.lit(1 << 30).alias("nth"), F.lit(0).alias("at"), F.col("id").alias("member_id"),
                           F.concat(title, F.when(F.col("n") > 0, F.col("body")).otherwise(f"No change in the last {days} days.")).alias("text"))
    parts = fixed.unionByName(changes).withColumn("tokens", estimate_tokens(F.col("text")))
    # the parts of one entry are added up in one task, the totals of the entries before it are carried over
    parts = carry(parts.withColumn("_card", F.lit(0)), ["_card"], "nth", {"_before": (F.sum("tokens"), F.sum)})
    so_far = F.sum("tokens").over(W.partitionBy("nth").orderBy("at", "member_id").rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
    return parts.withColumn("total", so_far.cast("bigint")).withColumn("fits", F.col("total") <= cfg.card_budget).drop("_card", "_before")


def bundle_version(sections: DataFrame, day: str) -> DataFrame:
    """Version of a set of sections: the day and 12 hex digits over the content. Hashes of the sections are summed, so the
    order of rows and partitions does not matter and nothing is gathered."""
    digest = F.sha2(F.concat_ws("\n", "id", "sha256"), 256)
    pieces = [F.sum(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    row = sections.agg(F.concat_ws("/", F.count("*").cast("string"), *pieces).alias("c"), F.sum(F.col("tokens").cast("bigint")).alias("tokens"),
                       F.count("*").alias("sections"))
    return row.select(F.concat(F.lit(day.replace("-", "") + "-"), F.substring(F.sha2("c", 256), 1, 12)).alias("version"), "sections", "tokens")


def bundle_freshness(built: DataFrame, sources: DataFrame) -> DataFrame:
    """``built(file, sha256)`` against the files of today: same, changed, missing or new."""
    now_ = sources.select("file", F.col("sha256").alias("current"))
    state = (F.when(F.col("sha256").isNull(), "new").when(F.col("current").isNull(), "missing")
             .when(F.col("sha256") == F.col("current"), "same").otherwise("changed"))
    return built.select("file", "sha256").join(now_, "file", "full").select("file", state.alias("state"))


def bundle_age(built_on: Column, today: Column, stale_after: int = 30) -> tuple[Column, Column]:
    age = F.greatest(F.lit(0), F.datediff(today.cast("date"), built_on.cast("date")))
    return age, age > stale_after


def full_document(sections: DataFrame) -> DataFrame:
    """All sections of a file in order as one text, with its tokens. A file is bounded, so its text is put together in one
    row; the whole manual is the ordered set of these rows."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return sections.groupBy("file").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"),
                                        F.sum(F.col("tokens").cast("bigint")).alias("tokens"))


def bundle_stats(sections: DataFrame) -> DataFrame:
    """Count, tokens and sections in the card, one row."""
    return sections.agg(F.count("*").alias("sections"), F.sum(F.col("tokens").cast("bigint")).alias("tokens"),
                        F.count_if("in_card").alias("in_card"), F.max("tokens").alias("largest"))


def largest_sections(sections: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` sections of most tokens, in the order of the files on a tie."""
    return sections.orderBy(F.desc("tokens"), "file", "ord", "id").limit(k).select("file", "heading", "id", "tokens")


PATHS = r"(?:~|\.{1,2})?(?:/[A-Za-z0-9._@%+-]{1,80}){1,40}/?"


def title_terms(title: Column, names: Column) -> Column:
    """Terms of a title. Places and names of hosts are no terms."""
    bare = F.regexp_replace(F.substring(title, 1, 200), PATHS, " ")
    lowered = F.lower(bare)
    without = F.aggregate(names, lowered, lambda acc, n: F.replace(acc, F.lower(n), F.lit(" ")))
    parts = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(F.lower(n), F.lit("[a-z0-9]{3,}"), F.lit(0))))
    return F.array_sort(F.array_except(extract_terms(without), parts))


def score_sections(situations: DataFrame, sections: DataFrame, index: DataFrame, budget: int = 3000) -> DataFrame:
    """Score of every section that fits a situation.

    ``situations(key, hosts, type, terms)`` are the distinct combinations of host, type and title terms of incidents, so
    equal incidents are scored once. Pairs come only from what is shared: a type, an indexed term, or a preferred section
    about the host. Host points are then added to these pairs.
    """
    usable = sections.where(~F.col("in_card") & F.col("tokens").between(30, budget))
    s_hosts = usable.select("id", "preferred", F.explode("hosts").alias("host", "strength"))
    s_types = usable.select("id", F.explode("types").alias("type", "strength"))
    unit = F.when(F.col("place") == "heading", F.col("weight") * 10).otherwise(F.col("weight") * 5)
    by_type = situations.select("key", "type").join(s_types, "type").select(
        "key", "id", F.when(F.col("strength") == 2, 60).otherwise(20).alias("type_points"))
    by_term = situations.select("key", F.explode("terms").alias("term")).join(index, "term").select(
        "key", F.col("section_id").alias("id"), unit.alias("unit"), "term")
    by_host = situations.select("key", F.explode("hosts").alias("host")).join(s_hosts, "host").select(
        "key", "id", "host", "strength", "preferred")
    # every table is read once: what speaks for a pair is put together by the section, which then gives the rest
    told = by_type.unionByName(by_term, allowMissingColumns=True).unionByName(by_host, allowMissingColumns=True).repartition("id")
    own_status = F.coalesce((F.col("strength") == 2) & F.col("preferred"), F.lit(False))
    # the strongest host of the situation in the section, the first by name on a tie
    first = F.min_by("host", F.when(F.col("host").isNotNull(), F.struct(-F.col("strength"), F.col("host"))))
    # numbers and truth values only, unless a caller reads the host or the terms: such pairs are hashed and not sorted
    pairs = told.groupBy("key", "id").agg(
        F.max("type_points").alias("type_points"), F.when(F.sum("unit").isNotNull(), F.least(F.lit(80), F.sum("unit"))).alias("term_points"), F.array_sort(F.collect_set("term")).alias("matched"),
        F.max("strength").alias("host_strength"), first.alias("host"), F.bool_or(F.col("type_points").isNotNull() | F.col("term").isNotNull() | own_status).alias("shared")).where("shared")
    pairs = pairs.withColumn("matched", F.when(F.size("matched") > 0, F.col("matched")))
    # a section whose heading names only other hosts is about them
    named = F.map_keys(F.map_filter("hosts", lambda _, v: v == 2))
    joined = pairs.join(usable.select("id", named.alias("named"), "preferred", "tokens", "file", "ord"), "id").join(situations.select("key", "hosts"), "key")
    others = (F.size("hosts") > 0) & (F.size("named") > 0) & ~F.arrays_overlap("named", "hosts")
    own = F.coalesce((F.col("host_strength") == 2) & F.col("preferred"), F.lit(False))
    host_points = F.coalesce(F.when(F.col("host_strength") == 2, 100).when(F.col("host_strength") == 1, 30), F.lit(0))
    base = host_points + F.coalesce("type_points", F.lit(0)) + F.coalesce("term_points", F.lit(0))
    score = base + F.when(own, 40).when(F.col("preferred") & (base > 0), 20).otherwise(0)
    return (joined.where(~others).withColumn("score", score.cast("int")).withColumn("own", own).where("score >= 50")
            .select("key", "id", "score", "tokens", "file", "ord", "host", "host_strength", "type_points", "matched",
                    "own", "preferred"))


def pick_within_budget(scored: DataFrame, budget: int = 3000, k: int = 3) -> DataFrame:
    """Greedy choice by score, then order: sections of at most half the budget first, larger ones only where there is no
    such section; what does not fit is passed over.

    Each pick is a minimum over the candidates behind the pick before, so no list of candidates is ever gathered.
    """
    small = F.col("tokens") <= budget // 2
    any_small = scored.groupBy("key").agg(F.bool_or(small).alias("some"))
    rank = F.struct((-F.col("score")).alias("s"), F.col("file"), F.col("ord"), F.col("id"), F.col("tokens"), F.col("score"))
    left = scored.join(any_small, "key").where(small | ~F.col("some")).select("key", rank.alias("r"))
    picks, state = None, None
    for n in range(k):
        pool = left if state is None else left.join(state, "key").where((F.col("r") > F.col("last")) & (F.col("r.tokens") <= F.col("rest")))
        best = pool.groupBy("key").agg(F.min("r").alias("last"), *([] if state is None else [F.first("rest").alias("rest")]))
        rest = (F.lit(budget) if state is None else F.col("rest")) - F.col("last.tokens")
        state = best.select("key", "last", rest.alias("rest"))
        one = state.select("key", F.lit(n).alias("nth"), F.col("last.id").alias("id"), F.col("last.score").alias("score"), F.col("last.tokens").alias("tokens"))
        picks = one if picks is None else picks.unionByName(one)
    return picks


def selection_reasons(scored: DataFrame) -> DataFrame:
    """Why a section was chosen, in words."""
    place = F.when(F.col("host_strength") == 2, "heading").otherwise("body")
    matched = F.coalesce("matched", F.array().cast("array<string>"))
    more = F.size(matched) - 5
    terms = F.when(F.size(matched) > 0, F.concat(F.lit("terms: "), F.array_join(F.slice(matched, 1, 5), ", "),
                                                 F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")))
    parts = [F.when(F.col("host_strength").isNotNull(), F.concat(F.lit("host "), "host", F.lit(" in "), place)),
             F.when(F.col("type_points").isNotNull(), F.concat(F.lit("type in "), F.when(F.col("type_points") == 60, "heading").otherwise("body"))),
             terms, F.when(F.col("own"), "state of the host").when(F.col("preferred"), "preferred heading")]
    return scored.select("key", "id", "score", F.concat_ws("; ", *parts).alias("reasons"))
