"""Sections and their scores against plain versions."""
from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from alertloom.operators import manual


def plain_strength(heading: str, body: str, words: tuple[str, ...]) -> int:
    ordered = sorted(words, key=lambda w: (-len(w), w))
    pattern = lambda w: re.compile(rf"(?<![A-Za-z0-9]){re.escape(w)}(?![A-Za-z0-9])" if w.isascii() else re.escape(w), re.I if w.isascii() else 0)
    if any(pattern(w).search(heading) for w in ordered):
        return 2
    total = 0
    for w in ordered:
        total += len(pattern(w).findall(body))
        body = pattern(w).sub(" ", body)
    return int(total >= 2)


def test_mentions_are_counted_as_word_after_word(spark):
    pick = random.Random(5)
    pieces = ["db", "DB", "db-0", "0", "-", " ", "x", "寿", "\n", "a-b", "b-c", "a", "b", "a.b"]
    rows = [(i, "".join(pick.choices(pieces, k=pick.randint(0, 2))), "".join(pick.choices(pieces, k=pick.randint(0, 9)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, heading string, body string")
    for words in (("db",), ("db-0", "db", "0"), ("a-b", "b-c"), ("a-b", "a", "b"), ("寿", "db"), ("a.b", "x")):
        got = {r["id"]: r["v"] for r in df.select("id", manual.mention_strength(F.col("heading"), F.col("body"), words).alias("v")).collect()}
        assert got == {i: plain_strength(h, b, words) for i, h, b in rows}, words


def test_mentions_end_at_the_second(spark):
    """A text is looked at once, whatever the number of words: they used to be taken out one after the other."""
    assert manual._apart(["host-0", "on"]) and manual._apart(["a-b", "a", "b"])
    assert not manual._apart(["a-b", "b-c"]) and not manual._apart(["寿"])
    df = spark.createDataFrame([("h", "t")], "heading string, body string")
    plan = df.select(manual.mention_strength(F.col("heading"), F.col("body"), ("host-0", "on", "le")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


SECTIONS = "id string, file string, ord int, heading string, text string, hosts map<string,int>, types map<string,int>, tokens int, preferred boolean, in_card boolean"
BODY = "first\nalpha beta"


def sections_of(spark):
    return spark.createDataFrame([
        ("s1", "f", 0, "disk", BODY, {"h1": 2}, {"net": 2}, 100, True, False), ("s2", "f", 1, "alpha", BODY, {"h1": 1, "h2": 1}, {"net": 1}, 100, False, False),
        ("s3", "f", 2, "x", BODY, {"h2": 2}, {"net": 2}, 100, False, False), ("s4", "g", 0, "x", "first\nrare", {}, {}, 100, True, False),
        ("s5", "g", 1, "x", BODY, {"h1": 2}, {}, 100, True, False), ("s6", "g", 2, "x", BODY, {"h1": 2}, {}, 100, False, False),
        (None, None, 0, "x", BODY, {"h1": 2}, {"net": 2}, 100, True, False), ("s8", "g", 3, "x", BODY, {"h1": 2}, {"net": 2}, 5, True, False)], SECTIONS)


def test_scores_by_hand(spark):
    sections = sections_of(spark)
    index = spark.createDataFrame([("alpha", "s1", "body", 2), ("alpha", "s2", "heading", 3), ("rare", "s4", "body", 3), ("beta", "s2", "body", 1), ("alpha", "s8", "body", 3)],
                                  "term string, section_id string, place string, weight int")
    found = spark.createDataFrame([("k1", ["h1", "h2"], "net", ["alpha", "beta"]), ("k2", [], None, ["rare"]), (None, ["h1"], "net", ["alpha"])],
                                  "key string, hosts array<string>, type string, terms array<string>")
    rows = manual.score_sections(found, sections, index).collect()
    got = {(r["key"], r["id"]): (r["score"], r["host"], r["host_strength"], r["type_points"], r["matched"], r["own"]) for r in rows}
    assert got == {("k1", "s1"): (100 + 60 + 10 + 40, "h1", 2, 60, ["alpha"], True), ("k1", "s2"): (30 + 20 + 35, "h1", 1, 20, ["alpha", "beta"], False),
                   ("k1", "s3"): (100 + 60, "h2", 2, 60, None, False), ("k1", "s5"): (100 + 40, "h1", 2, None, None, True)}


def test_scores_read_every_table_once(spark):
    """The index and the sections stood several times in the plan."""
    sections = manual.with_terms(sections_of(spark).repartition(2, "heading")).drop("text").persist()
    found = spark.createDataFrame([("k1", ["h1"], "net", ["alpha"])], "key string, hosts array<string>, type string, terms array<string>")
    index = spark.createDataFrame([("alpha", "s1", "body", 2)], "term string, section_id string, place string, weight int").withColumn("weight", F.col("weight") + 0)
    plan = manual.score_sections(found, sections, index)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("section_id#") and plan.count("explode(terms#") == 1
    sections.unpersist()


def test_terms_stored_with_the_sections_give_the_same_index(spark):
    sections = sections_of(spark)
    stored = manual.with_terms(sections).drop("text")
    key = lambda df: sorted(tuple(str(v) for v in r) for r in df.collect())
    assert key(manual.term_index(stored)) == key(manual.term_index(sections)) and manual.term_index(stored).count() > 0


def test_lines_without_a_fence_are_cut_alike(spark):
    texts = {"a.md": "\n\nIntro 　\n\n\nmore\n# One  \nx\n\n\n## Two ##\n  \ny", "b.md": "# T\n```\n# no\n\n\nz  \n```\nend ", "c.md": "", "d.md": "``` open\nx", "e.md": "#no\n####four"}
    df = spark.createDataFrame(list(texts.items()) + [("n.md", None)], "file string, text string")
    rows = manual.split_sections(df).orderBy("file", "ord").collect()
    assert [(r["file"], r["heading"], r["text"]) for r in rows] == [
        ("a.md", "a", "Intro\n\nmore"), ("a.md", "One", "# One\nx"), ("a.md", "Two", "## Two ##\n\ny"),
        ("b.md", "T", "# T\n```\n# no\n\n\nz  \n```\nend"), ("e.md", "e", "#no\n####four")]
    code = spark.createDataFrame([("a\n```\nb\n```\nc",), ("a\n~~~\nb",), ("plain",), (None,)], "t string").select(manual.without_code(F.col("t"))).collect()
    assert [r[0] for r in code] == ["a\nc", "a", "plain", None]
    assert [r[0] for r in spark.createDataFrame([("a\nb\nc",), ("a",), ("\nx",), ("é\ny",)], "t string").select(manual.body_of(F.col("t"))).collect()] == ["b\nc", "", "x", "y"]


RECIPES = {"hosts": ({"a": ("db-0", "db"), "b": ("web",)}, False), "types": ({"net": ("the", "that"), "file": ("und",)}, True)}


def plain_map(heading: str | None, body: str, recipe: dict) -> dict[str, int]:
    found = {k: plain_strength(heading or "", body, v) for k, v in recipe.items()}
    return {k: v for k, v in found.items() if v}


def test_all_recipes_are_found_in_one_look(spark):
    """A body was searched once for every entry of every recipe."""
    pick = random.Random(11)
    pieces = ["db", "DB-0", "db-0", "web", "Web", "the", "that", "und", "thethe", "0", "-", " ", " ", ".", "\n", "é", "x"]
    rows = [(i, "".join(pick.choices(pieces, k=pick.randint(0, 3))).replace("\n", " "), "first\n" + "".join(pick.choices(pieces, k=pick.randint(0, 14)))) for i in range(1500)]
    rows += [(5000, "x", "first\nthe\n```\nthe und und\ndb db\n```\nweb"), (5001, "x", "first\nthe web web\n~~~\nthat und und"), (5002, None, "x\nund und"), (5003, "web", None), (5004, "x", "the the")]
    df = spark.createDataFrame(rows, "id int, heading string, text string")
    prose = {5000: "the\nweb", 5001: "the web web"}
    for recipes in (RECIPES, {"hosts": ({"a": ("db-0",), "b": ("db",)}, False), "types": RECIPES["types"]}, {"hosts": ({"a": ("a-b", "b-x")}, False)}):
        described = manual.detect_all(df, recipes)
        assert described.columns == [*df.columns, *recipes]
        got = {r["id"]: [r[name] for name in recipes] for r in described.collect()}
        body = {i: (t or "").partition("\n")[2] for i, _, t in rows}
        assert got == {i: [plain_map(h, prose.get(i, body[i]) if strict else body[i], recipe) for recipe, strict in recipes.values()] for i, h, _ in rows}
    assert manual._one_look([("db-0", "db"), ("web",)]) and not manual._one_look([("db-0",), ("db",)]) and not manual._one_look([("a-b",), ("b-c",)]) and not manual._one_look([("db",), ()])
    plan = manual.describe_sections(df.withColumn("file", F.lit("f")), RECIPES["hosts"][0], RECIPES["types"][0], ("x",), F.lit("2024-06-01"))
    plan = plan.select("hosts", "types")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("db-0") and "RLIKE(_body" not in plan and "RLIKE(heading" not in plan


def test_postings_are_neither_shuffled_nor_sorted_for_their_weights(spark):
    """They were joined with the weights of all terms."""
    words = [f"w{i:03d}" for i in range(200)]
    rows = [(str(i), "head", "first\n" + " ".join(["all", *(["half"] if i % 2 else []), *(["some"] if i % 6 == 0 else []), words[i], words[i]])) for i in range(120)]
    sections = spark.createDataFrame(rows, "id string, heading string, text string")
    asked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = manual.term_index(sections)
        plan = index._jdf.queryExecution().executedPlan().toString()
        got = {(r["term"], r["section_id"]): (r["place"], r["weight"]) for r in index.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    want = {(words[i], str(i)): ("body", 3) for i in range(120)}
    want |= {("half", str(i)): ("body", 1) for i in range(120) if i % 2} | {("some", str(i)): ("body", 2) for i in range(120) if i % 6 == 0}
    assert got == want


def test_pairs_are_hashed_where_only_scores_are_read(spark):
    """What a pair kept was a struct, so that all evidence was sorted."""
    index = spark.createDataFrame([("alpha", "s1", "body", 2)], "term string, section_id string, place string, weight int")
    found = spark.createDataFrame([("k1", ["h1"], "net", ["alpha"])], "key string, hosts array<string>, type string, terms array<string>")
    scored = manual.score_sections(found, sections_of(spark), index).select("key", "id", "score")
    assert "SortAggregate" not in scored._jdf.queryExecution().executedPlan().toString() and scored.count() > 0
