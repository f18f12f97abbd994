"""Checks of model answers: form, unsafe strings, and recommended commands that change something."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.text import DANGEROUS, RESERVED, neutralise
from alertloom.operators.commands import classify_distinct, match_commands
from alertloom.operators.reports import parsed
from alertloom.operators.scans import join_by_count
from alertloom.session import checkpoint_dir

# Codes of an answer, and the form it must have.
KINDS = ("availability", "performance", "security", "configuration", "noise")
URGENCIES = ("now", "today", "watch", "ignore")
CONFIDENCES = ("high", "medium", "low")


def _text(longest: int, shortest: int = 0) -> dict:
    return {"type": "string", "longest": longest, "shortest": shortest}


def _list(item: dict, most: int) -> dict:
    return {"type": "array", "item": item, "most": most}


def _object(**fields: dict) -> dict:
    return {"type": "object", "fields": fields}


FORM = _object(
    summary=_text(400, 1), classification=_object(kind={"type": "enum", "values": KINDS}, urgency={"type": "enum", "values": URGENCIES}),
    probable_causes=_list(_object(cause=_text(200, 1), confidence={"type": "enum", "values": CONFIDENCES}, evidence=_text(220)), 3),
    impact=_object(services=_list(_text(120), 10), scope=_text(200)),
    recommended_checks=_list(_object(purpose=_text(160, 1), where=_text(120), command=_text(300)), 5),
    correlation=_object(incidents=_list(_text(120), 10), changes=_list(_text(200), 10)),
    needs_human_decision={"type": "boolean"}, unknowns=_list(_text(160), 10))
_ROW = "array<struct<path:string,message:string>>"


def _one(path: Column, message: str | Column) -> Column:
    return F.array(F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def _nothing() -> Column:
    return F.array().cast(_ROW)


def _when(condition: Column, path: Column, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(True)), _one(path, message)).otherwise(_nothing())


def _problems(value: Column, form: dict, path: Column) -> Column:
    """Problems of one variant value, as an expression that follows the form."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    if form["type"] == "enum":
        word = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        return _when(~F.coalesce(word.isin(*form["values"]), F.lit(False)), path, "one of " + ", ".join(form["values"]))
    if form["type"] == "boolean":
        return _when(kind != "BOOLEAN", path, "true or false")
    if form["type"] == "string":
        text = F.try_variant_get(value, "$", "string")
        checks = F.concat(_when(F.length(text) > form["longest"], path, f"at most {form['longest']} characters"),
                          _when(F.length(F.trim(text)) < form["shortest"], path, "not empty"))
        return F.when(kind == "STRING", checks).otherwise(_one(path, "a string"))
    if form["type"] == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.flatten(F.transform(items, lambda v, i: _problems(v, form["item"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(kind.startswith("ARRAY"), F.concat(_when(F.size(items) > form["most"], path, f"at most {form['most']}"), inner)) \
            .otherwise(_one(path, "a list"))
    names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    fields = {name: F.try_variant_get(value, f"$.{name}", "variant") for name in form["fields"]}
    return _object_problems(kind, names, fields, form, path)


def _object_problems(kind: Column, names: Column, fields: dict[str, Column], form: dict, path: Column) -> Column:
    parts = []
    for name in form["fields"]:
        parts.append(F.when(~F.array_contains(names, name), _one(F.concat(path, F.lit(f".{name}")), "missing")).otherwise(_nothing()))
    unknown = F.filter(names, lambda n: ~n.isin(*form["fields"]))
    parts.append(F.transform(unknown, lambda n: F.struct(F.concat(path, F.lit("."), n).alias("path"), F.lit("unknown field").alias("message"))))
    for name, sub in form["fields"].items():
        parts.append(F.when(F.array_contains(names, name), _problems(fields[name], sub, F.concat(path, F.lit(f".{name}")))).otherwise(_nothing()))
    return F.when(kind.startswith("OBJECT"), F.concat(*parts)).otherwise(_one(path, "an object"))


def validate_answers(answers: DataFrame) -> DataFrame:
    """``answers(id, content)``: all problems of form of every answer, with path and message."""
    found = answers.select("id", F.try_parse_json("content").alias("v"))
    # the fields of the answer are columns, so that the checks below start from values and not from the whole text
    found = found.withColumns({"_kind": F.coalesce(F.schema_of_variant("v"), F.lit("VOID")), "_names": F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")),
                               **{f"_{n}": F.try_variant_get("v", f"$.{n}", "variant") for n in FORM["fields"]}})
    listed = _object_problems(F.col("_kind"), F.col("_names"), {n: F.col(f"_{n}") for n in FORM["fields"]}, FORM, F.lit("$"))
    return found.select("id", F.posexplode(listed).alias("pos", "p")).select("id", "pos", "p.path", "p.message")


def leaves(values: DataFrame) -> DataFrame:
    """``values(id, v)`` with a variant of any form: ``id, path, text`` of every string in it. Objects and lists are exploded
    level by level until none is left, so fields that no form knows are found as well; a round is one level of the deepest value."""
    checkpoint_dir(values.sparkSession)
    frontier, found = values.select("id", F.lit("$").alias("path"), "v"), None
    while True:
        kind = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
        level = frontier.select("id", "path", "v", kind.alias("kind")).where("kind = 'STRING' OR startswith(kind, 'OBJECT') OR startswith(kind, 'ARRAY')").checkpoint()
        texts = level.where("kind = 'STRING'").select("id", "path", F.try_variant_get("v", "$", "string").alias("text"))
        found = texts if found is None else found.unionByName(texts)
        inner = level.where("kind <> 'STRING'")
        if inner.isEmpty():
            return found
        fields = inner.where("startswith(kind, 'OBJECT')").select("id", "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "v"))
        items = inner.where("startswith(kind, 'ARRAY')").select("id", "path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "v"))
        frontier = fields.select("id", F.concat("path", F.lit("."), "key").alias("path"), "v").unionByName(
            items.select("id", F.concat("path", F.lit("["), F.col("at").cast("string"), F.lit("]")).alias("path"), "v"))


def unsafe_text(answers: DataFrame) -> DataFrame:
    """Strings of answers that hold a delimiter tag or a dangerous character, by path, in whatever field they stand. Only answers
    that can hold one are taken apart: what is not in the text of an answer can be in its strings only through an escape."""
    can = F.contains("content", F.lit("\\")) | F.col("content").rlike(RESERVED) | F.col("content").rlike(DANGEROUS)
    rows = leaves(answers.where(can).select("id", F.try_parse_json("content").alias("v")).where("v IS NOT NULL"))
    tag, odd = F.col("text").rlike(RESERVED), F.col("text").rlike(DANGEROUS)
    return rows.where(tag | odd).select("id", "path", F.explode(F.array_compact(F.array(
        F.when(tag, "delimiter tag"), F.when(odd, "control or special character")))).alias("message"))


def validation_summary(problems: DataFrame, shown: int = 3) -> DataFrame:
    """First problems of every answer in one line, and how many more there are."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "path", "message")))
    texts = F.transform(F.slice(ordered, 1, shown), lambda p: F.concat(p["path"], F.lit(": "), p["message"]))
    rest = F.count("*") - shown
    return problems.groupBy("id").agg(F.concat(F.array_join(texts, "; "), F.when(rest > 0, F.concat(
        F.lit("; and "), rest.cast("string"), F.lit(" more"))).otherwise("")).alias("summary"))


def split_checks(analyses: DataFrame, templates: DataFrame) -> DataFrame:
    """Recommended checks of done runs: excluded with a reason when the command changes something, else with whether a
    command of the manual matches."""
    checks = parsed(analyses).select("id", F.posexplode("answer.recommended_checks").alias("pos", "c")) \
        .select("id", "pos", "c.purpose", neutralise(F.col("c.command")).alias("command"))
    judged = classify_distinct(checks).persist()
    distinct = judged.where("reason IS NULL").select(F.col("command").alias("check_id"), "command")
    verified = match_commands(distinct, templates).select("command", "verified")
    return join_by_count(checks, judged.join(verified, "command", "left"), "command").select("id", "pos", "purpose", "command", "reason", F.when(
        F.col("reason").isNull(), F.coalesce("verified", F.lit(False))).alias("verified"))


def check_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if("verified").alias("verified"),
                                    F.count("reason").alias("excluded"))
