"""Raw problems and security alerts to normalised alerts. Raw input is semi-structured and read through ``VARIANT``: an
element that is mistyped becomes a reject with a reason and costs no other element anything."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import codes, times
from alertloom.functions.text import clean_text
from alertloom.operators.scans import settled
from alertloom.settings import (HOST_LIMIT, ID_LIMIT, KEPT_HOSTS, KEPT_ITEMS, KEPT_TAGS, LOG_LIMIT, OPDATA_LIMIT, PROBLEM, SECURITY, TITLE_LIMIT,
                                Settings)

LONE_SURROGATE = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def explode_captures(captures: DataFrame) -> DataFrame:
    """``captures(value)`` holds JSON arrays as text: one row per element as a variant, with the capture's number in
    ``origin``. A text that is no array gives one row without element."""
    clean = F.regexp_replace("value", LONE_SURROGATE, "")
    parsed = captures.select("origin", F.try_parse_json(clean).alias("doc"))
    is_array = F.coalesce(F.schema_of_variant("doc").startswith("ARRAY"), F.lit(False))
    # a text is read once: one that is no array is taken as an array of one missing element
    items = F.when(is_array, F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.array(F.lit(None).cast("variant")))
    return parsed.select("origin", F.posexplode(items).alias("pos", "item"))


def _kind(item: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(item, path, "variant")), F.lit("VOID"))


def _is_scalar(item: Column, path: str) -> Column:
    kind = _kind(item, path)
    return ~(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "BOOLEAN"))


def _text(item: Column, path: str, limit: int) -> Column:
    return clean_text(F.try_variant_get(item, path, "string"), limit)


def _objects(item: Column, path: str) -> Column:
    """Elements of an array that are objects; an empty array when there is none."""
    found = F.coalesce(F.try_variant_get(item, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(found, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))


def _whole(item: Column, path: str) -> Column:
    return F.when(_is_scalar(item, path), F.try_variant_get(item, path, "string")).try_cast("bigint")


def _not_list(item: Column, path: str) -> Column:
    kind = _kind(item, path)
    return ~(kind.startswith("ARRAY") | (kind == "VOID"))


def _not_map(item: Column, path: str) -> Column:
    kind = _kind(item, path)
    return ~(kind.startswith("OBJECT") | (kind == "VOID"))


def _first(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for bad, reason in checks])


def normalize_problems(items: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Problems to alerts; ``reject_reason`` is set where an element is not usable."""
    v = F.col("item")
    base = items.select("origin", "pos", "item", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"))
    base = base.withColumns({
        "external_id": _text(v, "$.eventid", ID_LIMIT), "trigger_id": _text(v, "$.objectid", ID_LIMIT), "level": _whole(v, "$.severity"),
        "clock": _whole(v, "$.clock"), "r_clock": F.coalesce(F.nullif(F.try_variant_get(v, "$.r_clock", "string"), F.lit("")), F.lit("0")).try_cast("bigint"),
        "r_eventid": F.coalesce(F.nullif(_text(v, "$.r_eventid", ID_LIMIT), F.lit("")), F.lit("0")), "title": _text(v, "$.name", TITLE_LIMIT),
        "tags": F.transform(_objects(v, "$.tags"), lambda t: F.struct(_text(t, "$.tag", 100).alias("tag"), _text(t, "$.value", TITLE_LIMIT).alias("value"))),
        "hosts": F.transform(_objects(v, "$.hosts"), lambda h: F.struct(_text(h, "$.hostid", ID_LIMIT).alias("hostid"), _text(h, "$.host", HOST_LIMIT).alias("host"),
                                                                       _text(h, "$.name", HOST_LIMIT).alias("name"))),
        "items": F.transform(_objects(v, "$.items"), lambda i: F.struct(_text(i, "$.itemid", ID_LIMIT).alias("itemid"), _text(i, "$.key_", 255).alias("key_"),
                                                                       _text(i, "$.name", TITLE_LIMIT).alias("name")))})
    base = settled(base, *[c for c in base.columns if c not in ("origin", "pos", "item")])
    started = times.epoch_time(F.col("clock").cast("string"))
    recovered = times.epoch_time(F.col("r_clock").cast("string"))
    reason = _first(
        (~F.col("is_object"), "not an object"), (~_is_scalar(v, "$.eventid") | (F.col("external_id") == ""), "eventid missing or mistyped"),
        (~_is_scalar(v, "$.objectid") | (F.col("trigger_id") == ""), "objectid missing or mistyped"),
        (F.col("level").isNull() | F.col("clock").isNull() | F.col("r_clock").isNull(), "number unreadable"),
        (~F.col("level").between(0, 5), "severity out of range"), (started.isNull(), "time out of range"),
        ((F.col("r_clock") != 0) & recovered.isNull(), "recovery time out of range"), (_not_list(v, "$.hosts"), "hosts is no list"),
        (_not_list(v, "$.tags"), "tags is no list"), (_not_list(v, "$.items"), "items is no list"), (~_is_scalar(v, "$.r_eventid"), "r_eventid mistyped"))
    keys = F.transform("items", lambda i: i["key_"])
    host = F.coalesce(F.nullif(F.get("hosts", F.lit(0))["host"], F.lit("")), F.lit("unknown"))
    resolved = F.col("r_eventid") != "0"
    raw = F.to_json(F.struct(F.col("external_id").alias("eventid"), F.col("trigger_id").alias("objectid"), F.col("clock").cast("string").alias("clock"),
                             F.col("level").cast("string").alias("severity"), F.col("title").alias("name"), _text(v, "$.opdata", OPDATA_LIMIT).alias("opdata"),
                             "r_eventid", F.col("r_clock").cast("string").alias("r_clock"), F.slice("tags", 1, KEPT_TAGS).alias("tags"),
                             F.slice("hosts", 1, KEPT_HOSTS).alias("hosts"), F.slice("items", 1, KEPT_ITEMS).alias("items")))
    source = F.lit(PROBLEM)
    return base.select(
        "origin", "pos", source.alias("source"), "external_id", host.alias("host"), codes.classify_problem(F.col("tags"), keys, cfg.type_rules).alias("type"),
        codes.severity_label(source, F.col("level")).alias("source_severity"), F.greatest(F.lit(1), F.col("level")).cast("int").alias("severity"),
        F.when(F.col("title") == "", "(no title)").otherwise(F.col("title")).alias("title"), started.alias("started_at"),
        F.when(resolved, F.coalesce(recovered, now)).alias("resolved_at"), F.when(resolved, "resolved").otherwise("open").alias("problem_status"),
        codes.fingerprint(source, host, F.col("trigger_id")).alias("fingerprint"), (F.col("level") >= cfg.min_severity).alias("analyzable"),
        codes.is_availability(keys, F.col("tags")).alias("availability"), raw.alias("raw"), reason.alias("reject_reason"))


def normalize_security(items: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Security alerts to alerts; ``reject_reason`` is set where an element is not usable."""
    v = F.col("item")
    base = items.select("origin", "pos", "item", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"))
    base = base.withColumns({
        "external_id": _text(v, "$._id", ID_LIMIT), "rule_id": _text(v, "$._source.rule.id", ID_LIMIT), "level": _whole(v, "$._source.rule.level"),
        "started_at": F.date_trunc("second", times.parse_time(F.try_variant_get(v, "$._source.timestamp", "string"))),
        "agent": _text(v, "$._source.agent.name", HOST_LIMIT), "srcip": _text(v, "$._source.data.srcip", 64),
        "description": _text(v, "$._source.rule.description", TITLE_LIMIT),
        "groups": F.transform(F.coalesce(F.try_variant_get(v, "$._source.rule.groups", "array<string>"), F.array().cast("array<string>")), lambda g: clean_text(g, 100))})
    base = settled(base, *[c for c in base.columns if c not in ("origin", "pos", "item")])
    reason = _first(
        (~F.col("is_object"), "not an object"), (~_is_scalar(v, "$._id") | (F.col("external_id") == ""), "_id missing or mistyped"),
        (~_is_scalar(v, "$._source.rule.id") | (F.col("rule_id") == ""), "rule.id missing or mistyped"), (F.col("level").isNull(), "rule.level unreadable"),
        (F.col("started_at").isNull(), "timestamp unreadable or out of range"), (_not_map(v, "$._source.agent"), "agent is no object"),
        (_not_map(v, "$._source.data"), "data is no object"), (_not_list(v, "$._source.rule.groups"), "rule.groups is no list"),
        (_not_map(v, "$._source.syscheck"), "syscheck is no object"), (~_is_scalar(v, "$._source.agent.name"), "agent.name mistyped"),
        (~_is_scalar(v, "$._source.data.srcip"), "data.srcip mistyped"))
    host = F.when(F.col("agent") == "", "unknown").otherwise(F.col("agent"))
    path, event = _text(v, "$._source.syscheck.path", 300), _text(v, "$._source.syscheck.event", 300)
    kept = F.struct(_text(v, "$._source.timestamp", 40).alias("timestamp"), F.struct(_text(v, "$._source.agent.id", ID_LIMIT).alias("id"), host.alias("name")).alias("agent"),
                    F.struct(F.col("rule_id").alias("id"), "level", "description", "groups").alias("rule"),
                    F.struct("srcip", _text(v, "$._source.data.dstuser", 64).alias("dstuser")).alias("data"),
                    F.struct(F.nullif(path, F.lit("")).alias("path"), F.nullif(event, F.lit("")).alias("event")).alias("syscheck"),
                    _text(v, "$._source.full_log", LOG_LIMIT).alias("full_log"))
    source = F.lit(SECURITY)
    return base.select(
        "origin", "pos", source.alias("source"), "external_id", host.alias("host"), codes.classify_security(F.col("rule_id"), F.col("groups"), cfg.type_rules).alias("type"),
        codes.severity_label(source, F.col("level")).alias("source_severity"), codes.severity_from_level(F.col("level")).alias("severity"),
        F.when(F.col("description") == "", F.concat(F.lit("Security rule "), "rule_id")).otherwise(F.col("description")).alias("title"), "started_at",
        F.lit(None).cast("timestamp").alias("resolved_at"), F.lit("oneshot").alias("problem_status"),
        codes.fingerprint(source, host, F.concat("rule_id", F.lit("|"), "srcip")).alias("fingerprint"),
        codes.is_analyzable(source, F.col("level"), F.col("rule_id"), cfg).alias("analyzable"), F.lit(False).alias("availability"),
        F.to_json(F.struct(F.col("external_id").alias("_id"), kept.alias("_source"))).alias("raw"), reason.alias("reject_reason"))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and rejects with their reason."""
    return (df.where("reject_reason IS NULL").drop("reject_reason"),
            df.where("reject_reason IS NOT NULL").select("source", "external_id", "origin", "pos", "reject_reason"))


def first_rejects(rejects: DataFrame) -> DataFrame:
    """Every rejected key once, with the reason it was rejected for first."""
    return rejects.groupBy("source", "external_id").agg(F.min_by("reject_reason", F.struct("origin", "pos")).alias("reject_reason"),
                                                        F.count("*").alias("times"))
