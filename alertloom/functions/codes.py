"""Identifiers, severities, types, labels and states."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.settings import AVAILABILITY_KEY_PREFIXES, PROBLEM, SEVERITY_NAMES, Settings, TypeRules

# Display text of the codes.
TYPE_LABELS = {"cpu": "CPU", "mem": "Memory", "swap": "Swap", "disk": "Disk", "io": "I/O", "net": "Network",
               "container": "Container", "service": "Service", "auth": "Authentication", "user": "User",
               "file": "File change", "pkg": "Package", "other": "Other"}
KIND_LABELS = {"availability": "Availability", "performance": "Performance", "security": "Security",
               "configuration": "Configuration", "noise": "Noise"}
URGENCY_LABELS = {"now": "Right now", "today": "Today", "watch": "Watch", "ignore": "Can be ignored"}
CONFIDENCE_LABELS = {"high": "High", "medium": "Medium", "low": "Low"}
EVENT_LABELS = {
    "detected": "Detected", "recurred": "Recurred", "resolved": "Resolved", "reopened": "Reopened",
    "queued": "Entered the queue", "grouped": "Joined a group", "group_created": "Group created",
    "analysis_started": "Analysis started", "analysis_done": "Analysis done", "analysis_failed": "Analysis failed",
    "retry_scheduled": "Retry scheduled", "released": "Returned to the queue", "prioritized": "Moved to the front",
    "skipped": "Skipped", "requeued": "Analysed again", "followup_queued": "Follow-up", "regenerated": "Made again",
    "case_registered": "Registered as a case", "feedback": "Feedback recorded", "read": "Marked read",
    "checks_excluded": "Checks excluded by rule", "probed": "State probed", "probe_run": "Probe run"}
FAIL_LABELS = {"timeout": "The model took too long", "validation": "The answer failed validation",
               "truncated": "The answer broke off", "context": "The prompt could not be built",
               "internal": "Unexpected failure", "length": "The answer reached its limit",
               "invalid_response": "The answer could not be read"}
SKIP_LABELS = {"below_threshold": "Below the threshold", "resolved_too_long": "Resolved long ago",
               "not_analyzable": "Not an analysed type"}
PHASE_LABELS = {"context": "Collecting context", "inference": "Inference", "validation": "Validation",
                "finished": "Finished"}
PROBE_LABELS = {"ok": "Succeeded", "timeout": "Timed out", "unreachable": "Unreachable", "refused": "Refused",
                "failed": "Failed", "skipped": "Skipped"}
FEEDBACK_LABELS = {"helpful": "Helpful", "wrong": "Wrong", "corrected": "Cause corrected"}
VERDICT_LABELS = {"correct": "Cause was right", "corrected": "Cause corrected"}


def label(code: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Display text of a code; a code outside the table stays as it is, unless a default is given."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, code), code if default is None else default)


def fingerprint(source: Column, host: Column, key: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``source|host|key``."""
    return F.substring(F.sha2(F.concat_ws("|", source, host, key), 256), 1, 16)


def severity_from_level(level: Column) -> Column:
    return (F.when(level >= 15, 5).when(level >= 12, 4).when(level >= 10, 3).when(level >= 7, 2).otherwise(1)
            .cast("int"))


def severity_label(source: Column, level: Column) -> Column:
    names = F.array(*[F.lit(n) for n in SEVERITY_NAMES])
    return F.when(source == PROBLEM, F.concat(F.lit("Problem "), F.try_element_at(names, level.cast("int") + 1))) \
        .otherwise(F.concat(F.lit("Security level "), level.cast("string")))


def severity_of(source: Column, level: Column) -> Column:
    """Severity 1 to 5: a problem keeps its own level with a floor of 1, a security level is graded."""
    return F.when(source == PROBLEM, F.greatest(F.lit(1), level.cast("int"))).otherwise(severity_from_level(level))


def is_analyzable(source: Column, level: Column, rule_id: Column, cfg: Settings = Settings()) -> Column:
    named = F.coalesce(rule_id.isin(*cfg.named_rules), F.lit(False)) if cfg.named_rules else F.lit(False)
    return F.when(source == PROBLEM, level >= cfg.min_severity).otherwise((level >= cfg.min_level) | named)


def is_availability(item_keys: Column, tags: Column) -> Column:
    """``item_keys`` is an array of strings, ``tags`` an array of structs with tag and value."""
    def unreachable(key: Column) -> Column:
        found = F.lit(False)
        for prefix in AVAILABILITY_KEY_PREFIXES:
            found = found | key.startswith(prefix)
        return found
    scoped = F.exists(tags, lambda t: F.coalesce((t["tag"] == "scope") & (t["value"] == "availability"), F.lit(False)))
    return F.coalesce(F.exists(item_keys, unreachable), F.lit(False)) | F.coalesce(scoped, F.lit(False))


def classify_problem(tags: Column, item_keys: Column, rules: TypeRules = TypeRules()) -> Column:
    """First known component tag in tag order, else the first key prefix in rule order, else ``other``."""
    table = F.create_map(*[F.lit(x) for pair in rules.component_tags.items() for x in pair])
    kinds = F.transform(F.filter(tags, lambda t: t["tag"] == "component"), lambda t: F.try_element_at(table, t["value"]))
    by_tag = F.try_element_at(F.filter(kinds, lambda k: k.isNotNull()), F.lit(1))

    def some_key(prefix: str) -> Column:
        return F.exists(item_keys, lambda key: key.startswith(prefix))
    by_key = F.coalesce(*[F.when(some_key(p), F.lit(kind)) for p, kind in rules.key_prefixes])
    return F.coalesce(by_tag, by_key, F.lit("other"))


def classify_security(rule_id: Column, groups: Column, rules: TypeRules = TypeRules()) -> Column:
    """Type by rule id, else by the first matching group in rule order, else ``other``."""
    table = F.create_map(*[F.lit(x) for pair in rules.rule_ids.items() for x in pair])
    by_group = F.coalesce(*[F.when(F.array_contains(groups, name), F.lit(kind)) for name, kind in rules.groups])
    return F.coalesce(F.try_element_at(table, rule_id), by_group, F.lit("other"))


def incident_label(number: Column) -> Column:
    return F.concat(F.lit("I-"), F.when(F.length(number.cast("string")) < 4, F.lpad(number.cast("string"), 4, "0"))
                    .otherwise(number.cast("string")))


def parse_incident_label(text: Column) -> Column:
    """The number in ``I-0001``, ``i-1`` or ``1``; null for anything else."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(?:[Ii]-)?([0-9]{1,18})$", 1), F.lit("")).cast("bigint")


def short_host(host: Column) -> Column:
    """Host name without the suffix of its environment; a name that is only a suffix stays."""
    name = F.regexp_replace(host, "-production$", "")
    name = F.regexp_replace(F.regexp_replace(name, "-staging$", ""), "-development$", "")
    return F.when(name == "", host).otherwise(name)


def state_bucket(state: Column) -> Column:
    return (F.when(state.isin("held", "queued", "retry_wait"), "wait").when(state == "running", "run")
            .when(state == "done", "done").when(state == "failed", "fail").when(state == "skipped", "skip")
            .otherwise("other"))


def skip_text(reason: Column) -> Column:
    return F.when(reason.startswith("manual: "), F.concat(F.lit("Skipped: "), F.substr(reason, F.lit(9)))) \
        .otherwise(label(F.coalesce(reason, F.lit("")), SKIP_LABELS, F.lit("Skipped")))


# How the metrics monitor words a refused login.
NOT_AUTHORIZED = r"(?i)not authori[sz]ed|no permissions|session terminated|re-?login|token.{0,20}expired"


def error_kind(status: Column, message: Column) -> Column:
    """Kind of a failed request from its HTTP status; with status 200 the message decides."""
    return (F.when(status.isin(401, 403), "auth").when(status == 429, "throttled").when(status >= 500, "server")
            .when(status == 200, F.when(F.coalesce(message, F.lit("")).rlike(NOT_AUTHORIZED), "auth").otherwise("rpc"))
            .otherwise("client"))


def allowed_actions(state: Column, has_done: Column, probes: Column, attachable: Column) -> Column:
    """Names of the actions an operator may take in this state."""
    ended = state.isin("done", "failed", "skipped")
    waits = state.isin("held", "queued", "retry_wait")
    judged = (state == "done") | has_done
    steps = [(waits, "prioritize"), (waits, "skip"), (ended, "reanalyze"), (ended & attachable, "reanalyze_with_probes"),
             (judged, "feedback"), (judged, "case"), (probes & (state != "running"), "probe")]
    return F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in steps]))
