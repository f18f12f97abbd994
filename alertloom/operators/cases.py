"""Case cards: drafts from runs, confirmation by people, similar cards, staleness and rendering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions import times
from alertloom.functions.text import milli_tokens, once, one_line, whole_tokens
from alertloom.operators.reports import parsed, shown_analysis

CARD_TOKENS = 300
# Length limits of card fields.
LIMITS = {"symptoms": 200, "cause": 300, "confirmation": 300, "action": 300}
NO_RECORD = "no record"


def draft_cases(incidents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Draft card of every incident from its shown run; only the title when there is none."""
    shown = shown_analysis(incidents, analyses)
    answers = parsed(analyses).select(F.col("id").alias("analysis_id"), "answer")
    checks = F.transform(F.slice("answer.recommended_checks", 1, 3), lambda c: c["purpose"])
    return (incidents.join(shown, "id", "left").join(answers, "analysis_id", "left").select(
        F.col("id").alias("incident_id"), "fingerprint", "host", "type", "title", "started_at", "resolved_at",
        one_line(F.coalesce("answer.summary", "title"), LIMITS["symptoms"]).alias("symptoms"),
        one_line(F.coalesce(F.try_element_at("answer.probable_causes", F.lit(1))["cause"], F.lit("")), LIMITS["cause"]).alias("cause"),
        one_line(F.coalesce(F.array_join(checks, ", "), F.lit("")), LIMITS["confirmation"]).alias("confirmation"),
        F.lit("").alias("action")))


def card_text(host: Column, kind: Column, occurred_on: Column, symptoms: Column, cause: Column, confirmation: Column,
              action: Column, recover_sec: Column) -> Column:
    def known(value: Column) -> Column:
        return F.when(value == "", NO_RECORD).otherwise(value)
    recover = F.coalesce(F.concat(F.floor(recover_sec / 60).cast("string"), F.lit(" min")), F.lit(NO_RECORD))
    return F.concat(F.lit("Host: "), host, F.lit("\nType: "), kind, F.lit("\nDate: "), occurred_on.cast("string"),
                    F.lit("\nSymptoms: "), symptoms, F.lit("\nConfirmed cause: "), cause, F.lit("\nHow it was confirmed: "),
                    known(confirmation), F.lit("\nAction or decision: "), known(action), F.lit("\nTime to recover: "), recover)


def confirm_cases(drafts: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Cards confirmed by people. ``verdicts(incident_id, id, at, verdict, note, symptoms, cause, confirmation, action)``:
    the newest one of an incident counts and its fields win over the draft; without a cause the row becomes a reject."""
    newest = verdicts.groupBy("incident_id").agg(F.max_by(F.struct(*[c for c in verdicts.columns if c != "incident_id"]),
                                                          F.struct("at", "id")).alias("v"))

    def chosen(name: str) -> Column:
        own = one_line(F.col(f"v.{name}"), LIMITS[name])
        return F.when(own != "", own).otherwise(F.col(name))
    note = one_line(F.col("v.note"), LIMITS["cause"])
    right = F.col("v.verdict") == "correct"
    cause = F.when(right, F.when(chosen("cause") != "", chosen("cause")).otherwise(note)) \
        .otherwise(F.when(note != "", note).otherwise(chosen("cause")))
    reject = F.when(~F.col("v.verdict").isin("correct", "corrected"), "unknown verdict").when(cause == "", "cause missing")
    return (drafts.join(newest, "incident_id")
            .select("incident_id", "fingerprint", one_line(F.col("host"), 120).alias("host"), "type", one_line(F.col("title"), 120).alias("title"),
                    chosen("symptoms").alias("symptoms"), cause.alias("cause"), chosen("confirmation").alias("confirmation"),
                    chosen("action").alias("action"), times.time_to_recover(F.col("started_at"), F.col("resolved_at")).alias("time_to_recover_sec"),
                    F.to_date("started_at").alias("occurred_on"), F.col("v.verdict").alias("verdict"), F.lit("approved").alias("status"),
                    now.alias("approved_at"), reject.alias("reject_reason")))


def fit_card(cards: DataFrame, limit: int = CARD_TOKENS) -> DataFrame:
    """Halve action, then confirmation, then symptoms until the card fits; the cause is never cut.

    The halvings of a field are a fixed short ladder (300 characters are gone after nine). The whole card is estimated once: a field
    stands between a colon and a line end, so a step adds what its own text differs in.
    """
    def milli(name: str, value: Column) -> Column:
        shown = value if name == "symptoms" else F.when(value == "", NO_RECORD).otherwise(value)
        return milli_tokens(F.concat(F.lit(" "), shown))

    def halved(name: str, value: Column) -> Column:
        half = F.concat(F.regexp_replace(F.substr(value, F.lit(1), F.floor(F.length(value) / 2).cast("int")), r"(?U)\s+\z", ""), F.lit("…"))
        return once(half, lambda cut: F.struct(cut.alias("text"), milli(name, cut).alias("milli")))
    out = cards.withColumn("_milli", milli_tokens(card_text(*[F.col(c) for c in (
        "host", "type", "occurred_on", "symptoms", "cause", "confirmation", "action", "time_to_recover_sec")])))
    for name in ("action", "confirmation", "symptoms"):
        out = out.withColumn("_own", F.when(whole_tokens(F.col("_milli")) > limit, F.struct(F.col(name).alias("text"), milli(name, F.col(name)).alias("milli"))))
        over = lambda x: whole_tokens(F.col("_milli") - F.col("_own.milli") + x["milli"]) > limit
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.col("_own"), lambda x, _: F.when(
            over(x) & (F.length(x["text"]) > 2), halved(name, x["text"])).otherwise(x))
        out = out.withColumn("_cut", F.when(F.col("_own").isNotNull(), steps)).withColumns({
            name: F.when(F.col("_own").isNull(), F.col(name)).otherwise(F.col("_cut.text")),
            "_milli": F.when(F.col("_own").isNull(), F.col("_milli")).otherwise(F.col("_milli") - F.col("_own.milli") + F.col("_cut.milli"))})
    return out.withColumn("tokens", whole_tokens(F.col("_milli"))).drop("_milli", "_own", "_cut")


def similar_cases(incidents: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best cards of the same type for every incident, its own card left out: same fingerprint first, then the
    same host, then the rest; approved before stale; newest first.

    Every group of cards (a fingerprint, a host, a type) is cut to its best few before it meets the incidents, so an
    incident is compared with a handful of cards however many there are.
    """
    keep = k + 1  # one of them may be the incident's own
    rank = [F.when(F.col("status") == "approved", 0).otherwise(1), F.desc("approved_at"), F.desc("id")]

    def best(*keys: str) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*keys).orderBy(*rank))
        cut = cases.select(*dict.fromkeys(("type", *keys)), F.struct(
            F.when(F.col("status") == "approved", 0).otherwise(1).alias("stale"), (-times.seconds(F.col("approved_at"))).alias("age"),
            (-F.col("id")).alias("o"), F.col("incident_id").alias("own"), F.col("fingerprint").alias("print"), F.col("host").alias("at")).alias("card"),
            nth.alias("nth")).where(F.col("nth") <= keep)
        return cut.groupBy("type", *[c for c in keys if c != "type"]).agg(F.collect_list("card").alias("cards_" + keys[-1]))
    # a type may fill its best few with cards of one fingerprint or host; these rank higher for an incident that shares
    # them and are then the same cards, so the union of the three cuts always holds the right answer
    pools = incidents.select("id", "type", "fingerprint", "host")
    pools = pools.join(best("type"), "type", "left")
    pools = pools.join(best("type", "fingerprint"), ["type", "fingerprint"], "left")
    pools = pools.join(best("type", "host"), ["type", "host"], "left")
    empty = F.array().cast("array<struct<stale:int,age:bigint,o:bigint,own:bigint,print:string,at:string>>")
    merged = F.array_distinct(F.flatten(F.array(*[F.coalesce(f"cards_{n}", empty) for n in ("fingerprint", "host", "type")])))
    scored = F.transform(F.filter(merged, lambda c: c["own"] != F.col("id")), lambda c: F.struct(
        F.when(c["print"] == F.col("fingerprint"), 0).when(c["at"] == F.col("host"), 1).otherwise(2).alias("near"),
        c["stale"].alias("stale"), c["age"].alias("age"), c["o"].alias("o")))
    return (pools.select("id", F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("pos", "c"))
            .select("id", "pos", (-F.col("c.o")).alias("case_id"), F.col("c.near").alias("near")))


def mark_stale(cases: DataFrame, reason: str, hosts: list[str] | None = None) -> DataFrame:
    """Approved cards of the hosts, or all approved cards, become stale."""
    hit = F.col("status") == "approved"
    if hosts is not None:
        hit = hit & F.col("host").isin(*hosts)
    return cases.withColumns({"status": F.when(hit, "stale").otherwise(F.col("status")),
                              "stale_reason": F.when(hit, one_line(F.lit(reason), 200))})


def render_cases(cases: DataFrame) -> DataFrame:
    return cases.select("id", "incident_id", "status", card_text(*[F.col(c) for c in (
        "host", "type", "occurred_on", "symptoms", "cause", "confirmation", "action", "time_to_recover_sec")]).alias("text"))


def cases_markdown(cases: DataFrame) -> DataFrame:
    """One Markdown block per card."""
    from alertloom.functions.codes import incident_label
    block = F.concat(F.lit("## Case "), F.col("id").cast("string"), F.lit(" ("), incident_label(F.col("incident_id")), F.lit(", "),
                     F.col("status"), F.lit(")\n\n"), F.col("text"), F.lit("\n"))
    return render_cases(cases).select("id", block.alias("block"))
