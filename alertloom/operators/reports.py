"""Reports over incidents, their runs and their log."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions import codes, times
from alertloom.functions.text import CONTROL, neutralise
from alertloom.operators import queueing
from alertloom.schemas import ANSWER
from alertloom.settings import GROUP, WAITING, Settings


def state_counts(incidents: DataFrame, day: str, cfg: Settings = Settings()) -> DataFrame:
    """One row of counts: by state, and for the local day what was analysed, not yet read, and skipped."""
    bucket = codes.state_bucket(F.col("analysis_state"))
    done_today = (F.col("analysis_state") == "done") & times.in_local_day(F.col("analyzed_at"), day, cfg.timezone)
    skipped_today = (F.col("analysis_state") == "skipped") & times.in_local_day(F.col("updated_at"), day, cfg.timezone)
    return incidents.agg(
        F.count_if(bucket == "wait").alias("waiting"), F.count_if(bucket == "run").alias("running"),
        F.count_if(done_today).alias("done"), F.count_if(done_today & F.col("read_at").isNull()).alias("unread"),
        F.count_if(bucket == "fail").alias("failed"), F.count_if(skipped_today).alias("skipped"))


def sections(incidents: DataFrame, day: str, cfg: Settings = Settings(), state: str | None = None,
             host: str | None = None) -> DataFrame:
    """The four lists of the day, each in its own order and up to the row limit of a list."""
    s = F.col("analysis_state")
    section = (F.when(s.isin(*WAITING, "running") & F.col("group_id").isNull(), "active")
               .when((s == "done") & times.in_local_day(F.col("analyzed_at"), day, cfg.timezone), "done")
               .when(s == "failed", "failed")
               .when((s == "skipped") & times.in_local_day(F.col("updated_at"), day, cfg.timezone), "skipped"))
    rows = incidents.withColumn("section", section).where("section IS NOT NULL")
    if host:
        rows = rows.where(F.col("host") == host)
    if state:
        rows = rows.where(codes.state_bucket(s) == state)
    active = F.col("section") == "active"
    order = [F.when(active & (s == "running"), 0).otherwise(1), F.desc(F.when(active, F.col("priority"))),
             F.desc(F.when(active, F.col("started_at")).when(F.col("section") == "done", F.col("analyzed_at"))
                    .otherwise(F.col("updated_at"))), F.desc("id")]
    # a rank with a bound: every task keeps only the first rows of each list before anything is shuffled
    return (rows.withColumn("position", F.row_number().over(W.partitionBy("section").orderBy(*order)))
            .where(F.col("position") <= cfg.max_rows))


def incident_rows(incidents: DataFrame, positions: DataFrame, typical: DataFrame, now: Column,
                  cfg: Settings = Settings()) -> DataFrame:
    """Display row of every incident."""
    s = F.col("analysis_state")
    age = times.seconds(now) - times.seconds(F.col("started_at"))
    healed = times.time_to_recover(F.col("started_at"), F.col("resolved_at"))
    resolved = (F.col("problem_status") == "resolved") & F.col("resolved_at").isNotNull()
    ahead = F.coalesce("ahead", F.lit(0)).cast("string")
    eta = times.local_clock(F.col("expected_at"), cfg.timezone)
    why = (F.when(s == "held", "collecting more")
           .when((s == "retry_wait") & F.col("next_retry_at").isNotNull(),
                 F.concat(F.lit("retry at "), times.local_clock(F.col("next_retry_at"), cfg.timezone)))
           .when(s.isin("queued", "retry_wait"), F.when(F.col("expected_at").isNotNull(), F.concat(
               ahead, F.lit(" ahead, expected at "), eta)).otherwise(F.concat(ahead, F.lit(" ahead"))))
           .when(s == "failed", codes.label(F.coalesce("fail_reason", F.lit("")), codes.FAIL_LABELS,
                                            F.coalesce("fail_reason", F.lit("Analysis failed"))))
           .when(s == "skipped", codes.skip_text(F.col("skip_reason"))))
    return incidents.join(positions.select("id", "ahead", "expected_at"), "id", "left").select(
        "id", codes.incident_label(F.col("id")).alias("label"), codes.state_bucket(s).alias("state"),
        F.when(s == "done", F.col("urgency")).alias("urgency"), "title", codes.short_host(F.col("host")).alias("host"),
        times.local_clock(F.col("started_at"), cfg.timezone).alias("time"),
        ((s == "done") & F.col("read_at").isNull()).alias("unread"),
        F.when(F.col("problem_status") == "open", F.concat(F.lit("open for "), times.duration_text(age))).alias("live"),
        F.when(F.col("problem_status") == "open", F.lit(None)).when(resolved, F.concat(
            F.lit("recovered after "), times.duration_text(healed))).otherwise("single event").alias("healed"),
        why.alias("why"), F.col("occurrence_count").alias("count"), (F.col("priority") > 0).alias("priority"))


def day_band(incidents: DataFrame, day: str, cfg: Settings = Settings()) -> DataFrame:
    """Place of every incident of the local day on a 24 h axis, in percent."""
    s = F.col("analysis_state")
    begin = times.day_start(F.lit(day), cfg.timezone)
    today = incidents.where(times.in_local_day(F.col("started_at"), day, cfg.timezone) & F.col("group_id").isNull())
    color = (F.when((s == "done") & F.col("urgency").isNotNull(), F.col("urgency")).when(s == "running", "running")
             .when(s == "failed", "failed").when(s.isin(*WAITING), "waiting").otherwise("out"))
    return today.select("id", F.round((times.seconds(F.col("started_at")) - times.seconds(begin)) / 864, 2).alias("x"),
                        color.alias("class"), (~((s == "done") & F.col("urgency").isNotNull())).alias("ring"))


def _json(name: str) -> Column:
    return F.coalesce(F.get_json_object("detail_json", f"$.{name}"), F.lit(""))


def timeline(log: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Label of every log entry and a note whose source depends on the kind."""
    kind, reason = F.col("type"), _json("reason")
    note = (F.when(kind == "skipped", F.when(_json("note") != "", _json("note")).otherwise(codes.label(reason, codes.SKIP_LABELS)))
            .when(kind.isin("analysis_failed", "retry_scheduled", "released"), codes.label(reason, codes.FAIL_LABELS))
            .when(kind == "feedback", codes.label(_json("verdict"), codes.FEEDBACK_LABELS, F.lit("")))
            .when(kind == "case_registered", codes.label(_json("verdict"), codes.VERDICT_LABELS, F.lit("")))
            .when(kind == "analysis_done", codes.label(_json("urgency"), codes.URGENCY_LABELS, F.lit("")))
            .when(kind == "checks_excluded", F.concat(_json("count"), F.lit(" checks")))
            .when(kind == "probed", F.concat(_json("count"), F.lit(" probes, "), _json("ok"), F.lit(" succeeded")))
            .when(kind == "probe_run", F.concat(_json("name"), F.lit(": "), codes.label(_json("status"), codes.PROBE_LABELS)))
            .otherwise(""))
    local = F.from_utc_timestamp("at", cfg.timezone)
    return log.select("id", "incident_id", "type", F.date_format(local, "MM/dd").alias("day"),
                      times.local_clock(F.col("at"), cfg.timezone).alias("time"),
                      codes.label(kind, codes.EVENT_LABELS).alias("label"), note.alias("note"))


def shown_analysis(incidents: DataFrame, analyses: DataFrame) -> DataFrame:
    """The run an incident points to when that is done, else its latest done run; null when there is none."""
    done = analyses.where("status = 'done'").select("incident_id", F.col("id").alias("analysis_id"))
    latest = done.groupBy("incident_id").agg(F.max("analysis_id").alias("latest"))
    pointed = incidents.select("id", "latest_analysis_id").join(
        done.select(F.col("incident_id").alias("id"), F.col("analysis_id").alias("latest_analysis_id"), F.lit(True).alias("hit")),
        ["id", "latest_analysis_id"], "left")
    return pointed.join(latest, F.col("id") == F.col("incident_id"), "left").select(
        "id", F.coalesce(F.when(F.col("hit"), F.col("latest_analysis_id")), "latest").alias("analysis_id"))


def parsed(analyses: DataFrame) -> DataFrame:
    """Done runs with their answer as a struct; null where the stored text is no such object."""
    return analyses.where("status = 'done'").withColumn("answer", F.from_json("result_json", ANSWER))


def explode_answer(analyses: DataFrame) -> DataFrame:
    """Answers as a long table: one row per cause, check, service, incident, change and unknown. An answer is parsed once and
    its lists are put one behind the other; what is no answer has no lists."""
    none = F.lit(None).cast("string")

    def part(name: str, items: Column, body: Callable[[Column], Column], extra: Callable[[Column], Column]) -> Column:
        rows = F.transform(items, lambda item, pos: F.struct(F.lit(name).alias("part"), pos.alias("pos"), body(item).alias("body"), extra(item).alias("extra")))
        return F.coalesce(rows, F.array().cast("array<struct<part:string,pos:int,body:string,extra:string>>"))
    a = F.col("answer")
    lists = [part("cause", a["probable_causes"], lambda c: c["cause"], lambda c: codes.label(c["confidence"], codes.CONFIDENCE_LABELS)),
             part("check", a["recommended_checks"], lambda c: c["purpose"], lambda c: c["command"])]
    for name, items in (("service", a["impact"]["services"]), ("incident", a["correlation"]["incidents"]), ("change", a["correlation"]["changes"]),
                        ("unknown", a["unknowns"])):
        lists.append(part(name, items, lambda text: text, lambda _: none))
    return parsed(analyses).select("id", F.explode(F.concat(*lists)).alias("r")).select("id", "r.*")


def feedback_ratio(log: DataFrame, since: Column) -> DataFrame:
    """Counts of verdicts and the percentage of helpful ones, null when there is no verdict."""
    verdict = F.get_json_object("detail_json", "$.verdict")
    row = log.where((F.col("type") == "feedback") & (F.col("at") >= since)).agg(
        *[F.count_if(verdict == v).alias(v) for v in ("helpful", "wrong", "corrected")])
    total = F.col("helpful") + F.col("wrong") + F.col("corrected")
    return row.withColumn("total", total).withColumn(
        "helpful_percent", F.bround(F.try_divide(F.col("helpful") * 100, total)).cast("int"))


def change_mark(incidents: DataFrame, log: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row that differs whenever incidents, log or finished runs change."""
    runs = F.concat_ws("/", *[F.count_if(F.col("status") == s).cast("string") for s in ("running", "done", "failed")])
    one = incidents.agg(F.max("updated_at").alias("incidents_updated"), F.count("*").alias("incidents_count"))
    two = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("events_id"))
    three = analyses.agg(F.coalesce(F.max("id"), F.lit(0)).alias("analyses_id"), F.max("finished_at").alias("analyses_finished"),
                         runs.alias("analyses_states"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


def changed_incidents(incidents: DataFrame, log: DataFrame, analyses: DataFrame, since_time: Column, since_event: int,
                      since_run: int) -> DataFrame:
    """Ids touched after a mark, from the three tables."""
    return (incidents.where(F.col("updated_at") > since_time).select("id")
            .union(log.where(F.col("id") > since_event).select("incident_id"))
            .union(analyses.where((F.col("id") > since_run) | (F.col("finished_at") > since_time)).select("incident_id"))
            .distinct())


def running_progress(analyses: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    elapsed = F.greatest(F.lit(0).cast("bigint"), times.seconds(now) - times.seconds(F.col("started_at")))
    percent = F.least(F.lit(100), F.floor(F.col("tokens_so_far") * 100 / cfg.max_output_tokens).cast("int"))
    return analyses.where("status = 'running'").select(
        "id", "incident_id", codes.label(F.col("phase"), codes.PHASE_LABELS).alias("phase"),
        F.col("tokens_so_far").alias("tokens"), elapsed.alias("elapsed_sec"), percent.alias("percent"))


def host_history(incidents: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """For every incident the newest ``history_max`` others of its host or of the root host.

    Each host keeps its newest few first (a bounded rank, cut before the shuffle), so a noisy host costs no more than
    a quiet one and no incident meets all others of its host.
    """
    own = pools_of_hosts(incidents.select("id", "host"), newest_of_hosts(incidents, now, cfg), cfg)
    others = F.slice(others_of(F.col("pool"), F.col("root_pool")), 1, cfg.history_max)
    return own.select("id", F.posexplode(others).alias("pos", "e")).select("id", "pos", F.col("e.other_id").alias("other_id"))


def newest_of_hosts(incidents: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """The newest ``history_max`` + 1 incidents of every host: one of them may be the one that asks."""
    since = times.add_seconds(now, -86400 * cfg.history_days)
    recent = incidents.where((F.col("source") != GROUP) & (F.col("started_at") >= since))
    nth = F.row_number().over(W.partitionBy("host").orderBy(F.desc("started_at"), F.asc("id")))
    return recent.select("id", "host", "started_at", nth.alias("nth")).where(F.col("nth") <= cfg.history_max + 1).drop("nth")


def pools_of_hosts(incidents: DataFrame, newest: DataFrame, cfg: Settings = Settings(), *carried: str) -> DataFrame:
    """Incidents with the newest ones of their host (``pool``) and of the root host (``root_pool``), null where there are none."""
    entry = F.struct((-times.seconds(F.col("started_at"))).alias("age"), F.col("id").alias("other_id"), *carried)
    pools = newest.groupBy("host").agg(F.collect_list(entry).alias("pool"))  # at most history_max + 1 entries
    root = pools.where(F.col("host") == cfg.root_host).select(F.col("pool").alias("root_pool"))
    return incidents.join(pools, "host", "left").join(F.broadcast(root), how="left")


def others_of(pool: Column, root_pool: Column) -> Column:
    """The entries of both pools, newest first, without the incident itself."""
    merged = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(pool, root_pool)))))
    return F.filter(merged, lambda e: e["other_id"] != F.col("id"))


def fingerprint_stats(incidents: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """For every incident: how often its fingerprint and its host and type were seen, how recovery went, and how runs
    judged. The incident itself does not count.

    Everything is taken from one aggregate per key and corrected by the incident's own share. The median without the
    incident itself needs only the middle three recovery times of the key; these come from counts per distinct time.
    """
    since = times.add_seconds(now, -86400 * cfg.stats_days)
    recover = times.time_to_recover(F.col("started_at"), F.col("resolved_at"))
    plain = (times.seconds(F.col("resolved_at")) - times.seconds(F.col("started_at")))
    pool = incidents.where((F.col("source") != GROUP) & (F.col("started_at") >= since)).withColumn("recover", plain)
    urg = ("now", "today", "watch", "ignore")
    by_print = pool.groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.count("recover").alias("r"),
        *[F.count_if(F.col("urgency") == u).alias(f"u_{u}") for u in urg])
    by_host = pool.groupBy("host", "type").agg(F.count("*").alias("h"))
    counts = pool.where("recover IS NOT NULL").groupBy("fingerprint", "recover").agg(F.count("*").alias("c"))
    order = W.partitionBy("fingerprint").orderBy("recover")
    spread = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0))) \
        .withColumn("total", F.sum("c").over(W.partitionBy("fingerprint")))

    def nth(position: Column) -> Column:
        """Value at a 0-based position of the sorted recovery times."""
        return F.max(F.when((F.col("upto") > position) & (F.col("upto") - F.col("c") <= position), F.col("recover")))
    t = F.col("total")
    half = F.floor(t / 2)
    mid = spread.groupBy("fingerprint").agg(nth(half - 1).alias("m0"), nth(half).alias("m1"), nth(half + 1).alias("m2"))
    del recover
    own_in = (F.col("source") != GROUP) & (F.col("started_at") >= since)
    mine = F.when(own_in, 1).otherwise(0)
    joined = (incidents.withColumn("own", plain).withColumn("mine", mine)
              .join(by_print, "fingerprint", "left").join(by_host, ["host", "type"], "left").join(mid, "fingerprint", "left"))
    counted = F.coalesce("r", F.lit(0)) - F.when((F.col("mine") == 1) & F.col("own").isNotNull(), 1).otherwise(0)
    removed = (F.col("mine") == 1) & F.col("own").isNotNull()
    r, m0, m1, m2, own = (F.col(c) for c in ("r", "m0", "m1", "m2", "own"))
    even = r % 2 == 0
    whole = F.when(even, F.floor((m0 + m1) / 2)).otherwise(m1)
    # without the own value: an even count leaves one middle value, an odd count leaves two
    without = F.when(even, F.when(own <= m0, m1).otherwise(m0)) \
        .otherwise(F.floor(F.when(own < m1, m1 + m2).when(own > m1, m0 + m1).otherwise(m0 + m2) / 2))
    # equal values are interchangeable: taking one copy of the middle value out is taking the middle position out
    median = F.when(counted > 0, F.when(removed, without).otherwise(whole)).cast("bigint")
    shown = F.concat_ws(", ", *[F.when(F.col(f"u_{u}") - F.when((F.col("mine") == 1) & (F.col("urgency") == u), 1).otherwise(0) > 0,
                                       F.concat(F.lit(f"{u} "), (F.col(f"u_{u}") - F.when((F.col("mine") == 1) & (F.col("urgency") == u), 1)
                                                                .otherwise(0)).cast("string"))) for u in sorted(urg)])
    return joined.select("id", (F.coalesce("n", F.lit(0)) - F.col("mine")).cast("bigint").alias("same_fingerprint"),
                         (F.coalesce("h", F.lit(0)) - F.col("mine")).cast("bigint").alias("same_host_type"),
                         counted.cast("bigint").alias("recovered"), median.alias("median_recover_sec"), shown.alias("urgencies"))


def group_members(incidents: DataFrame, limit: int = 20) -> DataFrame:
    """The first members of every group by start, with how many more there are."""
    members = incidents.where("group_id IS NOT NULL")
    nth = F.row_number().over(W.partitionBy("group_id").orderBy("started_at", "id"))
    first = members.select("group_id", "id", "host", "started_at", nth.alias("nth")).where(F.col("nth") <= limit)
    total = members.groupBy("group_id").agg(F.count("*").alias("members"))
    return first.join(total, "group_id").withColumn("more", F.greatest(F.lit(0).cast("bigint"), F.col("members") - limit)).drop("members")


def incident_list(incidents: DataFrame) -> DataFrame:
    return incidents.select("id", codes.incident_label(F.col("id")).alias("label"), "source", "host", "type", "severity",
                            "problem_status", "analysis_state", "occurrence_count", "title").orderBy("id")


def run_metrics(analyses: DataFrame) -> DataFrame:
    """Durations, tokens and speed of runs by model and trigger, with subtotals."""
    speed = F.coalesce("tokens_per_sec", F.try_divide(F.col("tokens_so_far"), F.col("duration_ms") / 1000))
    return (analyses.where("status <> 'running'").withColumn("speed", speed).rollup("model", "trigger").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
        F.sum(F.col("prompt_tokens").cast("bigint")).alias("prompt_tokens"),
        F.sum(F.col("completion_tokens").cast("bigint")).alias("completion_tokens"),
        F.round(F.avg("speed"), 4).alias("tokens_per_sec"), F.count("error_kind").alias("errors"),
        F.count_distinct("knowledge_version").alias("versions")))


def version_metrics(analyses: DataFrame) -> DataFrame:
    """Runs that ended by version of the manual and kind of error (null: none), with subtotals per version and in all."""
    ended = analyses.where("status <> 'running'").withColumn("error_kind", F.coalesce("error_kind", F.lit("none")))
    return ended.rollup("knowledge_version", "error_kind").agg(
        F.count("*").alias("runs"), F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
        F.sum(F.col("prompt_tokens").cast("bigint") + F.col("completion_tokens")).alias("tokens"), F.max("attempt").alias("attempts"))


def failed_outputs(analyses: DataFrame, limit: int = 8000) -> DataFrame:
    """What failed runs returned: the object, or the text, neutralised."""
    data = F.try_parse_json("result_json")
    inner = F.coalesce(F.get_json_object("result_json", "$.failed_output"), F.when(
        F.schema_of_variant(data).startswith("OBJECT"), F.col("result_json")))
    return analyses.where("status = 'failed'").select(
        "id", F.substring(F.regexp_replace(neutralise(inner), CONTROL, ""), 1, limit).alias("output"))


def incident_detail(incidents: DataFrame, refs: DataFrame, log: DataFrame, analyses: DataFrame, probes: DataFrame,
                    cases: DataFrame, limit: int | None = None) -> DataFrame:
    """One nested row per incident with all its children and their counts. ``limit`` asks for a page of the newest children
    of each kind; whole histories as long tables are the child tables themselves, keyed by ``incident_id``."""
    def newest(df: DataFrame, name: str, order: Column, *columns: str) -> DataFrame:
        nth = F.row_number().over(W.partitionBy("incident_id").orderBy(order))
        kept = df.select("incident_id", F.struct(nth.alias("nth"), *columns).alias("row"))
        kept = kept if limit is None else kept.where(F.col("row.nth") <= limit)
        nested = kept.groupBy("incident_id").agg(F.array_sort(F.collect_list("row")).alias(name))
        total = df.groupBy("incident_id").agg(F.count("*").alias(f"{name}_total"))
        return total.join(nested, "incident_id")
    out = incidents.select(F.col("id").alias("incident_id"), "title", "host", "analysis_state", "group_id")
    out = out.join(newest(refs, "alerts", F.desc("seen_at"), "source", "external_id", "resolved_at"), "incident_id", "left")
    out = out.join(newest(log, "events", F.desc("id"), "id", "type", "at"), "incident_id", "left")
    out = out.join(newest(analyses, "runs", F.desc("id"), "id", "status", "trigger"), "incident_id", "left")
    out = out.join(newest(probes, "probes", F.desc("id"), "id", "name", "status"), "incident_id", "left")
    feedback = log.where("type = 'feedback'").groupBy("incident_id").agg(
        F.max_by(F.get_json_object("detail_json", "$.verdict"), "id").alias("feedback"))
    case = cases.groupBy("incident_id").agg(F.max_by("cause", "id").alias("case_cause"))
    shown = shown_analysis(incidents, analyses).withColumnRenamed("id", "incident_id").withColumnRenamed("analysis_id", "shown_analysis_id")
    out = out.join(feedback, "incident_id", "left").join(case, "incident_id", "left").join(shown, "incident_id", "left")
    for name in ("alerts", "events", "runs", "probes"):
        out = out.withColumn(f"{name}_total", F.coalesce(f"{name}_total", F.lit(0)))
    return out
