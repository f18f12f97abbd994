"""Collector analytics over a log of polls, and reconciliation of stored alerts with listing rounds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.times import seconds
from alertloom.operators.scans import carry, carry_state
from alertloom.settings import PROBLEM, SECURITY, Settings

HOUR = 3600
CREDENTIAL_KINDS = ("auth", "credential")
CONTENT_KINDS = ("invalid_response", "partial", "too_large", "internal")


def failure_streaks(polls: DataFrame) -> DataFrame:
    """Running counts after every poll: failures in a row, incomplete polls in a row, failures in a row at one position.

    A source polls one at a time, so an hour of one source is a small window; what came before is carried over.
    """
    bad, good = ~F.col("ok"), F.col("ok")
    full = good & F.col("complete")
    order = W.partitionBy("source", "chunk").orderBy("at", "id")
    run, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    # inside the hour: row number, incomplete polls so far, the failure before
    rows = polls.withColumn("chunk", F.floor(seconds(F.col("at")) / HOUR)).withColumn("_fail", F.when(bad, F.struct("at", "id", "position")))
    rows = rows.withColumns({"n": F.sum(one).over(run), "inc": F.sum(F.when(good & ~F.col("complete"), one).otherwise(zero)).over(run),
                             "_prev": F.max("_fail").over(before)})
    elsewhere = lambda position, earlier: ~position.eqNullSafe(earlier["position"])
    first = F.min(F.when(bad, F.struct("at", "id", "position", "n")))
    rows = carry_state(rows, ["source"], "chunk", {
        "_polls": F.count("*"), "_incs": F.max("inc"), "_first": first, "_last": F.max("_fail"), "_ok": F.max(F.when(good, F.col("n"))),
        "_full": F.max(F.when(full, F.struct("n", "inc"))),
        "_moved": F.max(F.when(bad & F.col("_prev").isNotNull() & elsewhere(F.col("position"), F.col("_prev")), F.col("n")))}, [
        {"n0": lambda w: F.coalesce(F.sum("_polls").over(w), zero), "inc0": lambda w: F.coalesce(F.sum("_incs").over(w), zero),
         "fail0": lambda w: F.max("_last").over(w)},
        {"_moved": lambda _: F.greatest("_moved", F.when(F.col("_first").isNotNull() & elsewhere(F.col("_first.position"), F.col("fail0")), F.col("_first.n")))},
        {"ok0": lambda w: F.max(F.col("_ok") + F.col("n0")).over(w), "moved0": lambda w: F.max(F.col("_moved") + F.col("n0")).over(w),
         "full0": lambda w: F.max(F.when(F.col("_full").isNotNull(), F.struct((F.col("_full.n") + F.col("n0")).alias("n"),
                                                                              (F.col("_full.inc") + F.col("inc0")).alias("inc")))).over(w)}],
        ["n0", "inc0", "fail0", "ok0", "moved0", "full0"])
    rows = rows.withColumns({"n": F.col("n") + F.col("n0"), "inc": F.col("inc") + F.col("inc0"), "_prev": F.coalesce("_prev", "fail0")})
    rows = rows.withColumns({
        "_last_ok": F.greatest(F.max(F.when(good, F.col("n"))).over(run), F.col("ok0")),
        "_last_moved": F.greatest(F.max(F.when(bad & elsewhere(F.col("position"), F.col("_prev")), F.col("n"))).over(run), F.col("moved0")),
        # incomplete polls since the last complete one: the running count less its value there
        "_at_full": F.coalesce(F.max(F.when(full, F.struct("n", "inc"))).over(run), F.col("full0"))})
    since_ok = F.col("n") - F.coalesce("_last_ok", zero)
    since_moved = F.col("n") - F.greatest(F.coalesce("_last_ok", zero), F.coalesce(F.col("_last_moved") - 1, zero))
    return rows.select(
        "id", "source", "at", "ok", "complete", "error_kind", "position", "retry_after",
        F.when(good, zero).otherwise(since_ok).alias("failures"),
        (F.col("inc") - F.coalesce(F.col("_at_full.inc"), zero)).alias("incomplete_polls"),
        F.when(good, zero).otherwise(since_moved).alias("stuck_failures"))


def interval_of(source: Column, cfg: Settings) -> Column:
    return F.when(source == SECURITY, cfg.poll_interval_security).otherwise(cfg.poll_interval_problem)


def next_poll(streaks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Seconds until the next poll: the interval after a success, a growing wait after failures."""
    interval = interval_of(F.col("source"), cfg)
    limit = F.greatest(F.lit(cfg.poll_backoff_max), interval)
    grown = F.least(interval * F.pow(F.lit(2), F.least(F.col("failures") - 1, F.lit(20))), limit)
    asked = F.greatest(grown, F.coalesce(F.least(F.col("retry_after"), limit), F.lit(0)))
    wait = F.when(F.col("ok"), interval).when(F.col("error_kind").isin(*CREDENTIAL_KINDS), cfg.poll_auth_backoff).otherwise(asked)
    return streaks.withColumn("wait_sec", wait.cast("bigint")) \
        .withColumn("next_poll_at", F.timestamp_seconds(seconds(F.col("at")) + F.col("wait_sec")))


def collector_state(planned: DataFrame) -> DataFrame:
    """One row per source: what the last poll left behind, and the last success."""
    last = F.struct("at", "id")
    return planned.groupBy("source").agg(
        F.max("at").alias("last_poll_at"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok_at"),
        F.max_by("failures", last).alias("failures"), F.max_by("incomplete_polls", last).alias("incomplete_polls"),
        F.max_by("stuck_failures", last).alias("stuck_failures"),
        F.max_by("error_kind", F.when(~F.col("ok"), last)).alias("last_error_kind"),
        F.max_by("next_poll_at", last).alias("next_poll_at"))


def due_sources(state: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Which sources are due, why, and how long the others wait. A stored time further ahead than any wait is not
    believed."""
    longest = F.greatest(interval_of(F.col("source"), cfg), F.lit(cfg.poll_backoff_max), F.lit(cfg.poll_auth_backoff))
    ahead = seconds(F.col("next_poll_at")) - seconds(now)
    reason = (F.when(F.col("next_poll_at").isNull(), "never polled").when(ahead > longest, "stored time too far ahead")
              .when(ahead <= 0, "time has come").when(F.col("failures") == 0, "usual interval")
              .when(F.col("last_error_kind").isin(*CREDENTIAL_KINDS), "waiting after a credential error")
              .otherwise("waiting after failures"))
    is_due = F.col("next_poll_at").isNull() | (ahead > longest) | (ahead <= 0)
    return state.select("source", is_due.alias("due"), reason.alias("reason"),
                        F.when(is_due, 0).otherwise(ahead).cast("bigint").alias("wait_sec"))


def source_health(state: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Health of every known source with the first reason that applies; sources never polled are listed too."""
    spark = state.sparkSession
    names = spark.range(1).select(F.explode(F.array(F.lit(PROBLEM), F.lit(SECURITY))).alias("source"))
    since = seconds(now) - seconds(F.col("last_ok_at"))
    stuck = (F.col("stuck_failures") >= cfg.stuck_limit) & F.col("last_error_kind").isin(*CONTENT_KINDS)
    reason = (F.when((F.col("failures") > 0) & stuck, "stuck").when(F.col("failures") > 0, "failing")
              .when(F.col("last_ok_at").isNull(), "never ok").when(since < 0, "clock in the future")
              .when(since > cfg.stale_intervals * interval_of(F.col("source"), cfg), "stale")
              .when(F.col("incomplete_polls") > cfg.incomplete_limit, "behind"))
    return names.join(state, "source", "left").select(
        "source", reason.isNull().alias("healthy"), reason.alias("reason"), since.alias("seconds_since_ok"))


def missing_in_listing(refs: DataFrame, listings: DataFrame, rounds: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Unresolved alerts that complete rounds no longer list: ``missing`` with the count of rounds in a row, or
    ``resolved`` at the round that made the count reach the limit. Being listed, or hidden in a complete round, starts
    the count over.

    Nothing is expanded to alerts times rounds. Complete rounds are numbered; an alert is absent from the number after
    its last mention up to the next mention, so gaps between mentions give every streak.
    """
    # the table of rounds grows by one row per poll interval; it is numbered in chunks
    one = F.when(F.col("complete"), 1).otherwise(0)
    counted = rounds.withColumn("lane", F.lit(0)).withColumn("chunk", F.floor(F.col("round") / 10000))
    counted = carry(counted, ["lane"], "chunk", {"n0": (F.sum(one), F.sum)})
    so_far = F.sum(one).over(W.partitionBy("chunk").orderBy("round").rowsBetween(W.unboundedPreceding, 0))
    counted = counted.select("round", "complete", F.col("at").alias("round_at"),
                             (so_far + F.coalesce("n0", F.lit(0))).alias("nth"))
    numbered = counted.where("complete").select("round_at", "nth")
    last = numbered.agg(F.max("nth").alias("last_nth"))
    # a mention ends the streak before it at ``first`` and starts the next one after ``upto``; one in a round that was
    # not read to its end lies between two complete rounds
    mentions = listings.join(counted, "round").where("complete OR NOT hidden").select(
        "external_id", F.when(F.col("complete"), F.col("nth")).otherwise(F.col("nth") + 1).alias("first"),
        F.col("nth").alias("upto")).distinct()
    start = refs.where("resolved_at IS NULL").select("source", "external_id", "incident_id", "seen_round")
    base = start.join(counted.select(F.col("round").alias("seen_round"), F.col("nth").alias("seen")), "seen_round", "left") \
        .select("source", "external_id", "incident_id", F.coalesce("seen", F.lit(0)).alias("first"),
                F.coalesce("seen", F.lit(0)).alias("upto"))
    later = base.withColumnRenamed("upto", "seen").drop("first").join(mentions, "external_id").where("upto >= seen AND first > seen")
    points = base.unionByName(later.drop("seen"))
    nxt = F.lead("first").over(W.partitionBy("source", "external_id").orderBy("upto", "first"))
    gaps = points.withColumn("next", nxt).join(F.broadcast(last)).withColumn(
        "absent", F.coalesce(F.col("next"), F.col("last_nth") + 1) - F.col("upto") - 1).withColumnRenamed("upto", "nth")
    limit = cfg.missing_rounds
    closed = (gaps.where(F.col("absent") >= limit).groupBy("source", "external_id", "incident_id")
              .agg((F.min("nth") + limit).alias("nth")))
    closing = closed.join(numbered, "nth").select("source", "external_id", "incident_id", F.lit("resolved").alias("outcome"),
                                                  F.lit(limit).cast("bigint").alias("missing_rounds"),
                                                  F.col("round_at").alias("resolved_at"))
    open_tail = gaps.where("next IS NULL AND absent > 0").join(closed, ["source", "external_id"], "left_anti")
    return closing.unionByName(open_tail.select(
        "source", "external_id", "incident_id", F.lit("missing").alias("outcome"),
        F.col("absent").cast("bigint").alias("missing_rounds"), F.lit(None).cast("timestamp").alias("resolved_at")))


def recovered_in_listing(listed: DataFrame, refs: DataFrame, now: Column) -> DataFrame:
    """Stored unresolved alerts that a listing shows with a recovery event."""
    from alertloom.functions.times import recovery_time
    at = recovery_time(F.col("r_eventid"), F.col("r_clock"), now)
    hit = listed.select("external_id", at.alias("recovered_at")).where("recovered_at IS NOT NULL") \
        .groupBy("external_id").agg(F.min("recovered_at").alias("recovered_at"))
    return refs.where("resolved_at IS NULL").join(hit, "external_id").select(
        "source", "external_id", "incident_id", F.col("recovered_at").alias("resolved_at"))


def recovery_lookup(missing: DataFrame, links: DataFrame, clocks: DataFrame, now: Column) -> DataFrame:
    """Alert to its recovery event to the time of that event. ``links(external_id, r_eventid)``, ``clocks(eventid, clock)``."""
    from alertloom.functions.times import epoch_time
    real = links.where(F.coalesce(F.col("r_eventid"), F.lit("0")) != "0")
    return (missing.join(real, "external_id", "left").join(clocks, F.col("r_eventid") == F.col("eventid"), "left")
            .select("external_id", "r_eventid",
                    F.when(F.col("r_eventid").isNotNull(), F.coalesce(epoch_time(F.col("clock")), now)).alias("resolved_at")))


def backlog_trend(streaks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Polls at which a source fell behind or caught up: the count of incomplete polls crosses the limit."""
    chunked = streaks.where("ok").withColumn("chunk", F.floor(seconds(F.col("at")) / HOUR)) \
        .withColumn("mark", F.struct("at", "id", "incomplete_polls"))
    chunked = carry(chunked, ["source"], "chunk", {"earlier": (F.max("mark"), F.max)})
    was = F.coalesce(F.lag("incomplete_polls").over(W.partitionBy("source", "chunk").orderBy("at", "id")),
                     F.col("earlier.incomplete_polls"), F.lit(0))
    now_, limit = F.col("incomplete_polls"), cfg.incomplete_limit
    change = F.when(now_ == limit + 1, "behind").when((now_ == 0) & (F.col("was") > limit), "caught up")
    return chunked.withColumn("was", was).withColumn("change", change).where("change IS NOT NULL").select(
        "id", "source", "at", "change", F.greatest("was", "incomplete_polls").alias("polls"))


def health_report(health: DataFrame, queue: DataFrame, freshness: DataFrame) -> DataFrame:
    """One row: ok or degraded, with the problems found. ``freshness(loaded, stale)`` describes the manual in use."""
    found = health.where(~F.col("healthy")).select(F.concat("source", F.lit(": "), "reason").alias("problem"))
    found = found.unionByName(queue.where("stalled").select(F.concat(
        F.lit("queue: oldest wait "), F.col("oldest_waiting_sec").cast("string"), F.lit(" s")).alias("problem")))
    found = found.unionByName(freshness.where(~F.col("loaded")).select(F.lit("manual: not loaded").alias("problem")))
    # one line per source and check, so the list is short whatever the tables hold
    return found.agg(F.count("*").alias("problems"), F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("detail")) \
        .select(F.when(F.col("problems") == 0, "ok").otherwise("degraded").alias("status"), "problems", "detail")


def poll_report(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes by source."""
    names = ["created", "recurred", "skipped", "duplicate", "known", "rejected", "resolved", "reopened", "hidden", "missing"]
    wide = outcomes.groupBy("source").pivot("outcome", names).count()
    return wide.select("source", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
