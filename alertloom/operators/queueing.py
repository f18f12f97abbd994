"""The analysis queue: promotion, order, retries, follow-ups, operator actions and run logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.codes import allowed_actions
from alertloom.functions.times import add_seconds, seconds
from alertloom.operators.scans import carry, carry_state, global_rank
from alertloom.settings import WAITING, Settings

HOUR = 3600


def promote_held(incidents: DataFrame, now: Column) -> DataFrame:
    """Held incidents whose hold is over become queued."""
    over = (F.col("analysis_state") == "held") & (F.col("held_until") <= now)
    done = F.coalesce(over, F.lit(False))
    return incidents.withColumns({
        "promoted": done, "analysis_state": F.when(done, "queued").otherwise(F.col("analysis_state")),
        "held_until": F.when(~done, F.col("held_until"))})


def skip_stale(incidents: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Waiting incidents that recovered too long ago are skipped, unless a person asked for them."""
    old = (F.col("analysis_state").isin("queued", "retry_wait") & (F.col("problem_status") == "resolved")
           & (F.col("resolved_at") < add_seconds(now, -cfg.skip_resolved_after))
           & (F.col("queue_reason") != "manual") & (F.col("priority") == 0))
    stale = F.coalesce(old, F.lit(False))
    return incidents.withColumns({
        "analysis_state": F.when(stale, "skipped").otherwise(F.col("analysis_state")),
        "skip_reason": F.when(stale, "resolved_too_long").otherwise(F.col("skip_reason")),
        "next_retry_at": F.when(~stale, F.col("next_retry_at"))})


def due(incidents: DataFrame, now: Column) -> DataFrame:
    state = F.col("analysis_state")
    return incidents.where((state == "queued") | ((state == "retry_wait") & (F.col("next_retry_at") <= now)))


def queue_order() -> list[Column]:
    return [F.desc("priority"), F.desc("severity"), F.asc("started_at"), F.asc("id")]


def next_candidates(incidents: DataFrame, now: Column, n: int) -> DataFrame:
    """The next ``n`` to analyse: a distributed top-n, nothing is sorted whole."""
    return due(incidents, now).orderBy(*queue_order()).limit(n)


def plan_retries(failures: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``failures(incident_id, attempt, error_kind, at)``: the next retry, or failed once the delays are used up.
    A failure that the same input would repeat is never retried."""
    delays = F.array(*[F.lit(d) for d in cfg.retry_delays])
    again = ~F.col("error_kind").isin("validation", "length") & (F.col("attempt") <= len(cfg.retry_delays))
    delay = F.try_element_at(delays, F.col("attempt"))
    return failures.withColumn("analysis_state", F.when(again, "retry_wait").otherwise("failed")) \
        .withColumn("next_retry_at", F.when(again, add_seconds(F.col("at"), delay)))


def followups_due(incidents: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Analysed incidents that are still open after a while and had no follow-up yet."""
    return incidents.where((F.col("analysis_state") == "done") & (F.col("problem_status") == "open")
                           & ~F.col("followup_done") & (F.col("analyzed_at") <= add_seconds(now, -cfg.followup_after)))


RESETS = ("requeued", "followup_queued")


def attempt_counts(log: DataFrame) -> DataFrame:
    """Starts less releases since the last reset, never below 0. Two aggregates, no ordering of the log."""
    last = log.where(F.col("type").isin(*RESETS)).groupBy("incident_id").agg(F.max("id").alias("reset_id"))
    step = F.when(F.col("type") == "analysis_started", 1).when(F.col("type") == "released", -1).otherwise(0)
    return (log.where(F.col("type").isin("analysis_started", "released")).join(last, "incident_id", "left")
            .where(F.col("reset_id").isNull() | (F.col("id") > F.col("reset_id")))
            .groupBy("incident_id").agg(F.greatest(F.lit(0), F.sum(step)).cast("bigint").alias("attempts")))


def apply_actions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Fold ``actions(incident_id, id, at, name, verdict, note)`` into the incidents: of the actions that move an
    incident the last one counts, and so does the last of every other kind."""
    moving = F.col("name").isin("prioritize", "skip", "requeue")
    at_last = F.struct("at", "id")
    folded = actions.groupBy("incident_id").agg(
        F.max_by("name", F.when(moving, at_last)).alias("move"),
        F.max_by("note", F.when(F.col("name") == "skip", at_last)).alias("note"),
        F.min(F.when(F.col("name") == "read", F.col("at"))).alias("first_read"),
        F.max_by("verdict", F.when(F.col("name") == "feedback", at_last)).alias("feedback"),
        F.max_by("verdict", F.when(F.col("name") == "case", at_last)).alias("confirmed_verdict"),
        F.max(F.when(F.col("name") == "case", F.col("at"))).alias("confirmed_at"), F.max("at").alias("touched_at"))
    state, move = F.col("analysis_state"), F.col("move")
    waits, ended = state.isin(*WAITING), state.isin("done", "failed", "skipped")
    front, skip, again = waits & (move == "prioritize"), waits & (move == "skip"), ended & (move == "requeue")
    joined = incidents.join(folded, F.col("id") == F.col("incident_id"), "left").drop("incident_id")
    moved = F.coalesce(front | skip | again, F.lit(False))
    return (joined
            .withColumn("new_state", F.when(front | again, "queued").when(skip, "skipped").otherwise(state))
            .withColumn("priority", F.when(front, 1).otherwise(F.col("priority")))
            .withColumn("skip_reason", F.when(skip, F.concat(F.lit("manual: "), F.col("note"))).when(again, F.lit(None))
                        .otherwise(F.col("skip_reason")))
            .withColumn("fail_reason", F.when(F.coalesce(again, F.lit(False)), F.lit(None)).otherwise(F.col("fail_reason")))
            .withColumn("held_until", F.when(~moved, F.col("held_until")))
            .withColumn("next_retry_at", F.when(~moved, F.col("next_retry_at")))
            .withColumn("attempt_count", F.when(F.coalesce(again, F.lit(False)), 0).otherwise(F.col("attempt_count")))
            .withColumn("queue_reason", F.when(F.coalesce(again, F.lit(False)), "manual").otherwise(F.col("queue_reason")))
            .withColumn("read_at", F.coalesce("read_at", "first_read"))
            .withColumn("updated_at", F.greatest("updated_at", "touched_at"))
            .withColumn("analysis_state", F.col("new_state"))
            .drop("new_state", "move", "note", "first_read", "touched_at"))


def refused_actions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions the state of their incident does not allow."""
    never = F.lit(False)
    wanted = F.when(F.col("name") == "requeue", "reanalyze").otherwise(F.col("name"))
    can = allowed_actions(F.col("analysis_state"), F.col("latest_analysis_id").isNotNull(), never, never)
    return (actions.join(incidents.select(F.col("id").alias("incident_id"), "analysis_state", "latest_analysis_id"), "incident_id")
            .where((F.col("name") != "read") & ~F.array_contains(can, wanted))
            .select(F.col("id").alias("action_id"), "incident_id", "name", "analysis_state"))


# The state an incident is in after each kind of event, and the states a kind may follow.
AFTER = {"detected": "held", "queued": "queued", "analysis_started": "running", "analysis_done": "done",
         "analysis_failed": "failed", "retry_scheduled": "retry_wait", "released": "queued", "requeued": "queued",
         "followup_queued": "queued", "skipped": "skipped", "prioritized": "queued"}
ALLOWED = {"queued": ("held",), "analysis_started": ("queued", "retry_wait"), "analysis_done": ("running",),
           "analysis_failed": ("running",), "retry_scheduled": ("running",), "released": ("running",),
           "requeued": ("done", "failed", "skipped"), "followup_queued": ("done", "failed"),
           "skipped": ("held", "queued", "retry_wait"), "prioritized": ("held", "queued", "retry_wait")}


def invalid_transitions(log: DataFrame) -> DataFrame:
    """State changes in the log that the state before them does not allow. The log of an incident is compared hour by
    hour, the state carried over from earlier hours."""
    table = F.create_map(*[F.lit(x) for pair in AFTER.items() for x in pair])
    moves = (log.withColumn("state", F.try_element_at(table, F.col("type"))).where("state IS NOT NULL")
             .withColumn("chunk", F.floor(seconds(F.col("at")) / HOUR))
             .withColumn("mark", F.struct("at", "id", "state")))
    moves = carry(moves, ["incident_id"], "chunk", {"earlier": (F.max("mark"), F.max)})
    inside = W.partitionBy("incident_id", "chunk").orderBy("at", "id")
    was = F.coalesce(F.lag("state").over(inside), F.col("earlier.state"))
    fine = F.lit(False)
    for kind, states in ALLOWED.items():
        fine = fine | ((F.col("type") == kind) & F.col("was").isin(*states))
    return (moves.withColumn("was", was).where(F.col("was").isNotNull() & ~fine)
            .select("id", "incident_id", "at", "type", "was"))


QUEUED_EVENTS = ("queued", "requeued", "followup_queued")


def queue_summary(incidents: DataFrame, log: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """Depth of the queue and its oldest wait, one row."""
    entered = log.where(F.col("type").isin(*QUEUED_EVENTS)).groupBy("incident_id").agg(F.max("at").alias("entered"))
    waiting = incidents.where(F.col("analysis_state").isin(*WAITING)).select(
        "id", "analysis_state", "started_at", "next_retry_at")
    joined = waiting.join(entered, F.col("id") == F.col("incident_id"), "left")
    since = F.when(F.col("analysis_state") == "queued", F.coalesce("entered", "started_at")) \
        .when((F.col("analysis_state") == "retry_wait") & (F.col("next_retry_at") <= now), F.col("next_retry_at"))
    age = F.greatest(F.lit(0).cast("bigint"), seconds(now) - seconds(F.col("oldest")))
    return (joined.agg(F.count("*").alias("depth"), F.min(since).alias("oldest"))
            .select("depth", F.coalesce(age, F.lit(0)).alias("oldest_waiting_sec"))
            .withColumn("stalled", F.col("oldest_waiting_sec") > cfg.stall_warn))


def wait_positions(incidents: DataFrame, typical_sec: DataFrame, now: Column) -> DataFrame:
    """How many wait ahead of each incident and when it is expected to start. ``typical_sec`` is one row."""
    waiting = incidents.where(F.col("analysis_state").isin(*WAITING))
    day = F.floor(seconds(F.col("started_at")) / 86400)
    ranked = global_rank(waiting, [F.asc("id")], [-F.col("priority"), -F.col("severity"), day],
                         [seconds(F.col("started_at"))], "ahead")
    one = F.broadcast(typical_sec.select("typical_sec"))
    return (ranked.select("id", "ahead").join(one, how="left")
            .select("id", "ahead", add_seconds(now, F.col("typical_sec") * (F.col("ahead") + 1)).alias("expected_at")))


def typical_duration(analyses: DataFrame) -> DataFrame:
    """Median of the last 10 finished runs in whole seconds, one row."""
    last = analyses.where((F.col("status") == "done") & F.col("duration_ms").isNotNull()).orderBy(F.desc("id")).limit(10)
    return last.agg(F.floor(F.median("duration_ms") / 1000).cast("bigint").alias("typical_sec"))


def abandoned_runs(analyses: DataFrame) -> DataFrame:
    """Runs left running by a restart are released."""
    left = F.col("status") == "running"
    return analyses.select("id", "incident_id", F.when(left, "released").otherwise(F.col("status")).alias("status"),
                           F.when(left, "restart").otherwise(F.col("error_kind")).alias("error_kind"),
                           left.alias("back_to_queue"))


def concurrent_runs(analyses: DataFrame) -> DataFrame:
    """Runs that began before an earlier one had finished; one that still runs has no end. The runs of a minute are ordered in
    one task; the latest end of all minutes before is carried over a table with one row per minute of the history."""
    runs = analyses.where("started_at IS NOT NULL").withColumn("chunk", F.floor(seconds(F.col("started_at")) / 60)) \
        .withColumn("lane", F.lit(0)).withColumn("until", F.coalesce("finished_at", F.lit("2999-01-01").cast("timestamp")))
    runs = carry(runs, ["lane"], "chunk", {"earlier": (F.max("until"), F.max)})
    inside = W.partitionBy("chunk").orderBy("started_at", "id").rowsBetween(W.unboundedPreceding, -1)
    busy = F.greatest("earlier", F.max("until").over(inside))
    return runs.withColumn("busy_until", busy).where(F.col("busy_until") > F.col("started_at")).select("id", "started_at", "busy_until")


def run_trigger(incidents: DataFrame) -> DataFrame:
    reason = F.col("queue_reason")
    return incidents.select("id", F.when(reason.isin("followup", "manual"), reason)
                            .when(F.col("attempt_count") > 1, "retry").otherwise("initial").alias("trigger"))


MODEL_SIDE = ("unreachable", "server", "auth", "tls", "throttled", "invalid_response")


def model_backoff(runs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Wait after each release caused by the model side: doubling from the minimum, a long wait after an auth error, which
    the next failure doubles on. Success starts over. ``runs(id, at, lane, status, error_kind)``."""
    failed = (F.col("status") == "released") & F.col("error_kind").isin(*MODEL_SIDE)
    relevant = runs.where(failed | (F.col("status") != "released")).withColumn("failed", failed) \
        .withColumn("auth", failed & (F.col("error_kind") == "auth")) \
        .withColumn("chunk", F.floor(seconds(F.col("at")) / HOUR))
    one = F.when(F.col("failed"), 1).otherwise(0)
    inside = W.partitionBy("lane", "chunk").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    point = F.struct(F.struct("at", "id").alias("k"), F.col("fails").alias("n"))
    counted = relevant.withColumn("fails", F.sum(one).over(inside))
    # the last reset and the last auth error with the failure count at that point
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.k"), (F.col(f"{c}.n") + F.col("fails0")).alias("n")))
    counted = carry_state(counted, ["lane"], "chunk", {
        "_fails": F.max("fails"), "_reset": F.max(F.when(~F.col("failed"), point)), "_auth": F.max(F.when(F.col("auth"), point))}, [
        {"fails0": lambda w: F.coalesce(F.sum("_fails").over(w), F.lit(0))},
        {"r0": lambda w: F.max(moved("_reset")).over(w), "a0": lambda w: F.max(moved("_auth")).over(w)}], ["fails0", "r0", "a0"])
    counted = counted.withColumn("fails", F.col("fails") + F.col("fails0"))
    last_reset = F.coalesce(F.max(F.when(~F.col("failed"), point)).over(inside), F.col("r0"))
    last_auth = F.coalesce(F.max(F.when(F.col("auth"), point)).over(inside), F.col("a0"))
    marked = counted.withColumn("r", last_reset).withColumn("a", last_auth).where("failed")
    since_reset = F.col("fails") - F.coalesce(F.col("r.n"), F.lit(0))
    since_auth = F.col("fails") - F.col("a.n")
    fresh_auth = F.col("a").isNotNull() & (F.col("r").isNull() | (F.col("a.k") > F.col("r.k")))
    doubled = F.least(F.lit(cfg.model_backoff_min) * F.pow(F.lit(2), F.least(since_reset - 1, F.lit(20))), F.lit(cfg.model_backoff_max))
    after_auth = F.when(since_auth == 0, cfg.model_auth_backoff).otherwise(cfg.model_backoff_max)
    return marked.select("id", "lane", F.when(fresh_auth, after_auth).otherwise(doubled).cast("bigint").alias("wait_sec"))


def cycle(incidents: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """One pass over one consistent state: the largest burst is grouped, then holds end, then follow-ups are queued."""
    from alertloom.operators import grouping
    storm = grouping.largest_storm(grouping.group_candidates(incidents), cfg)
    named = storm.join(F.broadcast(storm.agg(F.min("id").alias("new_group"))), how="left").select("id", "new_group")
    grouped = incidents.join(named, "id", "left")
    taken = F.col("new_group").isNotNull()
    grouped = (grouped.withColumn("analysis_state", F.when(taken, "grouped").otherwise(F.col("analysis_state")))
               .withColumn("held_until", F.when(~taken, F.col("held_until")))
               .withColumn("group_key", F.when(taken, F.concat(F.lit("group-"), F.col("new_group").cast("string")))))
    promoted = promote_held(grouped, now)
    again = F.coalesce((F.col("analysis_state") == "done") & (F.col("problem_status") == "open") & ~F.col("followup_done")
                       & (F.col("analyzed_at") <= add_seconds(now, -cfg.followup_after)), F.lit(False))
    return promoted.withColumns({
        "followup": again, "analysis_state": F.when(again, "queued").otherwise(F.col("analysis_state")),
        "queue_reason": F.when(again, "followup").otherwise(F.col("queue_reason")),
        "attempt_count": F.when(again, 0).otherwise(F.col("attempt_count")),
        "followup_done": F.col("followup_done") | again}).drop("new_group")
