"""Probe planning and probe results."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.times import seconds
from alertloom.settings import GROUP

SERIES_POINTS = 30
EVENTS_WINDOW, EVENTS_LEVEL, EVENTS_KEEP = 7200, 5, 20
REPEAT_SEC = 60

# A sample catalogue: name, where, roles, when, command. Commands only read.
CATALOG = (
    ("uptime_load", "host", "", "always", "uptime"),
    ("disk", "host", "", "always", "df -h / /var/lib/docker /home"),
    ("memory", "host", "", "always", "free -m"),
    ("compose_ps", "host", "docker", "type:container,type:service,type:disk", "sudo -n docker compose -f {compose} ps -a"),
    ("listening", "host", "", "type:service,type:net", "sudo -n ss -ltnup"),
    ("guard_counters", "host", "", "type:net,type:auth", "sudo -n nft list chain inet {guard_table} input"),
    ("routes", "host", "frr", "type:net", "sudo -n vtysh -c 'show ip route summary'"),
    ("problem_trigger", "api", "", "source:problem", None),
    ("host_problems", "api", "", "always", None),
    ("recent_alerts", "api", "", "source:security,type:auth,type:file,type:user", None))


def catalog_frame(spark: SparkSession, rows=CATALOG) -> DataFrame:
    """The catalogue as a frame; ``ord`` keeps its order. A catalogue is a hand-written list of some dozens."""
    data = [(i, n, w, [r for r in roles.split(",") if r], when.split(","), c) for i, (n, w, roles, when, c) in enumerate(rows)]
    return spark.createDataFrame(data, "ord INT, name STRING, place STRING, roles ARRAY<STRING>, when ARRAY<STRING>, command STRING")


def plan_probes(incidents: DataFrame, catalog: DataFrame, hosts: DataFrame) -> DataFrame:
    """Probes to run for every incident: those whose condition holds, host probes only where the host is known and has
    the role. ``hosts(host, compose, guard_table, roles)``.

    The conditions an incident meets are exploded (always, its type, its source) and matched by equality, then the few
    hits of one probe are made one.
    """
    wanted = catalog.select("ord", "name", "place", "roles", F.explode("when").alias("condition"))
    own = F.array(F.lit("always"), F.concat(F.lit("type:"), "type"), F.concat(F.lit("source:"), "source"))
    keys = incidents.where(F.col("source") != GROUP).select("id", "host", F.explode(own).alias("condition"))
    hit = keys.join(wanted, "condition").dropDuplicates(["id", "name"])
    known = hosts.select("host", F.col("roles").alias("host_roles"))
    fits = (F.col("place") != "host") | (F.col("host_roles").isNotNull() & (
        (F.size("roles") == 0) | F.arrays_overlap("roles", "host_roles")))
    return hit.join(known, "host", "left").where(F.coalesce(fits, F.lit(False))).select("id", "ord", "name", "place", "host")


def probe_commands(plan: DataFrame, catalog: DataFrame, hosts: DataFrame) -> DataFrame:
    """Command of every planned probe with the holes filled from the host; null for probes that have none."""
    filled = F.replace(F.replace(F.col("command"), F.lit("{compose}"), F.coalesce("compose", F.lit(""))),
                       F.lit("{guard_table}"), F.col("guard_table"))
    return (plan.join(catalog.select("name", "command"), "name").join(hosts.select("host", "compose", "guard_table"), "host", "left")
            .select("id", "ord", "name", "host", filled.alias("command")))


def thin_series(points: DataFrame, keep: int = SERIES_POINTS) -> DataFrame:
    """``points(series, at, tie, value)``: at most ``keep`` evenly spaced points of each series.

    A series of any length is numbered day by day; only the counts of its days are ordered together.
    """
    from alertloom.operators.scans import carry
    daily = points.withColumn("chunk", F.to_date("at"))
    daily = carry(daily, ["series"], "chunk", {"before": (F.count("*"), F.sum)})
    total = points.groupBy("series").agg(F.count("*").alias("total"))
    inside = W.partitionBy("series", "chunk").orderBy("at", "tie")
    placed = daily.withColumn("nth", F.row_number().over(inside) - 1 + F.coalesce("before", F.lit(0))).join(total, "series")
    # the i-th kept point is int(i * total / keep): a point is kept when some i maps to it
    first = F.floor((F.col("nth") * keep + F.col("total") - 1) / F.col("total"))
    taken = F.floor(first * F.col("total") / keep) == F.col("nth")
    return placed.where((F.col("total") <= keep) | (taken & (first < keep))).select("series", "at", "tie", "value", "total")


def recent_events(alerts: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """The newest 20 alerts of a host in the last two hours at level 5 or more, ``nth`` counted from the newest."""
    recent = (alerts.where((F.col("started_at") >= F.timestamp_seconds(seconds(now) - EVENTS_WINDOW)) & (F.col("started_at") <= now)
                           & (F.col("level") >= EVENTS_LEVEL)).join(hosts.select("host").distinct(), "host", "left_semi"))
    nth = F.row_number().over(W.partitionBy("host").orderBy(F.desc("started_at"), F.desc("seq")))
    return recent.withColumn("nth", nth).where(F.col("nth") <= EVENTS_KEEP).select("host", "seq", "started_at", "level", "nth")


def open_problems(alerts: DataFrame, k: int = 20) -> DataFrame:
    """The newest ``k`` unresolved problems of every host."""
    nth = F.row_number().over(W.partitionBy("host").orderBy(F.desc("seq")))
    return (alerts.where((F.col("source") == "problem") & F.col("resolved_at").isNull())
            .select("host", "seq", "severity", "started_at", nth.alias("nth")).where(F.col("nth") <= k))


def probe_status(code: Column, stderr: Column) -> Column:
    """Outcome of a remote probe from its exit code and error text; no code means it was cut off."""
    denied = F.lower(F.coalesce(stderr, F.lit(""))).rlike("permission denied|host key|publickey")
    return (F.when(code.isNull(), "timeout").when(code == 0, "ok").when(code == 2, "refused").when(code == 3, "timeout")
            .when(code == 4, "failed").when(code == 255, F.when(denied, "refused").otherwise("unreachable")).otherwise("failed"))


def probe_rollup(results: DataFrame) -> DataFrame:
    """Per run: how many probes, how many succeeded, and the names of those that did not."""
    return (results.where("analysis_id IS NOT NULL").groupBy("analysis_id").agg(
        F.count("*").alias("probes"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("name")))), ",").alias("failed")))


def attach_operator_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results an operator took go to the next run of their incident: the first that starts at or after them.

    An as-of join: results and runs of one incident lie in one ordered day, and the first run of the days after is
    carried back. ``runs(id, incident_id, started_at)``.
    """
    loose = results.where("trigger = 'operator' AND analysis_id IS NULL").select("id", "incident_id", "started_at")
    marks = loose.select("incident_id", "started_at", F.lit(0).alias("kind"), F.col("id").alias("result_id"), F.lit(None).cast("bigint").alias("run_id"))
    starts = runs.select("incident_id", "started_at", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("result_id"), F.col("id").alias("run_id"))
    both = marks.unionByName(starts).withColumn("chunk", F.to_date("started_at")) \
        .withColumn("run", F.when(F.col("kind") == 1, F.struct("started_at", "run_id")))
    days = both.groupBy("incident_id", "chunk").agg(F.min("run").alias("first_run"))
    after = W.partitionBy("incident_id").orderBy("chunk").rowsBetween(1, W.unboundedFollowing)
    days = days.select("incident_id", "chunk", F.min("first_run").over(after).alias("later"))
    ahead = W.partitionBy("incident_id", "chunk").orderBy("started_at", "kind").rowsBetween(0, W.unboundedFollowing)
    placed = both.join(days, ["incident_id", "chunk"]).withColumn("next", F.coalesce(F.min("run").over(ahead), F.col("later")))
    return placed.where("kind = 0").select(F.col("result_id").alias("id"), "incident_id", F.col("next.run_id").alias("analysis_id"))


DAY_SEC = 86400
NOWHERE = -(1 << 62)


def day_hops(within: int):
    """A function of one row per day: its day, its seconds in order, those ``ahead`` that a jump over midnight may land on, and ``after``,
    the first second behind these. It gives every second that a chain may enter the day at, with the second at which that chain
    enters a later day, ``NOWHERE`` where it ends."""
    def hops(day: pd.Series, seconds_: pd.Series, ahead: pd.Series, after: pd.Series) -> pd.DataFrame:
        enter, leave = [], []
        for d, own, late, rest in zip(day, seconds_, ahead, after):
            n, early = len(own), int(d) * DAY_SEC + within
            known = np.concatenate([own, late, np.array([] if pd.isna(rest) else [rest], "int64")])
            goes = np.append(np.searchsorted(known, known[:n] + within), np.arange(n, len(known) + 1))
            while (goes[:n] < n).any():  # each round doubles the jumps: fewer than twenty in a day
                goes = goes[goes]
            first = np.arange(min(n, np.searchsorted(own, early) + 1))
            enter.append(known[first])
            leave.append(np.append(known, NOWHERE)[goes[first]])
        return pd.DataFrame({"s": enter, "target": leave})
    return F.pandas_udf(hops, "s ARRAY<BIGINT>, target ARRAY<BIGINT>")


def day_chain(within: int):
    """A function of one row per day: the seconds of the chain that enters the day at ``at``."""
    def chain(seconds_: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for own, begins in zip(seconds_, at):
            found, k = [], int(np.searchsorted(own, begins))
            while k < len(own):
                found.append(int(own[k]))
                k = int(np.searchsorted(own, own[k] + within))
            out.append(found)
        return pd.Series(out)
    return F.pandas_udf(chain, "ARRAY<BIGINT>")


def suppress_repeats(requests: DataFrame, within: int = REPEAT_SEC, checkpoints: str | None = None) -> DataFrame:
    """``requests(id, incident_id, name, at)``: a request within ``within`` seconds (a day at most) of an accepted one is
    refused.

    Which request is accepted depends on the chain of accepted ones before it. The seconds of a key and day are one row, of 86,400
    at most. A day tells for each second that a chain may enter it at where that chain enters a later day; over these few the
    chain is followed from the first second of the key by doubling the length of the jumps. A day then walks its part of the chain.
    """
    from alertloom.session import checkpoint_dir
    checkpoint_dir(requests.sparkSession, checkpoints)
    key, within = ["incident_id", "name"], max(1, within)
    known = requests.withColumn("s", seconds(F.col("at"))).dropna(subset=[*key, "s"])
    days = known.select(*key, "s", F.floor(F.col("s") / DAY_SEC).alias("chunk")).distinct().groupBy(*key, "chunk").agg(
        F.sort_array(F.collect_list("s")).alias("own")).checkpoint()
    # a jump over midnight lands in the first ``within`` seconds of the next day, or on the first second after them
    border = F.col("chunk") * DAY_SEC + within
    early = F.filter("own", lambda s: s < border)
    marks = days.select(*key, "chunk", F.get("own", F.lit(0)).alias("first_s"), F.get("own", F.size(early)).alias("late_s"))
    order = W.partitionBy(*key).orderBy("chunk")
    next_day = F.lead("chunk").over(order) == F.col("chunk") + 1
    after = F.when(next_day, F.coalesce(F.lead("late_s").over(order), F.lead("first_s", 2).over(order))).otherwise(F.lead("first_s").over(order))
    ahead = days.withColumn("ahead", early).select(*key, (F.col("chunk") - 1).alias("chunk"), "ahead")
    whole = days.join(marks.select(*key, "chunk", after.alias("after")), [*key, "chunk"]).join(ahead, [*key, "chunk"], "left")
    hops = whole.select(*key, day_hops(within)("chunk", "own", F.coalesce("ahead", F.array().cast("array<bigint>")), "after").alias("h"))
    jumps = hops.select(*key, F.explode(F.arrays_zip("h.s", "h.target")).alias("j")).select(*key, "j.s", "j.target").where("target > s").checkpoint()
    reached = days.groupBy(*key).agg(F.min(F.get("own", F.lit(0))).alias("s"))
    while not jumps.isEmpty():
        # the seconds reached are those of fewer jumps than one of ``jumps`` stands for, so none is reached twice
        reached = reached.unionByName(reached.join(jumps, [*key, "s"]).select(*key, F.col("target").alias("s"))).checkpoint()
        jumps = jumps.join(jumps.select(*key, F.col("s").alias("target"), F.col("target").alias("far")), [*key, "target"]) \
            .select(*key, "s", F.col("far").alias("target")).checkpoint()
    entries = reached.select(*key, F.floor(F.col("s") / DAY_SEC).alias("chunk"), F.col("s").alias("enter"))
    taken = days.join(entries, [*key, "chunk"]).select(*key, F.explode(day_chain(within)("own", "enter")).alias("s"))
    accepted = known.join(taken, [*key, "s"]).groupBy(*key, "s").agg(F.min("id").alias("id")).select(*key, "id", F.lit(True).alias("hit"))
    return requests.join(accepted, [*key, "id"], "left").select("id", *key, "at", F.coalesce("hit", F.lit(False)).alias("accepted"))


def command_words(command: Column) -> Column:
    """Command with single blanks and without a leading ``sudo`` and ``-n``."""
    return F.regexp_replace(F.trim(F.regexp_replace(command, r"\s+", " ")), r"^(?:(?:sudo|-n)(?: |\z))+", "")


def checks_to_probes(checks: DataFrame, commands: DataFrame) -> DataFrame:
    """The first catalogue probe, in catalogue order, whose command words a recommended check starts with.
    ``checks(check_id, host, command)``, ``commands(host, ord, name, command)``: matched on host and first word."""
    wanted = checks.withColumn("words", command_words(F.col("command"))).withColumn("head", F.substring_index("words", " ", 1))
    fixed = commands.select("host", "ord", "name", command_words(F.col("command")).alias("fixed")).where("fixed <> ''") \
        .withColumn("head", F.substring_index("fixed", " ", 1))
    hit = wanted.join(fixed, ["host", "head"]).where(F.concat("words", F.lit(" ")).startswith(F.concat("fixed", F.lit(" "))))
    return hit.groupBy("check_id").agg(F.min_by("name", "ord").alias("probe"))


def latest_results(results: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("incident_id").orderBy(F.desc("id")))
    return results.withColumn("nth", nth).where(F.col("nth") <= k)
