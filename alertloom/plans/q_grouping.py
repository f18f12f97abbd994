"""Queries over bursts and root outages."""
from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import grouping
from alertloom.plans import adapters
from alertloom.plans.oracle import add_block, over
from alertloom.plans.registry import query

add_block("cand", ("incidents",), "SELECT *, CAST(epoch(started_at) AS BIGINT) AS s FROM incidents WHERE source <> 'group' "
          "AND group_id IS NULL AND analysis_state IN ('held', 'queued') AND priority = 0")
# every analysed incident counts for the burst queries, so that small tables hold bursts as well
add_block("starts", ("rolled",), "SELECT *, CAST(epoch(started_at) AS BIGINT) AS s FROM rolled")
add_block("near", ("starts",), "SELECT s, count(*) AS n, max(w) AS within FROM (SELECT s, count(*) OVER (ORDER BY s "
          "RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING) AS w FROM starts) x GROUP BY s")
add_block("roots", ("rolled",), f"SELECT *, CAST(epoch(started_at) AS BIGINT) AS s FROM rolled WHERE host = '{adapters.ROOT}' "
          "AND source = 'problem' AND (availability OR id % 3 = 0) AND (problem_status = 'open' OR id % 2 = 0)")
add_block("spans", ("incidents",), "SELECT group_id, min(CAST(epoch(started_at) AS BIGINT)) - 300 AS lo, "
          "max(CAST(epoch(started_at) AS BIGINT)) + 300 AS hi FROM incidents WHERE group_id IS NOT NULL GROUP BY group_id")
add_block("groups", ("incidents",), f"""
SELECT group_id, count(*) AS members, max(severity) AS severity, min(started_at) AS started_at,
  max(last_occurrence_at) AS last_occurrence_at, min(id) AS first_id,
  CASE WHEN count(*) FILTER (problem_status = 'open') > 0 THEN 'open' WHEN count(*) FILTER (problem_status = 'oneshot') = count(*)
    THEN 'oneshot' ELSE 'resolved' END AS problem_status,
  CASE WHEN count(*) FILTER (problem_status = 'open') = 0 AND count(*) FILTER (problem_status = 'oneshot') < count(*)
    THEN coalesce(max(resolved_at), TIMESTAMP '{adapters.NOW}') END AS resolved_at
FROM incidents WHERE group_id IS NOT NULL GROUP BY group_id""")


def roots_of(t):
    """Root outages; more incidents count as open outages than the data would give, so that the join has work."""
    problem = F.col("source") == "problem"
    wide = t.rolled.withColumn("availability", problem & (F.col("availability") | (F.col("id") % 3 == 0))) \
        .withColumn("problem_status", F.when(problem & (F.col("id") % 2 == 0), "open").otherwise(F.col("problem_status")))
    return grouping.open_roots(wide, t.cfg.root_host)


@query("group_candidates", over("cand", sql="SELECT id, host, started_at, analysis_state FROM cand"))
def _(t):
    return grouping.group_candidates(t.incidents).select("id", "host", "started_at", "analysis_state")


@query("window_density", over("near", sql="""
SELECT TIMESTAMP '1970-01-01 00:00:00' + to_seconds(s) AS started_at, n AS starts, within FROM near"""))
def _(t):
    return grouping.window_density(t.rolled, t.cfg.storm_window)


@query("largest_storm", over("near", sql="""
SELECT id, host, severity, started_at FROM starts, (SELECT s AS first FROM near WHERE within >= 5
  ORDER BY within DESC, s LIMIT 1) b WHERE s BETWEEN first AND first + 300"""))
def _(t):
    return grouping.largest_storm(t.rolled, t.cfg)


# one burst a step: the densest window of what no burst has taken, the earliest on a tie
@query("storm_groups", over("starts", sql="""
WITH per AS (SELECT s, count(*) AS n FROM starts GROUP BY s),
ahead AS (SELECT a.s, b.s AS t, b.n FROM per a JOIN per b ON b.s BETWEEN a.s AND a.s + 300),
pick AS (SELECT 0 AS step, CAST([] AS STRUCT(s BIGINT, lo BIGINT, hi BIGINT)[]) AS taken
  UNION ALL SELECT step + 1, list_append(any_value(taken), arg_max(struct_pack(s := s, lo := s - 300, hi := last + 300), within * 1000000000000 - s))
  FROM (SELECT p.step, p.taken, q.s, CAST(sum(q.n) AS BIGINT) AS within, max(q.t) AS last FROM pick p JOIN ahead q
    ON len(list_filter(p.taken, lambda x: (q.s BETWEEN x.lo AND x.hi) OR (q.t BETWEEN x.lo AND x.hi))) = 0 GROUP BY 1, 2, 3 HAVING sum(q.n) >= 5) w GROUP BY step),
spans AS (SELECT unnest(taken) AS x, generate_subscripts(taken, 1) AS k FROM (SELECT taken FROM pick ORDER BY step DESC LIMIT 1) f)
SELECT id, arg_min(x.s, k) AS burst, host, severity, started_at FROM starts JOIN spans ON s BETWEEN x.lo AND x.hi GROUP BY id, host, severity, started_at
""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(t):
    return grouping.storm_groups(t.rolled, t.cfg)


@query("open_roots", over("roots", sql="SELECT id, host, started_at FROM roots"))
def _(t):
    return roots_of(t).select("id", "host", "started_at")


@query("root_outage_groups", over("starts", "roots", sql="""
WITH ok AS (SELECT r.s, max(r.id) AS root_id FROM roots r WHERE (SELECT count(*) FROM starts c WHERE c.s BETWEEN r.s - 300 AND r.s + 300) >= 2
  GROUP BY r.s),
placed AS (SELECT c.id, c.host, c.started_at, arg_max(ok.root_id, ok.s) AS root_id FROM starts c JOIN ok ON c.s BETWEEN ok.s - 300 AND ok.s + 300
  GROUP BY 1, 2, 3)
SELECT * FROM (SELECT root_id, id, host, started_at, count(*) OVER (PARTITION BY root_id) AS members FROM placed) x WHERE members >= 2"""))
def _(t):
    return grouping.root_outage_groups(t.rolled, roots_of(t), t.cfg)


@query("mark_root_down", over("spans", "roots", sql="""
SELECT group_id, lo, hi, EXISTS (SELECT 1 FROM roots WHERE s BETWEEN lo AND hi) AS root_down FROM spans"""))
def _(t):
    return grouping.mark_root_down(grouping.member_spans(t.incidents, 300), roots_of(t))


@query("join_waiting_group", over("spans", "cand", sql="""
SELECT c.id, max(g.group_id) AS group_id FROM cand c JOIN spans g ON c.s BETWEEN g.lo AND g.hi GROUP BY c.id"""))
def _(t):
    return grouping.join_waiting_group(grouping.group_candidates(t.incidents), grouping.member_spans(t.incidents, 300))


@query("group_rollup", over("groups", sql="SELECT * FROM groups"))
def _(t):
    return grouping.group_rollup(t.incidents, t.now)


@query("group_titles", over("groups", sql=f"""
SELECT group_id, CASE WHEN first_id % 2 = 0 THEN '{adapters.ROOT}' ELSE 'several' END AS host, CASE WHEN group_id % 3 = 0 THEN 'kept'
  WHEN first_id % 2 = 0 THEN 'Chain after an outage of {adapters.ROOT} (' || CAST(members AS VARCHAR) || ')'
  ELSE 'Burst (' || CAST(members AS VARCHAR) || ')' END AS title FROM (SELECT *, min(first_id) OVER () AS x FROM groups) g"""))
def _(t):
    groups = grouping.group_rollup(t.incidents, t.now).withColumn("root_down", F.col("first_id") % 2 == 0) \
        .withColumn("analysis_state", F.when(F.col("group_id") % 3 == 0, "done").otherwise("held")) \
        .withColumn("title", F.lit("kept"))
    return grouping.group_titles(groups, t.cfg).select("group_id", "host", "title")


@query("changed_groups", over("groups", sql="""
SELECT group_id, members, severity, started_at, last_occurrence_at, problem_status, resolved_at,
  CASE WHEN group_id % 4 = 1 AND problem_status = 'resolved' THEN 'resolved' WHEN group_id % 4 = 1 AND problem_status = 'open'
    THEN 'reopened' END AS event FROM groups WHERE group_id % 4 <= 1"""))
def _(t):
    new = grouping.group_rollup(t.incidents, t.now)
    old = new.withColumn("members", F.when(F.col("group_id") % 4 == 0, F.col("members") + 1).otherwise(F.col("members"))) \
        .withColumn("problem_status", F.when(F.col("group_id") % 4 == 1, "unknown").otherwise(F.col("problem_status")))
    return grouping.changed_groups(old, new)
