"""Building blocks of the oracle queries: the adapter views and a plain row-by-row form of the intake rules."""
from __future__ import annotations

from alertloom.plans import adapters
from alertloom.plans.dialect import Duck

_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "arrivals0": ((), adapters.arrivals(Duck)),
    "arrivals": (("arrivals0",), adapters.alerts_of(Duck, "arrivals0")),
    "alerts": (("arrivals",), "SELECT * FROM arrivals WHERE external_id = CAST(seq AS VARCHAR)"),
    "ends": (("alerts",), """
SELECT *, max(busy) OVER (PARTITION BY source, fingerprint ORDER BY started_at, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_before
FROM (SELECT *, CASE WHEN source = 'security' THEN started_at WHEN resolved_at IS NULL THEN TIMESTAMP '2999-01-01 00:00:00'
    ELSE greatest(started_at, resolved_at) END AS busy FROM alerts WHERE analyzable) x"""),
    "numbered": (("ends",), """
SELECT *, sum(CASE WHEN busy_before IS NULL OR started_at - INTERVAL 1800 SECOND > busy_before THEN 1 ELSE 0 END)
  OVER (PARTITION BY source, fingerprint ORDER BY started_at, seq) AS nth FROM ends"""),
    "assigned": (("numbered",), """
SELECT *, first_value(seq) OVER (PARTITION BY source, fingerprint, nth ORDER BY started_at, seq) AS incident_id
FROM numbered"""),
    "rolled": (("assigned",), """
SELECT incident_id AS id, source, arg_min(external_id, seq) FILTER (seq = incident_id) AS external_id, fingerprint,
  max(host) AS host, max(type) AS type, arg_max(source_severity, severity * CAST(1000000000 AS BIGINT) - seq) AS source_severity,
  max(severity) AS severity, max(title) AS title, min(started_at) AS started_at, max(started_at) AS last_occurrence_at,
  CASE WHEN source = 'problem' AND count(*) = count(resolved_at) THEN max(resolved_at) END AS resolved_at,
  CASE WHEN source = 'security' THEN 'oneshot' WHEN count(*) = count(resolved_at) THEN 'resolved' ELSE 'open' END AS problem_status,
  bool_or(availability) FILTER (seq = incident_id) AS availability, count(*) AS occurrence_count,
  max(raw) FILTER (seq = incident_id) AS raw
FROM assigned GROUP BY incident_id, source, fingerprint"""),
    "below": (("alerts",), """
SELECT seq AS id, source, external_id, fingerprint, host, type, source_severity, severity, title, started_at,
  started_at AS last_occurrence_at, resolved_at,
  CASE WHEN source = 'security' THEN 'oneshot' WHEN resolved_at IS NULL THEN 'open' ELSE 'resolved' END AS problem_status,
  availability, CAST(1 AS BIGINT) AS occurrence_count, raw FROM alerts WHERE NOT analyzable"""),
    "every": (("rolled", "below"), "SELECT * FROM rolled UNION ALL SELECT * FROM below"),
    "incidents": (("every",), adapters.state_of(Duck, "every")),
    "log": ((), adapters.events_log(Duck)),
    "analyses": ((), adapters.analyses(Duck)),
    "cases": ((), adapters.cases(Duck)),
    "probes": ((), adapters.probe_results(Duck)),
    "polls": ((), adapters.poll_log(Duck)),
    "listings": ((), adapters.listings(Duck)),
    "rounds": ((), adapters.rounds(Duck)),
}


def add_block(name: str, needs: tuple[str, ...], sql: str) -> None:
    _BLOCKS[name] = (needs, sql)


def over(*names: str, sql: str) -> str:
    """``sql`` with a WITH clause for the named blocks and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in _BLOCKS[name][0]:
            visit(need)
        order.append(name)
    for name in names:
        visit(name)
    inner = ",\n".join(f"{n} AS ({_BLOCKS[n][1]})" for n in order)
    extra = sql.lstrip()
    if extra.upper().startswith("WITH "):
        return f"WITH {inner},\n{extra[5:]}"
    return f"WITH {inner}\n{extra}"
