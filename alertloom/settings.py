"""Options with their defaults, and the fixed values that results depend on."""
from __future__ import annotations

from dataclasses import dataclass, field

PROBLEM, SECURITY, GROUP = "problem", "security", "group"
SOURCES = (PROBLEM, SECURITY, GROUP)
STATES = ("held", "queued", "retry_wait", "running", "done", "failed", "skipped", "grouped")
WAITING = ("held", "queued", "retry_wait")
STATUSES = ("open", "resolved", "oneshot")
TYPES = ("cpu", "mem", "swap", "disk", "io", "net", "container", "service", "auth", "user", "file", "pkg", "other")

# Names of the severity levels of the metrics monitor, 0 to 5.
SEVERITY_NAMES = ("Not classified", "Information", "Warning", "Average", "High", "Disaster")

# Item keys of a host that can not be reached start with one of these.
AVAILABILITY_KEY_PREFIXES = ("icmpping", "agent.ping", "zabbix[host")

# Length limits of kept text fields.
TITLE_LIMIT, LOG_LIMIT, ID_LIMIT, HOST_LIMIT, OPDATA_LIMIT = 200, 2000, 64, 120, 500
KEPT_TAGS, KEPT_HOSTS, KEPT_ITEMS = 30, 5, 20


@dataclass(frozen=True)
class TypeRules:
    """Ordered rules that give an alert its type."""
    # Component tag of a problem.
    component_tags: dict[str, str] = field(default_factory=lambda: {
        "cpu": "cpu", "memory": "mem", "storage": "disk", "network": "net"})
    # Item key prefixes, tried in this order.
    key_prefixes: tuple[tuple[str, str], ...] = (
        ("system.cpu.util[,iowait", "io"), ("system.cpu.", "cpu"), ("vm.memory.", "mem"), ("system.swap.", "swap"),
        ("vfs.fs.", "disk"), ("vfs.dev.", "io"), ("net.if.", "net"), ("icmpping", "net"), ("agent.ping", "net"),
        ("docker.", "container"), ("proc.", "service"), ("systemd.", "service"))
    # Security rules named by id.
    rule_ids: dict[str, str] = field(default_factory=lambda: {"100100": "service", "100101": "service"})
    # Security rule groups, tried in this order.
    groups: tuple[tuple[str, str], ...] = (
        ("authentication_failed", "auth"), ("authentication_failures", "auth"), ("adduser", "user"),
        ("sudo", "user"), ("sshd", "auth"), ("syscheck", "file"), ("dpkg", "pkg"), ("firewall", "net"))


@dataclass(frozen=True)
class Settings:
    """Thresholds, windows and budgets. Times are seconds unless the name says otherwise."""
    min_severity: int = 2
    fetch_min_severity: int = 1
    min_level: int = 10
    # Security rules that are always analysed.
    named_rules: tuple[str, ...] = ("100101", "5710", "5712", "5716", "5720", "550", "553", "554", "5402", "5901", "5902")
    hold_problem: int = 60
    hold_security: int = 120
    recurrence_gap: int = 1800
    followup_after: int = 7200
    skip_resolved_after: int = 21600
    storm_count: int = 5
    storm_window: int = 300
    root_host: str = "host-0"
    retry_delays: tuple[int, ...] = (60, 300, 900)
    poll_interval_problem: int = 30
    poll_interval_security: int = 60
    poll_backoff_max: int = 600
    poll_auth_backoff: int = 900
    overlap: int = 120
    first_lookback: int = 3600
    missing_rounds: int = 3
    stuck_limit: int = 3
    incomplete_limit: int = 3
    stale_intervals: int = 3
    model_backoff_min: int = 5
    model_backoff_max: int = 600
    model_auth_backoff: int = 900
    stall_warn: int = 600
    max_output_tokens: int = 1200
    context_tokens: int = 131072
    cases_budget: int = 900
    stats_budget: int = 200
    dynamic_budget: int = 5000
    section_budget: int = 3000
    card_budget: int = 6000
    margin_percent: int = 10
    max_sections: int = 3
    history_days: int = 7
    history_max: int = 10
    stats_days: int = 30
    retention_incident_days: int = 180
    retention_payload_days: int = 90
    retention_skipped_days: int = 14
    max_rows: int = 500
    timezone: str = "Asia/Tokyo"
    type_rules: TypeRules = field(default_factory=TypeRules)
