"""Fixed schemas of raw input, tables and answers, as DDL."""
from __future__ import annotations

RAW_PROBLEM = """eventid STRING, objectid STRING, clock STRING, severity STRING, name STRING, opdata STRING, r_eventid STRING,
r_clock STRING, tags ARRAY<STRUCT<tag: STRING, value: STRING>>,
hosts ARRAY<STRUCT<hostid: STRING, host: STRING, name: STRING>>,
items ARRAY<STRUCT<itemid: STRING, key_: STRING, name: STRING>>"""

RAW_SECURITY = """_id STRING, _source STRUCT<timestamp: STRING, agent: STRUCT<id: STRING, name: STRING>,
rule: STRUCT<id: STRING, level: INT, description: STRING, groups: ARRAY<STRING>>,
data: STRUCT<srcip: STRING, dstuser: STRING>, syscheck: STRUCT<path: STRING, event: STRING>, full_log: STRING>"""

ALERTS = """seq BIGINT, source STRING, external_id STRING, fingerprint STRING, host STRING, type STRING, severity INT,
source_severity STRING, title STRING, started_at TIMESTAMP, resolved_at TIMESTAMP, availability BOOLEAN, analyzable BOOLEAN,
raw STRING"""

ANSWER = """summary STRING, classification STRUCT<kind: STRING, urgency: STRING>,
probable_causes ARRAY<STRUCT<cause: STRING, confidence: STRING, evidence: STRING>>,
impact STRUCT<services: ARRAY<STRING>, scope: STRING>,
recommended_checks ARRAY<STRUCT<purpose: STRING, where: STRING, command: STRING>>,
correlation STRUCT<incidents: ARRAY<STRING>, changes: ARRAY<STRING>>,
needs_human_decision BOOLEAN, unknowns ARRAY<STRING>"""
