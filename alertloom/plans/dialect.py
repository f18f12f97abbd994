"""The few expressions that Spark SQL and DuckDB spell differently, so that adapters can be written once."""
from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def add(ts: str, sec: str) -> str:
        return f"timestampadd(SECOND, CAST({sec} AS BIGINT), {ts})"

    @staticmethod
    def epoch(ts: str) -> str:
        return f"unix_timestamp({ts})"

    @staticmethod
    def at(sec: str) -> str:
        return f"timestamp_seconds({sec})"

    @staticmethod
    def sha(text: str) -> str:
        return f"sha2({text}, 256)"

    @staticmethod
    def second(ts: str) -> str:
        return f"date_trunc('second', CAST({ts} AS TIMESTAMP))"

    @staticmethod
    def pick(index: str, *values: str) -> str:
        inside = ", ".join(f"'{v}'" for v in values)
        return f"element_at(array({inside}), CAST(({index}) % {len(values)} + 1 AS INT))"

    @staticmethod
    def without(*names: str) -> str:
        return f"* EXCEPT ({', '.join(names)})"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def add(ts: str, sec: str) -> str:
        return f"({ts} + to_seconds(CAST({sec} AS BIGINT)))"

    @staticmethod
    def epoch(ts: str) -> str:
        return f"CAST(epoch({ts}) AS BIGINT)"

    @staticmethod
    def at(sec: str) -> str:
        return f"(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST({sec} AS BIGINT)))"

    @staticmethod
    def sha(text: str) -> str:
        return f"sha256({text})"

    @staticmethod
    def second(ts: str) -> str:
        return f"date_trunc('second', {ts})"

    @staticmethod
    def pick(index: str, *values: str) -> str:
        inside = ", ".join(f"'{v}'" for v in values)
        return f"list_extract([{inside}], CAST(({index}) % {len(values)} + 1 AS INTEGER))"

    @staticmethod
    def without(*names: str) -> str:
        return f"* EXCLUDE ({', '.join(names)})"
