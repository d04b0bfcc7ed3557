"""Query registry: name -> (callable, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and, where SQL can express them, their oracle."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql.strip()
            return f

        return add


def summed_digest_sql(line: str, prefix: str = "''") -> str:
    """SQL of the digest of a multiset of lines (see ``operators.analytics``)."""
    parts = ", ".join(f"coalesce(sum(('0x' || substr(sha256({line}), {1 + 8 * i}, 8))::BIGINT), 0)::VARCHAR" for i in range(8))
    return f"sha256({prefix} || concat_ws(':', count(*)::VARCHAR, {parts}))"
