"""Where queries are registered: a name, the job, and SQL that gives the same rows (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.derived import TABLES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a job. sql: a select over the derived tables, or WITH (RECURSIVE), more named tables and a select."""

    def add(job: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = job
        if sql is not None:
            body, tables = sql.strip(), TABLES_SQL
            if body.startswith("WITH RECURSIVE "):
                body, tables = body.replace(" RECURSIVE", "", 1), tables.replace("WITH", "WITH RECURSIVE", 1)
            ORACLE[name] = tables + body.removeprefix("WITH ") if body.startswith("WITH ") else f"{tables.rstrip(', \n')}\n{body}"
        return job

    return add
