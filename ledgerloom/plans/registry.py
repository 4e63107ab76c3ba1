"""Named queries. Each is a function (spark, sf_dir) -> DataFrame with, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; role names used in ``sql`` become leading common table expressions."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        return fn

    return register


def with_roles(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for role, body in roles.ROLE_SQL.items():
            if role not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{role}\b", text):
                visit(body)
                needed.append(role)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{role} AS ({roles.ROLE_SQL[role]})" for role in needed)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    body = re.sub(r"^WITH\s+(RECURSIVE\s+)?", ",\n", body, flags=re.IGNORECASE) if body.upper().startswith("WITH") else body
    return f"WITH {recursive}{ctes}\n{body}"
