"""Registry of runnable queries, each with the SQL it must agree with."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from wattframe.plans.tables import SQL_TABLES, Tables
from wattframe.session import tune

PLAN_MODULES = (
    "time_plans",
    "ingest_plans",
    "enrich_plans",
    "flow_plans",
    "metric_plans",
    "report_plans",
    "record_plans",
    "quality_plans",
    "source_plans",
    "stream_plans",
)


@dataclass(frozen=True)
class Query:
    """A query over the given tables and its SQL twin, where SQL can say it."""

    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(tune(spark), sf_dir))

    def full_sql(self) -> str | None:
        return None if self.sql is None else with_tables(self.sql)


_REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` under a name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"query {name} registered twice")
        _REGISTRY[name] = Query(name, fn, sql)
        return fn

    return register


def with_tables(body: str) -> str:
    """Prefix the domain tables (x_...) a statement mentions, and theirs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bx_\w+", text):
            if name in SQL_TABLES and name not in needed:
                visit(SQL_TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL_TABLES[n]})" for n in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


@cache
def catalog() -> dict[str, Query]:
    for module in PLAN_MODULES:
        importlib.import_module(f"wattframe.plans.{module}")
    return dict(_REGISTRY)
