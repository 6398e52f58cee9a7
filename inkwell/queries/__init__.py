"""Registered queries over the tables, each with the SQL that its result is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.sources.views import SQL as VIEWS
from inkwell.sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``. Views that ``sql`` names are defined before it."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            views = [f"{v} AS ({text})" for v, text in VIEWS.items() if re.search(rf"\b{v}\b", sql)]
            body = sql.strip()
            if views:
                recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
                rest = re.sub(r"(?i)^WITH (RECURSIVE )?", ", ", body)
                body = f"WITH {recursive}{', '.join(views)}{'' if rest != body else ' '}{rest}"
            ORACLE_SQL[name] = body
        return f

    return register


from inkwell.queries import aggregations, composite, filters, joins, numbers, scans, sorting, state, texts  # noqa: E402, F401
