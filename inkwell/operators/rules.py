"""Predicates from data: issue lists, optional filters, patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))


def first_issue(checks: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, c in reversed(checks.items()):
        out = F.when(c, name).otherwise(out)
    return out


def json_contains(text: Column, wanted: dict) -> Column:
    """The object has all of ``wanted`` at its top level."""
    return reduce(Column.__and__, [F.get_json_object(text, f"$.{k}") == F.lit(str(v)) for k, v in wanted.items()])


def where_given(df: DataFrame, equal: dict, since: dict | None = None) -> DataFrame:
    """Filters for those values that are given."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == value)
    for name, value in (since or {}).items():
        df = df if value is None else df.where(F.col(name) >= value)
    return df


def patched(df: DataFrame, patch: dict, allowed: tuple[str, ...]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in patch.items() if k in allowed})


def at_least(version: Column, least: tuple[int, int, int]) -> Column:
    """Versions of three numbers (with a suffix after - or +), compared number by number; anything else is under every version."""
    shape = r"^([0-9]+)\.([0-9]+)\.([0-9]+)(?:[-+].*)?$"
    parts = F.array(*[F.regexp_extract(F.trim(version), shape, k).try_cast("long") for k in (1, 2, 3)])
    return F.coalesce(F.trim(version).rlike(shape) & (parts >= F.array(*[F.lit(n).cast("long") for n in least])), F.lit(False))


def may_claim(version: Column, capabilities: Column, least: tuple[int, int, int], capability: str) -> Column:
    """A worker may claim a job if its version and its list of capabilities allow it."""
    return at_least(version, least) & F.coalesce(F.array_contains(capabilities, capability), F.lit(False))
