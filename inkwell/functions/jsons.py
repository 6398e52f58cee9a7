"""JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    """Control characters inside strings are let through, and what follows the first value is left off; half a value is none."""

    def no(name: str):
        raise ValueError(name)

    decode = json.JSONDecoder(strict=False, parse_constant=no)

    def first(text: str) -> str | None:
        for start in dict.fromkeys((0, (re.search(r"[{\[]", text) or re.match("", text)).start())):
            try:
                value, end = decode.raw_decode(text, start)
            except ValueError:
                continue
            if start or not text[end:].strip() or text[0] in "{[":
                return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return None

    return texts.map(first, na_action="ignore")


def first_value(text: Column) -> Column:
    """The first JSON value in a text, as JSON: alone, in a code fence, or before and among prose, with raw control characters in its strings or not; null if
    there is none, or only half of one. Only texts that don't parse as they are go through Python."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    good = F.try_parse_json(bare)
    return F.coalesce(F.to_json(good), _repaired(F.when(good.isNull(), bare)))


def merged(a: Column, b: Column) -> Column:
    """Maps joined; ``b`` wins."""
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), b)


def without(values: Column, keys: tuple[str, ...]) -> Column:
    """A map without ``keys``."""
    return F.map_filter(values, lambda k, v: ~k.isin(*keys))
