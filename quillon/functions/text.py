"""Tokens and the text of JSON payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer tokens (in bytes of UTF-8) aren't indexed.
MAX_TOKEN = 40


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN))


def _strings(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        value = list(value.values())
    return [s for v in value for s in _strings(v)] if isinstance(value, list) else []


def _deep(payload: str | None) -> str | None:
    try:
        return None if payload is None else " ".join(_strings(json.loads(payload)))
    except ValueError:
        return None


def deep_text(payload: Column | str) -> Column:
    """All string values of a JSON payload of any depth, joined by a space; null where it isn't JSON."""

    @F.pandas_udf("string")
    def of(payloads: pd.Series) -> pd.Series:
        return payloads.map(_deep, na_action="ignore")

    return of(payload)
