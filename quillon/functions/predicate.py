"""JSON predicates over a JSON payload, as boolean columns that are never null.

A predicate is a dict: {"op": "eq", "field": "tag", "value": "x"}, likewise ne,
gt, lt, gte, lte; {"op": "in", "field", "value": [..]}; {"op": "exists",
"field"}; {"op": "and" | "or", "filters": [..]}. Equality is strict about JSON
types: 1 isn't 1.0, and "1" neither. What is malformed matches nothing, and no
predicate matches a row without a payload.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOATS = r"^(DECIMAL|DOUBLE|FLOAT)"
_MISSING = object()


def _path(field: str) -> str | None:
    if "'" not in field:
        return f"$['{field}']"
    return f'$["{field}"]' if '"' not in field else None


class _Field:
    """A top-level key of the payload; its name isn't a path."""

    def __init__(self, variant: Column, path: str):
        self.variant, self.path = variant, path
        self.kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.variant, self.path, kind)

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.kind == "VOID"
        if isinstance(value, bool):
            return (self.kind == "BOOLEAN") & (self.get("boolean") == F.lit(value))
        if isinstance(value, int):
            return (self.kind == "BIGINT") & (self.get("bigint") == F.lit(value)) if -(2**63) <= value < 2**63 else F.lit(False)
        if isinstance(value, float):
            return self.kind.rlike(_FLOATS) & (self.get("double") == F.lit(value))
        if isinstance(value, str):
            return (self.kind == "STRING") & (self.get("string") == F.lit(value))
        if isinstance(value, (list, dict)):
            own = F.to_json(F.parse_json(F.lit(json.dumps(value))))
            return self.kind.rlike("^(ARRAY|OBJECT)") & (F.to_json(self.get("variant")) == own)
        return F.lit(False)

    def number(self) -> Column:
        return F.when(self.kind.rlike(_FLOATS) | (self.kind == "BIGINT"), self.get("double"))


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _built(variant: Column, p: Any) -> Column:
    no = F.lit(False)
    if not isinstance(p, dict):
        return no
    op = p.get("op")
    if op in ("and", "or"):
        parts = p.get("filters")
        if not isinstance(parts, list):
            return no
        out = F.lit(op == "and")
        for part in parts:
            out = (out & _built(variant, part)) if op == "and" else (out | _built(variant, part))
        return out
    field, value = p.get("field"), p.get("value", _MISSING)
    path = _path(field) if isinstance(field, str) else None
    if path is None:
        return no
    f = _Field(variant, path)
    if op == "exists":
        return f.kind.isNotNull()
    if value is _MISSING:
        return no
    if op == "eq":
        return F.coalesce(f.equals(value), no)
    if op == "ne":
        return ~F.coalesce(f.equals(value), no)
    if op == "in":
        out = no
        for x in value if isinstance(value, list) else []:
            out = out | F.coalesce(f.equals(x), no)
        return out
    if op in ("gt", "lt", "gte", "lte") and _is_number(value):
        n, v = f.number(), F.lit(float(value))
        return F.coalesce({"gt": n > v, "lt": n < v, "gte": n >= v, "lte": n <= v}[op], no)
    return no


def matches(payload: Column, predicate: dict | None) -> Column:
    """Whether the payload (a JSON string) satisfies the predicate; no predicate is always satisfied."""
    if predicate is None:
        return F.lit(True)
    return payload.isNotNull() & F.coalesce(_built(F.try_parse_json(payload), predicate), F.lit(False))
