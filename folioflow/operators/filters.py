"""JSON filters compiled to columns: $and $or $eq $ne $in $nin $gt $gte $lt $lte; several keys mean and."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"$eq": Column.__eq__, "$ne": Column.__ne__, "$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


class FilterError(ValueError):
    """A filter that is not well formed."""


def compile_filter(spec: dict[str, Any], fields: set[str]) -> Column:
    """A boolean column for a filter over the allowed fields; unknown operators and fields, empty lists and non-finite numbers raise."""
    if not isinstance(spec, dict) or not spec:
        raise FilterError("a filter is an object with a key or more")
    return reduce(Column.__and__, [_clause(k, v, fields) for k, v in spec.items()])


def _clause(key: str, value: Any, fields: set[str]) -> Column:  # noqa: ANN401
    if key in ("$and", "$or"):
        if not isinstance(value, list) or not value:
            raise FilterError(f"{key} takes a list with an element or more")
        return reduce(Column.__and__ if key == "$and" else Column.__or__, [compile_filter(v, fields) for v in value])
    if key.startswith("$"):
        raise FilterError(f"unknown operator {key}")
    if key not in fields:
        raise FilterError(f"unknown field {key}")
    if isinstance(value, list):
        raise FilterError("use $in for a list")
    if not isinstance(value, dict):
        return F.col(key) == _scalar(value)
    if not value:
        raise FilterError(f"no operator for {key}")
    return reduce(Column.__and__, [_compare(key, op, v) for op, v in value.items()])


def _compare(key: str, op: str, value: Any) -> Column:  # noqa: ANN401
    c = F.col(key)
    if op in ("$in", "$nin"):
        if not isinstance(value, list) or not value:
            raise FilterError(f"{op} takes a list with an element or more")
        inside = c.isin(*[_scalar(v) for v in value])
        return inside if op == "$in" else ~inside
    if op not in _COMPARE:
        raise FilterError(f"unknown operator {op}")
    return _COMPARE[op](c, _scalar(value))


def _scalar(value: Any) -> Any:  # noqa: ANN401
    if isinstance(value, float) and not math.isfinite(value):
        raise FilterError("numbers must be finite")
    if not isinstance(value, str | int | float | bool):
        raise FilterError(f"no value for a filter: {value!r}")
    return value
