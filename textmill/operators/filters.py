"""Conditions on a record's fields as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text

#: Comparisons follow SQL: a null is neither equal nor unequal to anything.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(*v),
    "nin": lambda c, v: ~c.isin(*v),
    "contains": lambda c, v: c.cast("string").contains(str(v)),
    "ncontains": lambda c, v: ~c.cast("string").contains(str(v)),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Condition:
    """``keys``: a DataFrame whose first column takes the place of ``value`` for ``in`` and ``nin``."""

    field: str
    operator: str
    value: Any = None
    reverse: bool = False
    keys: DataFrame | None = None

    def column(self) -> Column:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}; there are {', '.join(OPERATORS)}")
        found = OPERATORS[self.operator](F.col(f"`{self.field}`"), self.value)
        return ~found if self.reverse else found


def combine(columns: Sequence[Column], how: str = "and") -> Column:
    if not columns:
        return F.lit(True)
    return reduce(lambda a, b: a & b if how.lower() == "and" else a | b, columns)


def apply(df: DataFrame, conditions: Sequence[Condition], how: str = "and", reverse: bool = False) -> DataFrame:
    """Rows for which all (or any) of the conditions hold, or don't if ``reverse``."""
    plain = [c for c in conditions if c.keys is None]
    if how.lower() != "and" and len(plain) < len(conditions) or reverse and len(plain) < len(conditions):
        raise ValueError("keys can only be one of several conditions that must all hold")
    if plain:
        both = combine([c.column() for c in plain], how)
        df = df.where(~both if reverse else both)
    for c in conditions:
        if c.keys is not None:
            keys = c.keys.select(F.col(c.keys.columns[0]).alias("_key")).distinct()
            keep = "left_semi" if (c.operator == "in") != c.reverse else "left_anti"
            df = df.join(keys, F.col(f"`{c.field}`") == F.col("_key"), keep)
    return df


_UI: dict[str, Callable[[Column, str], Column]] = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
}


def ui_filter(schema: T.StructType, field: str, operator: str, value: str) -> Column:
    """A table view's filter: case doesn't matter, ``all`` or nothing as field means any field."""
    compare = _UI.get(operator, lambda c, v: c.contains(v))
    names = [f.name for f in schema.fields] if field in ("", "all") else [field]
    kinds = {f.name: f.dataType for f in schema.fields}
    each = [compare(F.lower(text.to_text(F.col(f"`{n}`"), kinds[n])), value.lower()) for n in names if n in kinds]
    return F.coalesce(combine(each, "or"), F.lit(False)) if each else F.lit(False)
