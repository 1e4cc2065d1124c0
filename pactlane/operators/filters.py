"""Row filters: conditions on a table's rows, chosen by table name or pattern."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import name, number

OPERATORS = tuple("= != > >= < <=".split()) + tuple(n + o for o in ("IN", "LIKE") for n in ("", "NOT ")) + ("IS NULL", "IS NOT NULL")


@dataclass(frozen=True)
class FilterCondition:
    """One condition: a column, an operator of OPERATORS, and a value (a list for IN, none for the null tests)."""

    field: str
    operator: str
    value: Any = None

    def column(self, schema: T.StructType | None = None, try_cast: bool = False) -> Column:
        """The condition as a Column. With the table's schema and try_cast, text is compared with numbers as a number."""
        c, op, v = F.col(name(self.field)), self.operator.upper().strip(), self.value
        if op == "IS NULL":
            return c.isNull()
        if op == "IS NOT NULL":
            return c.isNotNull()
        if op in ("IN", "NOT IN"):
            found = c.isin([_literal(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])])
            return found if op == "IN" else ~found
        if op in ("LIKE", "NOT LIKE"):
            found = c.cast("string").like(str(v))
            return found if op == "LIKE" else ~found
        if op not in OPERATORS:
            raise ValueError(f"operator {self.operator!r} is not supported; known are {', '.join(OPERATORS)}")
        kind = next((f.dataType for f in schema or [] if f.name.lower() == self.field.lower()), None)
        if try_cast and isinstance(kind, T.StringType):
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                c = F.expr(number(self.field, kind).replace("\\", "\\\\"))
            elif isinstance(v, bool):
                c = c.try_cast("boolean")
        value = F.lit(_literal(v))
        return {"=": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]


def _literal(value: Any) -> Any:
    """None, truth values and numbers stay; all else is text."""
    return value if value is None or isinstance(value, (bool, int, float)) else str(value)


def conditions(given: Any) -> list[FilterCondition]:
    """A condition or several, as objects or as mappings with the same keys."""
    if given is None:
        return []
    many = list(given) if isinstance(given, Sequence) and not isinstance(given, str) else [given]
    return [x if isinstance(x, FilterCondition) else FilterCondition(**x) for x in many]


def for_table(filters: Mapping[str, Any] | None, table: str) -> list[FilterCondition]:
    """Conditions of every key that is the table's name or a pattern (*, ?, [..]) of it, in the keys' order."""
    return [c for key, given in (filters or {}).items() if key == table or fnmatchcase(table, key) for c in conditions(given)]


def apply(df: DataFrame, found: list[FilterCondition], try_cast: bool = True) -> DataFrame:
    """df where all conditions hold; Catalyst takes them to the scan."""
    return df.where(reduce(lambda a, b: a & b, (c.column(df.schema, try_cast) for c in found))) if found else df
