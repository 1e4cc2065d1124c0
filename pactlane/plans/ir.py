"""Compiled checks: what a rule computes, on which table, and what it is held against."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class ColumnExists:
    column: str


@dataclass(frozen=True)
class TypeOf:
    """Values that are none of the column's logical type."""

    column: str
    logical: str


@dataclass(frozen=True)
class Option:
    """Values that break an option (minLength, maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf)."""

    column: str
    option: str
    value: Any


@dataclass(frozen=True)
class Nulls:
    column: str


@dataclass(frozen=True)
class Missing:
    column: str
    values: tuple


@dataclass(frozen=True)
class Invalid:
    """Non-null values outside the set and, where both are given, not of the pattern either."""

    column: str
    values: tuple | None
    pattern: str | None


@dataclass(frozen=True)
class DuplicateKeys:
    """Distinct non-null keys that occur more than once."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class NullsAndDuplicates:
    column: str


@dataclass(frozen=True)
class RowCount:
    pass


@dataclass(frozen=True)
class Percent:
    of: Any


@dataclass(frozen=True)
class SqlQuery:
    query: str


@dataclass(frozen=True)
class Custom:
    engine: str
    implementation: Any


@dataclass(frozen=True)
class Unusable:
    """A rule that can't be compiled; message says why."""

    message: str


PREDICATES = (TypeOf, Option, Nulls, Missing, Invalid)


@dataclass
class Check:
    """One rule of a contract. kind: generated, library, sql, custom or unsupported."""

    path: str
    kind: str
    ref_type: str
    schema: str | None
    column: str | None
    name: str
    node: Any
    operator: str
    expected: Any
    definition: dict[str, Any] = field(default_factory=dict)
    description: str | None = None
    logical_type: str | None = None
    unit: str | None = None

    @property
    def engine(self) -> str:
        return self.node.engine if isinstance(self.node, Custom) else "unsupported" if self.kind == "unsupported" else "sql"

    @property
    def target(self) -> str | None:
        return ".".join(x for x in (self.schema, self.column) if x) or None
