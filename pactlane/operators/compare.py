"""Comparison of a check's single value with what the contract expects."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts.structure import COMPARISONS

_RULES = {
    "mustBe": lambda a, e: a == e,
    "mustNotBe": lambda a, e: a != e,
    "mustBeGreaterThan": lambda a, e: a > e,
    "mustBeGreaterOrEqualTo": lambda a, e: a >= e,
    "mustBeLessThan": lambda a, e: a < e,
    "mustBeLessOrEqualTo": lambda a, e: a <= e,
    "mustBeBetween": lambda a, e: e[0] <= a <= e[1],
    "mustNotBeBetween": lambda a, e: not e[0] <= a <= e[1],
}


def expectation(definition: dict[str, Any]) -> tuple[str, Any]:
    """(operator, expected) of a quality entry: the first comparison key with a value, else ("unknown", None)."""
    return next(((k, definition[k]) for k in COMPARISONS if definition.get(k) is not None), ("unknown", None))


def holds(operator: str, actual: Any, expected: Any) -> bool:
    """Whether actual meets the expectation; an unknown operator is never met, ordering against None raises TypeError."""
    rule = _RULES.get(operator)
    return bool(rule(actual, expected)) if rule else False


def holds_column(operator: str, actual: Column, expected: Any) -> Column:
    """The same rule over a column of actual values; null is met by no rule but mustNotBe."""
    if operator == "mustBe":
        return F.coalesce(actual == F.lit(expected), F.lit(False))
    if operator == "mustNotBe":
        return F.coalesce(actual != F.lit(expected), F.lit(True))
    if operator == "mustBeBetween":
        return F.coalesce(actual.between(*expected), F.lit(False))
    if operator == "mustNotBeBetween":
        return F.coalesce(~actual.between(*expected), F.lit(False))
    return F.coalesce(_RULES[operator](actual, F.lit(expected)), F.lit(False)) if operator in _RULES else F.lit(False)
