"""From a contract to its checks: those its columns imply first, then those it lists."""

from __future__ import annotations

import warnings
from typing import TYPE_CHECKING, Any

from ..contracts.structure import LOGICAL_TYPES, METRICS
from ..operators.compare import expectation
from . import ir

if TYPE_CHECKING:
    from ..contracts import Contract

OPTIONS = {"minLength": "shorter than", "maxLength": "longer than", "pattern": "not matching", "minimum": "below", "maximum": "above", "exclusiveMinimum": "not above", "exclusiveMaximum": "not below", "multipleOf": "no multiple of"}
UNCHECKED_TYPES = ("object", "array")
KINDS = ("sql", "library", "custom")


def _implied(schema: str, prop: dict[str, Any], path: str) -> list[ir.Check]:
    column, logical = prop["name"], prop.get("logicalType")
    out: list[ir.Check] = []

    def add(name: str, ref: str, node: Any, dimension: str, description: str) -> None:
        definition = {"type": "sql", "name": name, "dimension": dimension, "description": description, "mustBe": 0}
        out.append(ir.Check(path, "generated", ref, schema, column, name, node, "mustBe", 0, definition, description, logical))

    add(f"{column}_column_exists_check", "DeclaredColumnExistsCheckReference", ir.ColumnExists(column), "conformity", f"column {column} exists")
    if logical in UNCHECKED_TYPES:
        warnings.warn(f"{schema}.{column}: values of type {logical} are not checked", stacklevel=2)
    elif logical in LOGICAL_TYPES:
        add(f"{column}_logical_type_check", "LogicalTypeCheckReference", ir.TypeOf(column, logical), "conformity", f"values of {column} are of type {logical}")
    for option, value in (prop.get("logicalTypeOptions") or {}).items():
        if value is None:
            continue
        if option not in OPTIONS:
            warnings.warn(f"{schema}.{column}: option {option} is not checked", stacklevel=2)
            continue
        if option == "multipleOf" and value == 0:
            node: Any = ir.Unusable("multipleOf must not be 0")
        else:
            node = ir.Option(column, option, value)
        add(f"{column}_logical_type_options_{option}_check", "LogicalTypeOptionsCheckReference", node, "conformity", f"no value of {column} is {OPTIONS[option]} {value}")
    if prop.get("required") is True:
        add(f"{column}_required_check", "RequiredCheckReference", ir.Nulls(column), "completeness", f"{column} has no null")
    if prop.get("unique") is True:
        add(f"{column}_unique_check", "UniqueCheckReference", ir.DuplicateKeys((column,)), "consistency", f"no value of {column} repeats")
    if prop.get("primaryKey") is True:
        add(f"{column}_primary_key_check", "PrimaryKeyCheckReference", ir.NullsAndDuplicates(column), "consistency", f"{column} has no null and no repeated value")
    return out


def _metric(entry: dict[str, Any], column: str | None) -> Any:
    metric, arguments = entry.get("metric"), entry.get("arguments") or {}
    known = [m for m in METRICS if m != "rowCount"] if column else ["rowCount", "duplicateValues"]
    if metric not in known:
        return ir.Unusable(f"metric {metric!r} is not supported here; supported are {', '.join(known)}")
    if metric == "rowCount":
        return ir.RowCount()
    if metric == "nullValues":
        node: Any = ir.Nulls(column)
    elif metric == "missingValues":
        values = arguments.get("missingValues", [None])
        node = ir.Missing(column, tuple(values if isinstance(values, list) else [values]))
    elif metric == "invalidValues":
        values, pattern = arguments.get("validValues", entry.get("validValues")), arguments.get("pattern")
        if not values and not pattern:
            return ir.Unusable("invalidValues needs validValues or a pattern")
        node = ir.Invalid(column, tuple(values) if values else None, pattern)
    else:
        columns = (column,) if column else tuple(arguments.get("properties") or ())
        if not columns:
            return ir.Unusable("duplicateValues of a table needs properties")
        node = ir.DuplicateKeys(columns)
    return ir.Percent(node) if f"{entry.get('unit')}".lower() == "percent" else node


def _listed(schema: str, column: str | None, entry: dict[str, Any], path: str, logical: str | None) -> ir.Check:
    kind = entry.get("type") or ("library" if entry.get("metric") else "sql")
    operator, expected = expectation(entry)
    level = "Column" if column else "Table"
    name = entry.get("name") or (None if kind == "library" else entry.get("id")) or f"{column or schema}_{(entry.get('metric') if kind == 'library' else None) or entry.get('metric') or entry.get('dimension') or 'check'}"
    if kind == "library":
        metric = str(entry.get("metric"))
        ref, node = f"{metric[:1].upper()}{metric[1:]}{level * (metric == 'duplicateValues')}CheckReference", _metric(entry, column)
    elif kind == "sql":
        ref, node = f"SQL{level}CheckReference", ir.SqlQuery(entry["query"]) if entry.get("query") else ir.Unusable("the check has no query")
    elif kind == "custom":
        ref, node = f"Custom{level}CheckReference", ir.Custom(entry.get("engine") or "unknown", entry.get("implementation"))
    else:
        ref, node = f"Unsupported{level}CheckReference", ir.Unusable(f"checks of type {kind!r} are not supported; supported are {', '.join(KINDS)}")
        kind = "unsupported"
    unit = entry.get("unit") if isinstance(entry.get("unit"), str) else None
    return ir.Check(path, kind, ref, schema, column, str(name), node, operator, expected, dict(entry), entry.get("description"), logical, unit)


def checks_by_schema(contract: Contract) -> dict[str, list[ir.Check]]:
    """Checks of each named schema: implied by its columns, listed at the table, listed at its columns."""
    out: dict[str, list[ir.Check]] = {}
    for k, schema in contract.schemas():
        name, path = schema["name"], f"$.schema[{k}]"
        found = out.setdefault(name, [])
        named = [(j, p) for j, p in enumerate(schema.get("properties") or []) if p.get("name")]
        for j, p in named:
            found += _implied(name, p, f"{path}.properties[{j}]")
        for j, entry in enumerate(schema.get("quality") or []):
            found.append(_listed(name, None, entry, f"{path}.quality[{j}]", None))
        for j, p in named:
            for i, entry in enumerate(p.get("quality") or []):
                found.append(_listed(name, p["name"], entry, f"{path}.properties[{j}].quality[{i}]", p.get("logicalType")))
    return out
