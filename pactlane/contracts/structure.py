"""Structural rules of Open Data Contract Standard documents, written out by hand."""

from __future__ import annotations

from typing import Any

CURRENT = tuple(f"v3.{x}" for x in ("1.0", "0.2", "0.1", "0.0"))
OLD = tuple(f"v2.2.{x}" for x in (2, 1))

LOGICAL_TYPES = tuple("array boolean date integer number object string time timestamp".split())
DIMENSIONS = tuple("accuracy completeness conformity consistency coverage timeliness uniqueness".split())
METRICS = tuple(f"{x}Values" for x in "null missing invalid duplicate".split()) + ("rowCount",)
COMPARISONS = tuple("mustBe mustNotBe mustBeGreaterThan mustBeGreaterOrEqualTo mustBeLessThan mustBeLessOrEqualTo mustBeBetween mustNotBeBetween".split())
RANGES = ("mustBeBetween", "mustNotBeBetween")


class ContractError(ValueError):
    """A contract breaks a structural rule; path says where."""

    def __init__(self, path: str, message: str) -> None:
        super().__init__(f"{path}: {message}")
        self.path = path


def supported_versions() -> list[str]:
    return [*CURRENT, *OLD]


def _need(node: Any, path: str, keys: tuple[str, ...]) -> None:
    if not isinstance(node, dict):
        raise ContractError(path, "an object is expected")
    for k in keys:
        if node.get(k) is None:
            raise ContractError(path, f"'{k}' is required")


def _list(node: dict, key: str, path: str) -> list:
    value = node.get(key)
    if value is None:
        return []
    if not isinstance(value, list):
        raise ContractError(f"{path}.{key}", "a list is expected")
    return value


def _quality(entry: Any, path: str) -> None:
    _need(entry, path, ())
    kind = entry.get("type")
    if kind == "custom":
        _need(entry, path, ("engine", "implementation"))
    if kind == "sql":
        _need(entry, path, ("query",))
    if kind == "library" and entry.get("metric") is None and entry.get("rule") is None:
        raise ContractError(path, "'metric' is required")
    if entry.get("dimension") is not None and entry["dimension"] not in DIMENSIONS:
        raise ContractError(f"{path}.dimension", f"one of {', '.join(DIMENSIONS)} is expected")
    for key in RANGES:
        bounds = entry.get(key)
        if bounds is not None and (not isinstance(bounds, list) or len(bounds) != 2):
            raise ContractError(f"{path}.{key}", "a list of two numbers is expected")


def _property(node: Any, path: str, named: bool = True) -> None:
    _need(node, path, ("name",) if named else ())
    kind = node.get("logicalType")
    if kind is not None and kind not in LOGICAL_TYPES:
        raise ContractError(f"{path}.logicalType", f"one of {', '.join(LOGICAL_TYPES)} is expected")
    for k, entry in enumerate(_list(node, "quality", path)):
        _quality(entry, f"{path}.quality[{k}]")
    for k, inner in enumerate(_list(node, "properties", path)):
        _property(inner, f"{path}.properties[{k}]")
    if isinstance(node.get("items"), dict):
        _property(node["items"], f"{path}.items", named=False)


def validate_structure(data: Any) -> None:
    """Raise ValueError for a missing or unknown apiVersion, ContractError for a broken rule."""
    if not isinstance(data, dict):
        raise ContractError("$", "an object is expected")
    version = data.get("apiVersion")
    if not version:
        raise ValueError("the contract has no apiVersion")
    if version not in supported_versions():
        raise ValueError(f"apiVersion {version!r} is not supported; known are {', '.join(supported_versions())}")
    if version in OLD:
        for k, entry in enumerate(_list(data, "dataset", "$")):
            _need(entry, f"$.dataset[{k}]", ("table",))
        return
    _need(data, "$", ("version", "apiVersion", "kind", "id", "status"))
    if data["kind"] != "DataContract":
        raise ContractError("$.kind", "'DataContract' is expected")
    for k, server in enumerate(_list(data, "servers", "$")):
        _need(server, f"$.servers[{k}]", ("server", "type"))
    for k, schema in enumerate(_list(data, "schema", "$")):
        path = f"$.schema[{k}]"
        _need(schema, path, ())
        for j, entry in enumerate(_list(schema, "quality", path)):
            _quality(entry, f"{path}.quality[{j}]")
        for j, node in enumerate(_list(schema, "properties", path)):
            _property(node, f"{path}.properties[{j}]")
