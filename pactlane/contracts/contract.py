"""A contract document: where it comes from, and how to find one's way in it."""

from __future__ import annotations

import json
import re
import urllib.request
import warnings
from collections.abc import Mapping
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

import yaml

from .structure import validate_structure

_ABOUT = "kind apiVersion version status id description".split()
_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\['([^']+)'\]|\[(\d+|\*)\]")


def _raw_address(url: str) -> str:
    """The address of a file's raw text where url shows it in a code host's page."""
    parts = urlsplit(url)
    if parts.netloc == "github.com" and "/blob/" in parts.path:
        return f"https://raw.githubusercontent.com{parts.path.replace('/blob/', '/', 1)}"
    return re.sub("(?<=/-/)blob(?=/)", "raw", url, count=1)


def _over_http(url: str) -> str:
    try:
        with urllib.request.urlopen(_raw_address(url), timeout=30) as answer:
            return answer.read().decode()
    except Exception as e:
        raise OSError(f"the contract at {url} can't be fetched: {e}") from e


def _from_bucket(uri: str) -> str:
    try:
        import boto3
    except ImportError as e:
        raise ImportError("boto3 is needed for contracts in s3") from e
    bucket, _, key = uri.removeprefix("s3://").partition("/")
    try:
        return boto3.client("s3").get_object(Bucket=bucket, Key=key)["Body"].read().decode()
    except Exception as e:
        raise OSError(f"the contract at {uri} can't be read: {e}") from e


def _through_spark(uri: str) -> str:
    from pyspark.sql import SparkSession

    try:
        return SparkSession.builder.getOrCreate().read.text(uri, wholetext=True).first()[0]
    except Exception as e:
        raise OSError(f"the contract at {uri} can't be read: {e}") from e


def _read(place: str) -> str:
    if re.match("https?:", place):
        return _over_http(place)
    if place.startswith("s3://"):
        return _from_bucket(place)
    if re.match(r"(dbfs|hdfs|s3a|abfss|gs|file):", place):
        return _through_spark(place)
    path = Path(place)
    if not path.exists():
        raise FileNotFoundError(f"no contract at {place}")
    try:
        return path.read_text(encoding="utf-8-sig")
    except (OSError, UnicodeDecodeError) as e:
        raise OSError(f"the contract at {place} can't be read: {e}") from e


class Contract:
    """A validated contract document (contract_data)."""

    def __init__(self, contract_data: Mapping[str, Any]) -> None:
        validate_structure(contract_data)
        self.contract_data = dict(contract_data)

    @classmethod
    def load(cls, contract_file_path: str | Path) -> Contract:
        """From YAML or JSON in a local file, at an http(s) address, in an s3 bucket or on a Hadoop file system."""
        text = _read(str(contract_file_path))
        data = json.loads(text) if str(contract_file_path).endswith(".json") else yaml.safe_load(text)
        if not data:
            raise ValueError(f"the contract at {contract_file_path} is empty")
        return cls(data)

    def get_version(self) -> str | None:
        return self.contract_data.get("version")

    def get_api_version(self) -> str:
        return self.contract_data["apiVersion"]

    def get_metadata(self) -> dict[str, Any]:
        return {k: self.contract_data.get(k) for k in _ABOUT}

    def schemas(self) -> list[tuple[int, dict[str, Any]]]:
        """(place, schema) of the schemas that have a name."""
        found = self.contract_data.get("schema") or []
        return [(k, s) for k, s in enumerate(found) if isinstance(s, dict) and s.get("name")]

    def get_schema_names(self) -> list[str]:
        return [s["name"] for _, s in self.schemas()]

    def get_schema_properties(self) -> dict[str, dict]:
        """Properties of the first schema by name."""
        first = next(iter(self.contract_data.get("schema") or []), {})
        return {p["name"]: p for p in first.get("properties") or [] if p.get("name")}

    def get_servers(self) -> list[dict[str, Any]]:
        return self.contract_data.get("servers") or []

    def get_server(self, server_name: str | None = None) -> dict[str, Any]:
        """By server name, else by environment; the first without a name."""
        known = self.get_servers()
        if not known:
            raise ValueError("the contract names no servers")
        matches = [s for key in ("server", "environment") for s in known if s.get(key) == server_name] if server_name is not None else known
        if not matches:
            raise ValueError(f"no server {server_name!r}; known are {', '.join(str(s.get('server')) for s in known)}")
        return matches[0]

    def resolve(self, jsonpath: str):  # noqa: ANN201
        """What a path such as $.schema[0].properties[2] leads to; the first of several (with a warning), None for a bad path."""
        if not jsonpath.startswith("$") or _STEP.sub("", jsonpath[1:]):
            warnings.warn(f"{jsonpath!r} is no path", stacklevel=2)
            return None
        found: list[Any] = [self.contract_data]
        for name, quoted, place in _STEP.findall(jsonpath[1:]):
            reached: list[Any] = []
            for node in found:
                if place == "*":
                    reached += list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
                elif place:
                    reached += [node[int(place)]] if isinstance(node, list) and int(place) < len(node) else []
                elif isinstance(node, dict) and (name or quoted) in node:
                    reached.append(node[name or quoted])
            found = reached
        if len(found) > 1:
            warnings.warn(f"{jsonpath!r} leads to {len(found)} places; the first is taken", stacklevel=2)
        return found[0] if found else None

    def resolve_parent(self, jsonpath: str, levels=1) -> str:  # noqa: ANN001
        """The path that many steps up."""
        steps = jsonpath.split(".")
        if levels >= len(steps):
            raise ValueError(f"{jsonpath!r} has no parent {levels} levels up")
        return ".".join(steps[:-levels]) if levels else jsonpath

    def get_check_references_by_schema(self, filter_conditions: Any = None) -> dict[str, list]:
        """The compiled checks of each named schema, in the order in which they are listed."""
        from ..plans.generate import checks_by_schema

        return checks_by_schema(self)
