"""Settings of a validation run."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any


@dataclass
class ValidationConfig:
    """max_rows_for_statistics: cap of the row counts (-1: none). enable_additional_schema_statistics: count rows
    at all. max_failed_rows: cap of each check's failing rows (-1: none). use_try_cast: casts and comparisons in
    checks give null instead of an error."""

    use_try_cast: bool = True
    max_failed_rows: int = -1
    max_rows_for_statistics: int = -1
    enable_additional_schema_statistics: bool = True

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
