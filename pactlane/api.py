"""Entry point: validate tables against a contract."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .config import ValidationConfig
from .contracts import Contract
from .execute import Engine
from .plans import ir
from .result import ValidationResult
from .sources.adapters import BaseAdapter, MultiSourceAdapter, get_adapter


class ValidationRunner:
    """One run: sources to adapters, checks to results, results to a summary."""

    def __init__(self, contract: Contract, sources: Mapping[str, Any] | MultiSourceAdapter, config: ValidationConfig | None = None) -> None:
        self.contract, self.sources, self.config = contract, sources, config or ValidationConfig()

    def _adapters(self) -> MultiSourceAdapter:
        import warnings

        names = self.contract.get_schema_names()
        if isinstance(self.sources, MultiSourceAdapter):
            return self.sources
        for extra in [k for k in self.sources if k not in names]:
            warnings.warn(f"the contract declares no schema {extra!r}; its source is not used", stacklevel=3)
        missing = [n for n in names if n not in self.sources]
        if missing:
            raise ValueError(f"no source for schema {', '.join(missing)}")
        return MultiSourceAdapter({n: get_adapter(self.sources[n], n) for n in names})

    def _summary(self, results: list, totals: dict[str, int], connections: dict) -> dict[str, Any]:
        by = lambda status: sum(r.status == status for r in results)
        passed = by("PASSED")
        return {
            "validation_summary": {
                "total_checks": len(results), "passed": passed, "failed": by("FAILED"), "errors": by("ERROR"), "total_rows_by_schema": totals, "config": self.config.to_dict(),
                "failed_rows": sum(r.failed_rows_count for r in results if r.supports_row_level_output), "total_execution_time_ms": sum(r.execution_time_ms for r in results),
                "success_rate": passed / len(results) * 100 if results else 100, "connection_results": connections,
            },
            "check_results": [
                {"name": r.check_name, "status": r.status, "details": r.details, "expected_value": r.expected_value, "actual_value": r.actual_value, "failed_rows_count": r.failed_rows_count, "execution_time_ms": r.execution_time_ms, **r.metadata}
                for r in results
            ],
            "contract_metadata": self.contract.get_metadata(),
        }

    def run(self) -> ValidationResult:
        multi = self._adapters()
        for a in [multi, *multi.adapters.values()]:
            a.use_try_cast, a.max_failed_rows = self.config.use_try_cast, self.config.max_failed_rows
        checks = self.contract.get_check_references_by_schema()
        engine = Engine(multi, self.config.use_try_cast, self.config.max_failed_rows)
        tables = {s: sorted({t for c in found if isinstance(c.node, ir.SqlQuery) for t in engine.tables_of(c.node.query)}) for s, found in checks.items()}
        wanted, cap = self.config.enable_additional_schema_statistics, self.config.max_rows_for_statistics
        results = engine.run(checks, count_rows=wanted and cap < 0)
        connections = multi.test_connections(tables, engine.totals)  # a table that was scanned needs no probe
        totals: dict[str, int] = {}
        if wanted:
            totals = {n: engine.totals.get(n, 0) for n in multi.schema_names} if cap < 0 else multi.get_total_rows_by_schema(cap)
        return ValidationResult(results, self._summary(results, totals, connections), self.contract, multi.schema_names, engine)


def validate_data(
    contract: str | Path | Contract, *, df: Any = None, adapters: Mapping[str, Any] | MultiSourceAdapter | None = None, spark_session: SparkSession | None = None,
    adapter: BaseAdapter | None = None, connection_str: str | None = None, config: ValidationConfig | None = None, runner: type[ValidationRunner] = ValidationRunner,
) -> ValidationResult:
    """Check tables against a contract (an object, or where to load it from).

    Exactly one source: adapter (one for all schemas), df (a Spark or local frame, the same for all
    schemas), connection_str (a JDBC address or a path URI), spark_session (tables of its catalog), or
    adapters (a source for each schema, or a MultiSourceAdapter).
    """
    given = {k: v for k, v in (("adapter", adapter), ("df", df), ("connection_str", connection_str), ("spark_session", spark_session), ("adapters", adapters)) if v is not None}
    if len(given) != 1:
        raise ValueError(f"exactly one source is needed (adapter, df, connection_str, spark_session or adapters); given: {', '.join(given) or 'none'}")
    if isinstance(adapter, MultiSourceAdapter):
        raise TypeError("a MultiSourceAdapter is passed as adapters=")
    loaded = contract if isinstance(contract, Contract) else Contract.load(str(contract))
    names = loaded.get_schema_names()
    if not names:
        raise ValueError("the contract names no schema")
    if adapters is not None:
        sources: Any = adapters
    elif df is not None:
        sources = {n: df for n in names}
    else:
        one = get_adapter(next(iter(given.values())), names[0])
        sources = {n: one for n in names}
    return runner(loaded, sources, config).run()
