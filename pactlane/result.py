"""Results of a run: single checks, roll-ups over rows and schemas, output tables and files."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.casts import literal
from .functions.casts import name as quoted

STATUSES = ("FAILED", "ERROR", "PASSED")
MARKS = ("check_id", "check_ids", "tables_in_query")

#: Columns of the table of checks that come first, in this order.
FIRST_COLUMNS = (
    "check_name target schema_name engine type dimension description status severity operator actual_value expected_value failed_rows_count "
    "aggregation_type message rendered_implementation tables_in_query check_path check_ref_type logical_type is_generated"
).split()


class CheckResult:
    """Outcome of one check. failed_rows is a lazy Spark DataFrame, made when first asked for."""

    def __init__(
        self, check_name, status: str, details="", actual_value: Any = None, expected_value: Any = None, failed_rows_fetcher: Callable[[], DataFrame] | None = None,
        failed_rows_count=0, supports_row_level_output=False, metadata: dict | None = None, execution_time_ms=0.0, where: tuple[str, str] | None = None,
    ) -> None:
        self.check_name, self.status, self.details = check_name, status, details
        self.actual_value, self.expected_value = actual_value, expected_value
        self.failed_rows_count, self.supports_row_level_output = failed_rows_count, supports_row_level_output
        self.metadata, self.execution_time_ms = metadata or {}, execution_time_ms
        self.where = where
        self._fetch, self._rows = failed_rows_fetcher, None

    @property
    def failed_rows(self) -> DataFrame:
        """Failing rows; without columns if there are none to show or they can't be selected (with a warning)."""
        if self._rows is None and self._fetch is not None:
            try:
                self._rows = self._fetch()
            except Exception as e:
                warnings.warn(f"failing rows of {self.check_name} can't be selected: {str(e).splitlines()[0]}", stacklevel=2)
            self._fetch = None
        if self._rows is None:
            self._rows = SparkSession.active().createDataFrame([], T.StructType([]))
        return self._rows

    @property
    def tables(self) -> list[str]:
        return self.metadata.get("tables_in_query") or []

    def __repr__(self) -> str:
        return f"CheckResult({self.check_name!r}: {self.status})"


@dataclass(frozen=True)
class RowQualitySummary:
    """Rows of a table, those with a fault, those without, and their share in per cent."""

    total_rows: int
    clean_records: int
    records_with_issues: int
    data_quality: float


@dataclass(frozen=True)
class CheckStatusSummary:
    passed_checks: int
    error_checks: int
    total_checks: int

    @classmethod
    def of(cls, checks: Sequence[CheckResult]) -> CheckStatusSummary:
        return cls(sum(c.status == "PASSED" for c in checks), sum(c.status == "ERROR" for c in checks), len(checks))


@dataclass(frozen=True)
class SingleTableSummary(CheckStatusSummary):
    failed_unique_rows: int = 0
    passed_unique_rows: int = 0
    total_rows: int | None = None
    passed_row_percentage: float | None = None


@dataclass(frozen=True)
class MultiTableSummary(CheckStatusSummary):
    failed_non_unique_rows: int = 0


@dataclass(frozen=True)
class SchemaValidationBreakdown:
    overall: CheckStatusSummary
    single_table: SingleTableSummary
    multi_table: MultiTableSummary


def comparable(df: DataFrame) -> DataFrame:
    """df with maps and variants as JSON text, so that its rows can be grouped."""
    odd = [f.name for f in df.schema if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant"]
    return df.withColumns({c: F.to_json(quoted(c)) for c in odd}) if odd else df


class ValidationResult:
    """Everything a run found; its methods for reports return the result itself."""

    def __init__(self, check_results: list[CheckResult], summary: dict[str, Any], contract: Any, schema_names: Sequence[str], engine: Any = None) -> None:
        self.summary, self.check_results, self.contract = summary, check_results, contract
        self.schema_names, self._engine = list(schema_names), engine
        self._totals: dict[str, int] = summary["validation_summary"]["total_rows_by_schema"]
        self._row_quality: dict[str, RowQualitySummary] | None = None

    def __repr__(self) -> str:
        s = self.summary["validation_summary"]
        return f"<ValidationResult of {s['total_checks']} checks: {s['failed']} failed, {s['errors']} in error>"

    @property
    def passed(self) -> bool:
        """No check failed; checks that ended in an error don't count here (see has_errors)."""
        return self.summary["validation_summary"]["failed"] == 0

    @property
    def has_errors(self) -> bool:
        return self.summary["validation_summary"]["errors"] > 0

    @property
    def api_version(self) -> str:
        return self.contract_data["apiVersion"]

    @property
    def contract_id(self) -> str:
        return self.contract_data.get("id") or "unknown"

    @property
    def contract_data(self) -> dict[str, Any]:
        return self.contract.contract_data

    def cleanup(self) -> None:
        """Drop the views of the run; failing rows can't be selected afterwards."""
        if self._engine is not None:
            self._engine.cleanup()

    @staticmethod
    def is_cross_table(check: CheckResult) -> bool:
        return len(check.tables) > 1

    def of_schema(self, schema: str) -> list[CheckResult]:
        return [c for c in self.check_results if c.metadata.get("schema_name") == schema]

    def sorted_checks(self) -> list[CheckResult]:
        """Failed, then errors, then passed; by schema, several tables before one, and by name."""
        place = {s: k for k, s in enumerate(self.schema_names)}
        return sorted(self.check_results, key=lambda c: (STATUSES.index(c.status), place.get(c.metadata.get("schema_name"), len(place)), not self.is_cross_table(c), c.check_name))

    def _declared_columns(self, schema: str) -> list[str]:
        for _, s in self.contract.schemas():
            if s["name"] == schema:
                return [p["name"] for p in s.get("properties") or [] if p.get("name")]
        return []

    def _failing_keys(self, schema: str, checks: list[CheckResult]) -> list[DataFrame]:
        """Failing rows of the checks, restricted to the contract's columns, one frame a set of columns."""
        declared = self._declared_columns(schema)
        groups: dict[tuple[str, ...], list[DataFrame]] = {}
        scans: dict[str, list[str]] = {}
        frames: list[DataFrame] = []
        for c in checks:
            if c.where and self._engine is not None and self._engine.max_failed_rows < 0:
                scans.setdefault(c.where[0], []).append(c.where[1])
            else:
                frames.append(c.failed_rows)
        for table, wheres in scans.items():  # row predicates of one table: one scan finds the rows that break any
            frames.append(self._engine.spark.sql(f"SELECT * FROM {quoted(table)} WHERE " + " OR ".join(f"({w})" for w in wheres)))
        for df in frames:
            own = [c for c in declared if c in df.columns] or [c for c in df.columns if c not in MARKS]
            if own:
                groups.setdefault(tuple(own), []).append(comparable(df.select(*(quoted(c) for c in own))))
        return [reduce(lambda a, b: a.unionByName(b), found).distinct() for found in groups.values()]

    def row_quality(self) -> dict[str, RowQualitySummary]:
        """For each schema with checks of single rows: rows, distinct rows with a fault, the rest, and the rest's share."""
        if self._row_quality is None:
            self._row_quality = {}
            for schema, total in self._totals.items():
                mine = [c for c in self.of_schema(schema) if c.status != "ERROR" and not self.is_cross_table(c) and c.supports_row_level_output]
                if not mine:
                    continue
                bad = sum(keys.count() for keys in self._failing_keys(schema, [c for c in mine if c.status == "FAILED"]))
                clean = max(total - bad, 0)
                self._row_quality[schema] = RowQualitySummary(total, clean, bad, clean / total * 100 if total else 100.0)
        return self._row_quality

    def schema_breakdown(self) -> dict[str, SchemaValidationBreakdown]:
        """For each schema: counts over all checks, those of one table (with row quality) and those of several."""
        out = {}
        for schema in self.schema_names:
            mine = self.of_schema(schema)
            one, several = [c for c in mine if not self.is_cross_table(c)], [c for c in mine if self.is_cross_table(c)]
            quality, total = self.row_quality().get(schema), self._totals.get(schema)
            bad = quality.records_with_issues if quality else 0
            good = max((total or 0) - bad, 0)
            out[schema] = SchemaValidationBreakdown(
                CheckStatusSummary.of(mine),
                SingleTableSummary(**asdict(CheckStatusSummary.of(one)), failed_unique_rows=bad, passed_unique_rows=good, total_rows=total, passed_row_percentage=good / total * 100 if total else None),
                MultiTableSummary(**asdict(CheckStatusSummary.of(several)), failed_non_unique_rows=sum(c.failed_rows_count for c in several if c.status == "FAILED" and c.supports_row_level_output)),
            )
        return out

    def _outputs(self, checks: Sequence[str]) -> list[tuple[str, CheckResult]]:
        found = {}
        for c in self.check_results:
            if c.status != "ERROR" and (not checks or c.check_name in checks):
                schema = c.metadata.get("schema_name")
                found[f"{schema}::{c.check_name}" if schema else c.check_name] = c
        return sorted(found.items(), key=lambda x: x[0])

    def get_output_dfs(self, checks: Sequence[str] = ()) -> dict[str, DataFrame]:
        """Failing rows of every check that isn't an error, by schema::check, with check_id and tables_in_query."""
        return {k: c.failed_rows.withColumns({"check_id": F.lit(c.check_name), "tables_in_query": F.lit(", ".join(sorted(c.tables)))}) for k, c in self._outputs(checks)}

    def get_consolidated_output_dfs(self, checks: Sequence[str] = ()) -> dict[str, DataFrame]:
        """One frame a set of tables and columns: each distinct failing row with the names of all checks it fails.

        Row predicates of one table are told apart in one scan; grouping runs on the cluster; only
        whether a frame has rows is asked of it.
        """
        groups: dict[tuple[str, frozenset[str]], list[DataFrame]] = {}
        scans: dict[str, list[tuple[str, str]]] = {}

        def add(tables: str, df: DataFrame) -> None:
            groups.setdefault((tables, frozenset(df.columns) - {"check_id"}), []).append(df)

        for _, c in self._outputs(checks):
            if c.status != "FAILED":
                continue
            if c.where and self._engine is not None and self._engine.max_failed_rows < 0:
                if c.failed_rows_count or c.actual_value:
                    scans.setdefault(c.where[0], []).append((c.check_name, c.where[1]))
            elif c.failed_rows.columns and not c.failed_rows.isEmpty():
                add(", ".join(sorted(c.tables)), comparable(c.failed_rows).withColumn("check_id", F.array(F.lit(c.check_name))))
        for table, found in scans.items():
            names = ", ".join(f"CASE WHEN {where} THEN {literal(name)} END" for name, where in found)
            any_ = " OR ".join(f"({where})" for _, where in found)
            add(table, comparable(self._engine.spark.sql(f"SELECT *, ARRAY_COMPACT(ARRAY({names})) AS check_id FROM {quoted(table)} WHERE {any_}")))
        merged: dict[str, list[DataFrame]] = {}
        for (tables, _), frames in groups.items():
            rows = reduce(lambda a, b: a.unionByName(b), frames)
            data = [quoted(c) for c in rows.columns if c != "check_id"]
            ids = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("check_id")))), ", ")
            merged.setdefault(tables or "unknown", []).append(rows.groupBy(*data).agg(ids.alias("check_ids")).withColumn("tables_in_query", F.lit(tables)))
        return {k if len(found) == 1 else f"{k}__{i}": df for k, found in sorted(merged.items()) for i, df in enumerate(found, 1)}

    def check_rows(self) -> list[dict[str, Any]]:
        """One flat mapping a check; fields of its contract entry next to what the run computed."""
        safe = lambda v: str(v) if isinstance(v, (list, dict)) else v
        out = []
        for c in self.check_results:
            computed = {k: v for k, v in c.metadata.items() if k != "contract_definition"}
            out.append({
                "check_name": c.check_name, "status": c.status, "expected_value": None if c.expected_value is None else str(c.expected_value), "actual_value": None if c.actual_value is None else str(c.actual_value),
                "failed_rows_count": c.failed_rows_count, "message": c.details if c.status == "ERROR" else "", "execution_time_ms": c.execution_time_ms,
                **{k: safe(v) for k, v in {**c.metadata.get("contract_definition", {}), **computed}.items()},
            })
        return out

    def get_check_results_df(self) -> DataFrame:
        """The table of checks as a Spark DataFrame; numbers and flags the run computed keep their types, all else is text."""
        rows = self.check_rows()
        extra = list(dict.fromkeys(k for r in rows for k in r if k not in FIRST_COLUMNS))
        names = [c for c in FIRST_COLUMNS if any(c in r for r in rows)] + extra
        kinds = {"failed_rows_count": T.LongType(), "execution_time_ms": T.DoubleType(), "is_generated": T.BooleanType(), "multi_source": T.BooleanType()}
        schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
        plain = lambda n, v: v if v is None or n in kinds else str(v)
        session = self._engine.parent if self._engine is not None else SparkSession.active()
        return session.createDataFrame([tuple(plain(n, r.get(n)) for n in names) for r in rows], schema)

    def print_summary(self) -> ValidationResult:
        from .report import summary_text

        print("\n" + summary_text(self))
        return self

    def show_failed_checks(self) -> ValidationResult:
        from .report import failed_checks_text

        print(failed_checks_text(self))
        return self

    def show_failed_rows(self, max_rows=5) -> ValidationResult:
        from .report import failed_rows_text

        print(failed_rows_text(self, max_rows))
        return self

    def display_full_report(self, max_rows=5) -> ValidationResult:
        return self.print_summary().show_failed_rows(max_rows)

    def save(self, output_dir: str | Path = ".", prefix="validation_results") -> ValidationResult:
        """The table of checks and the summary as single files, each consolidated table as a CSV folder written by the cluster."""
        import csv

        out = Path(output_dir)
        out.mkdir(parents=True, exist_ok=True)
        table = self.get_check_results_df()
        places = [out / f"{prefix}_check_results.csv"]
        with places[0].open("w", newline="") as f:
            writer = csv.writer(f)
            writer.writerow(table.columns)
            writer.writerows(table.collect())
        for key, df in self.get_consolidated_output_dfs().items():
            places.append(out / f"{prefix}_{key.replace(', ', '_')}.csv")
            self.save_dataframe(df, str(places[-1]))
        places.append(out / f"{prefix}_summary.json")
        places[-1].write_text(json.dumps(self.summary, indent=2, default=str))
        for p in places:
            print(f"saved {p}")
        return self

    @staticmethod
    def save_dataframe(df: DataFrame, filepath: str, file_format: str = "csv", **options: Any) -> None:
        """Write a frame as csv (with header), parquet, json lines or orc, in as many files as it has partitions."""
        if file_format not in ("csv", "parquet", "json", "orc"):
            raise ValueError(f"format {file_format!r} is not supported; known are csv, parquet, json, orc")
        if file_format == "csv":
            options = {"header": "true"} | options
            nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
            df = df.withColumns({c: F.to_json(quoted(c)) for c in nested}) if nested else df
        df.write.mode("overwrite").format(file_format).options(**options).save(filepath)
