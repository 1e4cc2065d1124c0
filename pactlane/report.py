"""Text reports of a result."""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .result import CheckResult, ValidationResult

WIDTH = 60


def percent(value: float | None) -> str:
    """One decimal, never rounded up; a dash for none."""
    return "-" if value is None else f"{math.floor(value * 10) / 10:.1f}%"


def share(part: int, whole: int) -> str:
    return f"{part} / {whole} ({percent(part / whole * 100 if whole else 100.0)})"


def _cell(value: object) -> str:
    text = "" if value is None else str(value)
    return text if len(text) <= WIDTH else text[: WIDTH - 3] + "..."


def ascii_table(header: list[str], rows: list[list[object]], rules_before: set[int] | None = None) -> str:
    """A boxed table; a rule is drawn before each row whose place is in rules_before."""
    cells = [[_cell(v) for v in r] for r in rows]
    widths = [max(len(h), *(len(r[k]) for r in cells)) if cells else len(h) for k, h in enumerate(header)]
    rule = "".join("+" + "-" * (w + 2) for w in widths) + "+"
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, widths)) + " |"
    out = [rule, line(header), rule]
    for k, r in enumerate(cells):
        if k and k in (rules_before or set()):
            out.append(rule)
        out.append(line(r))
    return "\n".join([*out, rule])


def summary_text(result: ValidationResult) -> str:
    s = result.summary["validation_summary"]
    out = [
        f"Validation of {result.contract_id} (api {result.api_version})", f"  schemas         {', '.join(result.schema_names)}",
        f"  checks passed   {share(s['passed'], s['total_checks'])}", f"  checks failed   {s['failed']}", f"  checks in error {s['errors']}" + ("  <- look at these" if s["errors"] else ""),
    ]
    for name, b in result.schema_breakdown().items():
        out += [f"  {name}", f"    all checks      {share(b.overall.passed_checks, b.overall.total_checks)}, in error {b.overall.error_checks}", f"    one table       {share(b.single_table.passed_checks, b.single_table.total_checks)}"]
        if b.single_table.total_rows is not None:
            out.append(f"    unique rows     {b.single_table.passed_unique_rows} of {b.single_table.total_rows} pass ({percent(b.single_table.passed_row_percentage)})")
        if b.multi_table.total_checks:
            out.append(f"    several tables  {share(b.multi_table.passed_checks, b.multi_table.total_checks)}, failing rows (not unique) {b.multi_table.failed_non_unique_rows}")
    checks = result.sorted_checks()
    rows = [[c.check_name, c.status, c.metadata.get("target"), "several" if result.is_cross_table(c) else "one", c.metadata.get("operator"), c.expected_value, c.actual_value, f"{c.execution_time_ms:.1f}"] for c in checks]
    breaks = {k for k in range(1, len(checks)) if checks[k].status != checks[k - 1].status}
    out.append(ascii_table(["check", "status", "target", "tables", "operator", "expected", "actual", "ms"], rows, breaks))
    out.append(f"  total {s['total_execution_time_ms']:.1f} ms")
    return "\n".join(out)


def _about(c: CheckResult, indent: str) -> list[str]:
    parts = [("operator", c.metadata.get("operator")), ("expected", c.expected_value), ("actual", c.actual_value), ("target", c.metadata.get("target")), ("details", c.details), ("rule", c.metadata.get("rendered_implementation"))]
    return [f"{indent}{k:<9} {v}" for k, v in parts if v not in (None, "")]


def failed_checks_text(result: ValidationResult) -> str:
    failed = [c for c in result.check_results if c.status == "FAILED"]
    if not failed:
        return "\nNo check failed."
    return "\n".join([f"\nFailed checks: {len(failed)}", *(line for c in failed for line in [f"  {c.check_name}", *_about(c, "    ")])])


def rows_text(df: DataFrame, max_rows: int) -> str:
    """Up to max_rows rows (-1: all) as a table."""
    if not df.columns:
        return "(no rows to show)"
    taken = df.collect() if max_rows < 0 else df.take(max_rows)
    return ascii_table(df.columns, [list(r) for r in taken]) if taken else "(no rows to show)"


def failed_rows_text(result: ValidationResult, max_rows: int = 5) -> str:
    out = []
    for schema in result.schema_names:
        failed = [c for c in result.of_schema(schema) if c.status == "FAILED"]
        for title, several in (("checks of one table", False), ("checks of several tables", True)):
            part = [c for c in failed if result.is_cross_table(c) is several]
            if part:
                out.append(f"\n{schema}: {title}")
            for c in part:
                out += [f"  {c.check_name}", *_about(c, "    "), rows_text(c.failed_rows, max_rows)]
    return "\n".join(out) if out else "\nNo failing rows."
