"""Read-only gate for SQL text from contracts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class SQLSecurityError(Exception):
    """A query is refused; violation_type says why, query holds its first 500 characters."""

    def __init__(self, message: str, violation_type="unknown", query="") -> None:  # noqa: ANN001
        Exception.__init__(self, message)
        self.query, self.violation_type = query[:500], violation_type


_VALUE = r"(?:null|\d+|'[^']*')"
_VERBS = "|".join(sorted("alter create delete drop exec execute grant insert revoke truncate update".split(), key=len, reverse=True))

#: Kinds of suspect text, looked for before a query is parsed.
PATTERNS = {
    "statement_stacking": rf";\s*(?:{_VERBS})\b",
    "union_injection": rf"\bunion(?:\s+all)?\s+select\s+{_VALUE}(?:\s*,\s*{_VALUE})*\s*(?:--|\#|$)",
    "time_based_injection": r"waitfor\s+delay|(?:sleep|pg_sleep|benchmark)\s*\(",
    "error_based_injection": r"(?:updatexml|xmltype|extractvalue)\s*\(",
    "dangerous_operation": r";\s*(?:revoke|grant|truncate)\s",
    "schema_probing": r"(?:information_schema|sys|sysobjects|syscolumns|pg_catalog)\s*\.",
    "file_operation": r"bulk\s+insert|load_file|into\s+(?:dump|out)file",
    "command_execution": r"xp_cmdshell|sp_oacreate|dbms_pipe",
}
_SUSPECT = {k: re.compile(rf"(?:^|(?<![\w.])){p}" if k == "schema_probing" else p, re.I | re.S) for k, p in PATTERNS.items()}

_IDENTIFIER = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")

#: Plans of a plain SELECT, by the name of their root.
_SELECTS = {"Project", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Filter", "UnresolvedWith", "WithWindowDefinition", "Distinct", "Deduplicate", "OneRowRelation"}
_SETS = {"Union", "Intersect", "Except"}
_WRITES = re.compile(r"\b(InsertIntoStatement|CreateTable\w*|DropTable|DeleteFromTable|UpdateTable|MergeInto\w*|\w+Command)\b")


def detect_sql_injection(query: str):  # noqa: ANN201
    """(kind, found text) of the first suspect pattern."""
    for kind, pattern in _SUSPECT.items():
        if found := pattern.search(query or ""):
            return kind, found.group(0)[:100]
    return None


def parsed(spark: SparkSession, query: str):  # noqa: ANN201
    """Catalyst's unresolved plan of a query; nothing is run."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(query)


def _statements(query: str) -> list[str]:
    """Statements between semicolons outside of quotes."""
    parts = re.findall(r"(?:'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+", query, re.S)
    return [p.strip() for p in parts if p.strip()]


def validate_read_only_query(spark: SparkSession, query: str) -> None:
    """Refuse all but SELECT statements without side effects."""
    if not (query or "").strip():
        raise SQLSecurityError("an empty query is refused", "empty_query", query or "")
    statements = _statements(query)
    if not statements:
        raise SQLSecurityError("the query holds no statement", "no_statements", query)
    for text in statements:
        if re.match(r"(?is)\s*select\b(?:(?!\bfrom\b).)*\binto\s+[\w`\"]", re.sub(r"'(?:[^']|'')*'", "''", text)):
            raise SQLSecurityError("SELECT INTO makes a table and is refused", "write_operation", query)
        try:
            plan = parsed(spark, text)
        except Exception as e:
            raise SQLSecurityError(f"the query can't be parsed: {str(e).splitlines()[0]}", "parse_error", query) from e
        root, tree = plan.getClass().getSimpleName(), plan.toString()
        if root in ("UnresolvedWith", "CTEInChildren"):
            root = plan.child().getClass().getSimpleName()
        if root == "Distinct" and plan.children().size() and plan.children().apply(0).getClass().getSimpleName() in _SETS:
            root = "Union"
        if root not in _SELECTS:
            raise SQLSecurityError(f"only SELECT is allowed, not {root}", "write_operation", query)
        if _WRITES.search(re.sub(r"'[^\n]*?'", "", tree)) and re.search(rf"(?i)\(\s*(?:{_VERBS})\b", text):
            raise SQLSecurityError("a nested statement writes", "write_in_subquery", query)


def validate_query_security(spark: SparkSession, query: str) -> None:
    """Suspect text first, then the read-only rule."""
    if found := detect_sql_injection(query):
        raise SQLSecurityError(f"the query looks like an injection ({found[0]}): {found[1]!r}", f"injection_{found[0]}", query)
    validate_read_only_query(spark, query)


def sanitize_identifier(identifier: str) -> str:
    """The identifier if it is plain (letters, digits, underscores, dots between parts)."""
    if not identifier:
        raise SQLSecurityError("an identifier is empty", "empty_identifier", identifier or "")
    if not _IDENTIFIER.fullmatch(identifier):
        raise SQLSecurityError(f"{identifier!r} is no plain identifier", "invalid_identifier", identifier)
    return identifier


def to_table(spark: SparkSession, identifier: str) -> DataFrame:
    """The table of a plain identifier."""
    return spark.table(".".join(f"`{part}`" for part in sanitize_identifier(identifier).split(".")))
