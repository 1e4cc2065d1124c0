"""SQL text of safe casts: what counts as a value of a logical type, decided by the column's static type where possible."""

from __future__ import annotations

from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)
_MOMENT = (T.DateType, T.TimestampType, T.TimestampNTZType)

#: Text that Spark would cast although it is no plain number (a type suffix), and the shape of a date.
_SUFFIX, _DATE = r"(?i)[0-9.][df]\s*$", r"^\s*\d{4}-\d{1,2}-\d{1,2}"


def literal(value: object) -> str:
    """SQL literal; strings are raw (the engine's session keeps backslashes)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    doubled = str(value).replace("'", 2 * "'")
    return f"'{doubled}'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def number(column: str, kind: T.DataType) -> str:
    """The column as a double; null where it isn't a number."""
    c = name(column)
    if isinstance(kind, T.DoubleType):
        return c
    if isinstance(kind, (*_NUMERIC, T.BooleanType)):
        return f"CAST({c} AS DOUBLE)"
    if isinstance(kind, T.StringType):
        return f"TRY_CAST(CASE WHEN NOT ({c} RLIKE {literal(_SUFFIX)}) THEN {c} END AS DOUBLE)"
    return "CAST(NULL AS DOUBLE)"


def text(column: str, kind: T.DataType) -> str:
    return name(column) if isinstance(kind, T.StringType) else f"CAST({name(column)} AS STRING)"


def not_of_type(column: str, kind: T.DataType, logical: str) -> str | None:
    """Predicate of the non-null values that are none of the logical type; FALSE where none can be, None for an unchecked type."""
    c, is_text = name(column), isinstance(kind, T.StringType)
    never, always = "FALSE", f"{c} IS NOT NULL"
    if logical == "string":
        return never
    if logical == "integer":
        if isinstance(kind, (*_WHOLE, T.BooleanType)):
            return never
        if isinstance(kind, T.DecimalType):
            return f"{c} <> FLOOR({c})"
        d = number(column, kind)
        return f"{c} IS NOT NULL AND ({d} IS NULL OR {d} <> FLOOR({d}) OR ISNAN({d}))" if is_text or isinstance(kind, (T.FloatType, T.DoubleType)) else always
    if logical == "number":
        return never if isinstance(kind, (*_NUMERIC, T.BooleanType)) else f"{c} IS NOT NULL AND {number(column, kind)} IS NULL" if is_text else always
    if logical == "boolean":
        return never if isinstance(kind, (*_NUMERIC, T.BooleanType)) else f"{c} IS NOT NULL AND TRY_CAST({c} AS BOOLEAN) IS NULL" if is_text else always
    if logical in ("date", "timestamp"):
        target = "DATE" if logical == "date" else "TIMESTAMP_NTZ"
        guarded = f"CASE WHEN {c} RLIKE {literal(_DATE)} THEN {c} END"
        return never if isinstance(kind, _MOMENT) else f"{c} IS NOT NULL AND TRY_CAST({guarded} AS {target}) IS NULL" if is_text else always
    if logical == "time":
        return never if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) or kind.typeName().startswith("time(") else f"{c} IS NOT NULL AND TRY_CAST({c} AS TIME(6)) IS NULL" if is_text else always
    return None
