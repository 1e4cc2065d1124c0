"""Running checks: one scan a table for all row predicates and counts, one statement for all key groups, the rest side by side."""

from __future__ import annotations

import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .functions import casts, sqltext
from .operators.compare import holds
from .operators.guard import SQLSecurityError, parsed, validate_query_security
from .plans import ir
from .result import CheckResult
from .sources.adapters import BaseAdapter, MultiSourceAdapter

#: Predicates that share one scan, so that the generated code stays within the compiler's method limits.
PREDICATES_A_SCAN = 100

#: Statements that run side by side.
SIDE_BY_SIDE = 4

#: Settings of the engine's own session; the caller's stays as it is.
SETTINGS = {
    "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.parser.escapedStringLiterals": "true", "spark.sql.timeType.enabled": "true",
}


def option_predicate(column: str, kind: T.DataType, option: str, value: Any) -> str:
    """Rows whose value breaks the option; a null breaks none."""
    if option in ("minLength", "maxLength"):
        return f"LENGTH({casts.text(column, kind)}) {'<' if option == 'minLength' else '>'} {int(value)}"
    if option == "pattern":
        return f"NOT ({casts.text(column, kind)} RLIKE {casts.literal(str(value))})"
    n, bound = casts.number(column, kind), casts.literal(float(value) if not isinstance(value, int) else value)
    if option == "multipleOf":
        return f"TRY_MOD({n}, CAST({bound} AS DOUBLE)) <> 0"
    return f"{n} {({'minimum': '<', 'maximum': '>', 'exclusiveMinimum': '<=', 'exclusiveMaximum': '>='})[option]} {bound}"


def predicate(node: Any, schema: T.StructType) -> str:
    """SQL of the rows that a row check counts."""
    kind = next((f.dataType for f in schema if f.name.lower() == node.column.lower()), T.StringType())
    c = casts.name(node.column)
    if isinstance(node, ir.TypeOf):
        return casts.not_of_type(node.column, kind, node.logical) or "FALSE"
    if isinstance(node, ir.Option):
        return option_predicate(node.column, kind, node.option, node.value)
    if isinstance(node, ir.Nulls):
        return f"{c} IS NULL"
    as_text = casts.text(node.column, kind)
    if isinstance(node, ir.Missing):
        values = [casts.literal(str(v)) for v in node.values if v is not None]
        parts = [f"{c} IS NULL"] * (None in node.values or not values) + ([f"{as_text} IN ({', '.join(values)})"] if values else [])
        return " OR ".join(parts)
    parts = [f"{c} IS NOT NULL"]
    if node.values is not None:
        parts.append(f"{as_text} NOT IN ({', '.join(casts.literal(str(v)) for v in node.values)})")
    if node.pattern:
        parts.append(f"NOT ({as_text} RLIKE {casts.literal(node.pattern)})")
    return " AND ".join(parts)


def _columns(node: Any) -> tuple[str, ...]:
    if isinstance(node, ir.Percent):
        return _columns(node.of)
    return node.columns if isinstance(node, ir.DuplicateKeys) else (node.column,) if hasattr(node, "column") else ()


def key_query(table: str, columns: Sequence[str], counted: str) -> str:
    """Groups of the keys of a table; counted is what to say of them."""
    keys = ", ".join(casts.name(c) for c in columns)
    return f"SELECT {counted} FROM (SELECT {keys}, COUNT(*) AS `__n` FROM {casts.name(table)} GROUP BY {keys})"


class BaseExecutor(ABC):
    """Base of executors for custom engines: made for an adapter, gives a result a check."""

    def __init__(self, adapter: Any) -> None:
        self.adapter: BaseAdapter = adapter

    @abstractmethod
    def run_single_check(self, check: ir.Check) -> CheckResult: ...

    def run_batch_checks(self, checks: Sequence[ir.Check]) -> list[CheckResult]:
        return [self.run_single_check(c) for c in checks]

    def cleanup(self) -> None:
        """Let go of what the executor holds."""


class SparkExecutor(BaseExecutor):
    """The engine behind the executor interface, over the tables of one adapter."""

    def run_batch_checks(self, checks: Sequence[ir.Check]) -> list[CheckResult]:
        """Results in the order of the checks; row and key checks share their scans."""
        tables = list(dict.fromkeys(c.schema for c in checks))
        self.engine = Engine(MultiSourceAdapter(dict.fromkeys(tables, self.adapter)), self.adapter.use_try_cast, self.adapter.max_failed_rows)
        found = {(r.metadata.get("check_path"), r.check_name): r for r in self.engine.run({t: [c for c in checks if c.schema == t] for t in tables}, count_rows=False)}
        return [found[c.path, c.name] for c in checks]

    def run_single_check(self, check: ir.Check) -> CheckResult:
        return self.run_batch_checks([check])[0]

    def cleanup(self) -> None:
        if hasattr(self, "engine"):
            self.engine.cleanup()


class _Compiled:
    """A check on its way: how it is computed and what came out."""

    def __init__(self, check: ir.Check) -> None:
        self.check = check
        self.sql = ""
        self.where: str | None = None
        self.percent = False
        self.keys: tuple[str, ...] | None = None
        self.rows_sql: str | None = None
        self.aggregation = "custom"
        self.tables: list[str] = [check.schema] if check.schema else []
        self.value: Any = None
        self.error: Exception | None = None
        self.result: CheckResult | None = None
        self.unsafe: str | None = None
        self.ms = 0.0
        self.done = False

    def rowwise(self) -> bool:
        return self.aggregation in ("count", "none") and (self.check.unit or "rows").lower() == "rows" and not self.percent and self.check.kind != "custom"


def cloned(parent: SparkSession) -> SparkSession:
    """A session with the settings, registered functions, temporary views and current database of another, free to change.

    Session cloning and frames of another session are no public API of Spark; both uses are here and in in_session().
    """
    return SparkSession(parent.sparkContext, parent._jsparkSession.cloneSession())


def in_session(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A frame of one session as a frame of another."""
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


class Engine:
    """Runs the checks of a contract over the tables of its adapters, in a session of its own.

    That session starts as the caller's is: time zone and all other settings, registered functions,
    temporary views, current database. Only SETTINGS differ, and the caller's session never changes.
    """

    def __init__(self, source: MultiSourceAdapter, use_try_cast: bool = True, max_failed_rows: int = -1) -> None:
        self.source, self.safe, self.max_failed_rows = source, use_try_cast, max_failed_rows
        first = next(a for a in source.adapters.values())
        self.parent: SparkSession = first.get_connection() if hasattr(first, "get_connection") else SparkSession.getActiveSession()
        self.spark = cloned(self.parent)
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        self.schemas: dict[str, T.StructType] = {}
        self.problems: dict[str, Exception] = {}
        self.totals: dict[str, int] = {}
        self._tables: dict[str, list[str]] = {}
        for name in source.schema_names:
            self._register(name)

    def _register(self, name: str) -> bool:
        """The table as a view of the engine's session, filters and all."""
        if name in self.schemas:
            return True
        try:
            adapter = self.source.get_adapter(name) or next(iter(self.source.adapters.values()))
            df = adapter.table(name)
            in_session(self.spark, df).createOrReplaceTempView(casts.name(name))
            self.schemas[name] = df.schema
            return True
        except Exception as e:
            self.problems[name] = e
            return False

    def tables_of(self, query: str) -> list[str]:
        """Names of the tables that a query reads (not those it defines by WITH), from Catalyst's parser, else from the text."""
        if query not in self._tables:
            self._tables[query] = self._find_tables(query)
        return self._tables[query]

    def _find_tables(self, query: str) -> list[str]:
        try:
            tree = parsed(self.spark, query).toString()
            own = {x.strip() for names in re.findall(r"\bCTE \[([^\]]*)\]", tree) for x in names.split(",")}
            return sorted({x.replace(" ", "").split(",")[-1].strip("`") for x in re.findall(r"UnresolvedRelation \[([^\]]+)\]", tree)} - own)
        except Exception:
            try:
                return sqltext.tables_by_text(query)
            except ValueError:
                return []

    def cleanup(self) -> None:
        for name in self.schemas:
            self.spark.catalog.dropTempView(name)

    def _compile(self, check: ir.Check) -> _Compiled:
        c = _Compiled(check)
        try:
            self._fill(c)
        except Exception as e:
            c.error, c.done = e, True
        return c

    def _fill(self, c: _Compiled) -> None:
        check, node = c.check, c.check.node
        if isinstance(node, ir.Unusable):
            raise ValueError(node.message)
        if isinstance(node, ir.Custom):
            c.sql = str(node.implementation)
            return
        if isinstance(node, ir.SqlQuery):
            self._fill_sql(c, node.query)
            return
        table = check.schema
        if table not in self.schemas:
            raise self.problems.get(table) or ValueError(f"no adapter for table {table!r}")
        schema, name = self.schemas[table], casts.name(table)
        known = {f.name.lower() for f in schema}
        for column in _columns(node):
            if column.lower() not in known:
                raise ValueError(f"column {column!r} isn't in table {table!r}; it has {', '.join(f.name for f in schema)}")
        inner = node.of if isinstance(node, ir.Percent) else node
        c.percent = isinstance(node, ir.Percent)
        if isinstance(node, ir.ColumnExists):
            c.sql, c.value, c.done, c.aggregation = f"SELECT COUNT(*) FROM (SELECT {casts.name(node.column)} FROM {name} LIMIT 0)", 0, True, "count"
            c.rows_sql = f"SELECT * FROM {name} LIMIT 0"
        elif isinstance(inner, ir.RowCount):
            c.where, c.sql, c.aggregation, c.rows_sql = "TRUE", f"SELECT COUNT(*) FROM {name}", "count", f"SELECT * FROM {name}"
        elif isinstance(inner, ir.PREDICATES):
            c.where = predicate(inner, schema)
            counted = f"SELECT COUNT(*) FROM {name} WHERE {c.where}"
            c.sql = f"SELECT COUNT_IF({c.where}) * 100.0D / NULLIF(COUNT(*), 0) FROM {name}" if c.percent else counted
            c.aggregation, c.rows_sql = ("custom", None) if c.percent else ("count", f"SELECT * FROM {name} WHERE {c.where}")
        else:
            c.keys = _columns(inner)
            keys = ", ".join(casts.name(k) for k in c.keys)
            full = " AND ".join(f"{casts.name(k)} IS NOT NULL" for k in c.keys)
            groups = f"SELECT {keys} FROM {name} WHERE {full} GROUP BY {keys} HAVING COUNT(*) > 1"
            if isinstance(inner, ir.NullsAndDuplicates):
                c.sql = f"SELECT (SELECT COUNT(*) FROM {name} WHERE {keys} IS NULL) + (SELECT COUNT(*) FROM ({groups}))"
            elif c.percent:
                c.sql = f"SELECT (SELECT COUNT(*) FROM ({groups})) * 100.0D / NULLIF((SELECT COUNT(*) FROM {name}), 0)"
            else:
                c.sql, c.aggregation, c.rows_sql = f"SELECT COUNT(*) FROM ({groups})", "count", groups

    def _fill_sql(self, c: _Compiled, query: str) -> None:
        tables = self.tables_of(query) if self._parses(query) else None
        plain = sqltext.normalise(query, False)
        c.sql, c.tables = plain, tables if tables is not None else self.tables_of(plain)
        validate_query_security(self.spark, query if tables is not None else plain)
        for t in c.tables:
            self._register(t)
        if self.safe:
            types = {f.name.lower(): f.dataType.simpleString() for t in c.tables for f in self.schemas.get(t, ()) if not isinstance(f.dataType, T.StringType)}
            types |= {f.name.lower(): "string" for t in c.tables for f in self.schemas.get(t, ()) if isinstance(f.dataType, T.StringType)}
            try:
                safe = sqltext.normalise(query, True, types)
                self.spark.sql(safe).schema
                c.sql = safe
            except Exception as e:  # the query as it is written is run instead, and says what is wrong with it
                c.unsafe = (str(e) or type(e).__name__).splitlines()[0]
        if c.sql != query:
            validate_query_security(self.spark, c.sql)
        c.aggregation = sqltext.aggregation_type(c.sql)
        c.rows_sql = sqltext.failed_rows_query(c.sql)
        if c.aggregation == "none":
            c.sql = sqltext.count_query(c.sql)
        found = sqltext.single_count(c.sql)
        if found and found[0] == c.check.schema and found[0] in self.schemas:
            c.where = found[1]

    def _parses(self, query: str) -> bool:
        try:
            parsed(self.spark, query.strip().rstrip(";"))
            return True
        except Exception:
            return False

    def _scan(self, table: str, found: list[_Compiled]) -> None:
        """Counts of all predicates of a table and its rows, in as few scans as the code limit allows."""
        for k in range(0, max(len(found), 1), PREDICATES_A_SCAN):
            part = found[k : k + PREDICATES_A_SCAN]
            started = time.perf_counter()
            wanted = ["COUNT(*)", *("COUNT(*)" if c.where == "TRUE" else f"COUNT_IF({c.where})" for c in part)]
            row = self.spark.sql(f"SELECT {', '.join(f'{x} AS c{i}' for i, x in enumerate(wanted))} FROM {casts.name(table)}").first()
            self.totals[table] = row[0]
            ms = (time.perf_counter() - started) * 1000 / max(len(part), 1)
            for c, n in zip(part, row[1:]):
                c.value, c.ms, c.done = (n * 100.0 / row[0] if row[0] else None) if c.percent else n, ms, True

    def _keys(self, found: list[_Compiled]) -> None:
        """Nulls and repeated keys of every distinct key of every table, as one statement."""
        wanted = sorted({(c.check.schema, c.keys) for c in found})
        started = time.perf_counter()
        parts = []
        for k, (table, keys) in enumerate(wanted):
            some_null = " OR ".join(f"{casts.name(x)} IS NULL" for x in keys)
            parts.append(key_query(table, keys, f"{k} AS k, COALESCE(SUM(CASE WHEN {some_null} THEN `__n` END), 0) AS nulls, COUNT_IF(`__n` > 1 AND NOT ({some_null})) AS repeated, COALESCE(SUM(`__n`), 0) AS total"))
        rows = {r["k"]: r for r in self.spark.sql(" UNION ALL ".join(parts)).collect()}
        ms = (time.perf_counter() - started) * 1000 / len(found)
        for c in found:
            r = rows[wanted.index((c.check.schema, c.keys))]
            n = r["repeated"] + (r["nulls"] if isinstance(c.check.node, ir.NullsAndDuplicates) else 0)
            c.value, c.ms, c.done = (n * 100.0 / r["total"] if r["total"] else None) if c.percent else n, ms, True

    def _alone(self, c: _Compiled) -> None:
        started = time.perf_counter()
        try:
            if isinstance(c.check.node, ir.Custom):
                self._custom(c)
            else:
                row = self.spark.sql(c.sql).take(1)
                c.value = row[0][0] if row else None
        except Exception as e:
            c.error = e
        c.ms, c.done = (time.perf_counter() - started) * 1000, True

    def _custom(self, c: _Compiled) -> None:
        """A registered executor: a BaseExecutor class, or callable(spark, df, check) that returns a value or (value, failing rows)."""
        adapter: BaseAdapter = self.source.get_adapter(c.check.schema) or self.source
        engine = c.check.node.engine
        if engine == "sql" and engine not in adapter.get_executors():
            text = c.check.node.implementation
            self._fill_sql(c, text if isinstance(text, str) else text["query"])
            row = self.spark.sql(c.sql).take(1)
            c.value = row[0][0] if row else None
            return
        own = adapter if engine in adapter.get_executors() else self.source
        registered = own.executor(engine)
        if isinstance(registered, type) and issubclass(registered, BaseExecutor):
            made = registered(adapter)
            try:
                c.result = made.run_single_check(c.check)
            finally:
                made.cleanup()
            return
        got = registered(self.spark, self.spark.table(casts.name(c.check.schema)) if c.check.schema in self.schemas else None, c.check)
        c.value, c.rows = got if isinstance(got, tuple) else (got, None)

    def _together(self, work: Callable[[], None], found: list[_Compiled]) -> None:
        """Run checks as one job; if it fails, each alone, so that one bad rule is one error."""
        try:
            work()
        except Exception:
            with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
                list(pool.map(self._alone, [c for c in found if not c.done]))

    def run(self, checks: dict[str, list[ir.Check]], count_rows: bool = True) -> list[CheckResult]:
        """Results: schema by schema those of one table (unsupported ones first), then those of several tables."""
        compiled = [self._compile(c) for found in checks.values() for c in found]
        jobs: list[Callable[[], None]] = []
        for table in checks:
            mine = [c for c in compiled if not c.done and c.where is not None and c.check.schema == table]
            if mine or (count_rows and table in self.schemas):
                jobs.append(lambda t=table, m=mine: self._together(lambda: self._scan(t, m), m))
        keyed = [c for c in compiled if not c.done and c.keys]
        if keyed:
            jobs.append(lambda: self._together(lambda: self._keys(keyed), keyed))
        jobs += [lambda c=c: self._alone(c) for c in compiled if not c.done and c.where is None and not c.keys]
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            list(pool.map(lambda job: job(), jobs))
        single, several = [], []
        for name in checks:
            mine = [c for c in compiled if c.check.schema == name]
            single += [c for c in mine if c.check.kind == "unsupported"] + [c for c in mine if c.check.kind != "unsupported" and len(c.tables) < 2]
            several += [c for c in mine if len(c.tables) > 1]
        return [self._result(c) for c in [*single, *several]]

    def _metadata(self, c: _Compiled) -> dict[str, Any]:
        check = c.check
        out = {
            "check_path": check.path, "check_ref_type": check.ref_type, "schema_name": check.schema, "operator": check.operator, "is_generated": check.kind == "generated",
            "engine": check.engine, "contract_definition": check.definition, "target": check.target, "logical_type": check.logical_type,
            "aggregation_type": c.aggregation, "tables_in_query": sorted(c.tables), "rendered_implementation": c.sql,
        }
        if len(c.tables) > 1:
            out["multi_source"] = True
        out["safe_casts_left_out"] = c.unsafe
        if isinstance(c.error, SQLSecurityError):
            out["security_violation"] = c.error.violation_type
        return {k: v for k, v in out.items() if v is not None}

    def _result(self, c: _Compiled) -> CheckResult:
        check, meta = c.check, self._metadata(c)
        if c.result is not None and not c.error:
            c.result.metadata = {**meta, **c.result.metadata}
            return c.result
        try:
            if c.error:
                raise c.error
            good = holds(check.operator, c.value, check.expected)
        except Exception as e:
            text = str(e) or type(e).__name__
            return CheckResult(check.name, "ERROR", text.splitlines()[0], c.value, check.expected, metadata=meta, execution_time_ms=c.ms)
        rowwise, count = c.rowwise(), 0
        if rowwise and isinstance(c.value, (int, float)) and not good:
            count = int(c.value)
        rows = getattr(c, "rows", None)
        fetch = None
        if not good and rows is not None:
            fetch = lambda: rows
        elif not good and c.rows_sql:
            fetch = lambda: self.failed_rows(c.rows_sql)
        said = check.description or f"{check.name}: {c.value} against {check.operator} {check.expected}"
        known = c.check.node if isinstance(c.check.node, ir.PREDICATES) or isinstance(c.check.node, ir.RowCount) else None
        return CheckResult(check.name, "PASSED" if good else "FAILED", said, c.value, check.expected, fetch, count, rowwise, meta, c.ms, (check.schema, c.where) if c.where is not None and (known or len(c.tables) == 1) else None)

    def failed_rows(self, sql: str) -> DataFrame:
        """Failing rows, lazily, with repeated column names told apart by .1, .2 and so on."""
        df = self.spark.sql(sql)
        seen: dict[str, int] = {}
        names = []
        for column in df.columns:
            k = seen[column] = seen.get(column, -1) + 1
            names.append(f"{column}.{k}" if k else column)
        if names != df.columns:
            df = df.toDF(*names)
        return df.limit(self.max_failed_rows) if self.max_failed_rows >= 0 else df
