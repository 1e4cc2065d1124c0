"""Tables to validate: Spark sessions, frames, files and JDBC connections behind one adapter."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Collection, Mapping, Sequence
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators import filters as row_filters
from .frames import as_pandas_or_arrow, to_spark

FILE_FORMATS = ("parquet", "csv", "json", "orc", "avro", "text")


def active_session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def path_reader(spark: SparkSession, uri: str, options: Mapping[str, Any] | None = None) -> Callable[[str], DataFrame]:
    """Reader of tables below a path URI: format:path, or a path whose ending names the format.

    A path that holds {table} gets the table's name in its place. CSV is read with a header and all
    columns as text unless options say otherwise.
    """
    scheme, _, rest = uri.partition(":")
    kind, path = (scheme, rest) if scheme in FILE_FORMATS else (next((f for f in FILE_FORMATS if uri.rstrip("/").endswith("." + f)), ""), uri)
    if not kind:
        raise ValueError(f"{uri!r} names no known file format; known are {', '.join(FILE_FORMATS)}")
    given = {"header": "true"} | dict(options or {}) if kind == "csv" else dict(options or {})
    return lambda table: spark.read.format(kind).options(**given).load(path.replace("{table}", table))


def jdbc_reader(spark: SparkSession, url: str, options: Mapping[str, Any] | None = None) -> Callable[[str], DataFrame]:
    """Reader of a database's tables. user:password@ in the address becomes options; partitionColumn and the like split the read."""
    given = dict(options or {})
    if not url.startswith("jdbc:"):
        parts = urlsplit(url)
        kind = {"postgres": "postgresql", "mssql": "sqlserver"}.get(parts.scheme, parts.scheme)
        given |= {k: v for k, v in (("user", parts.username), ("password", parts.password)) if v}
        host = parts.hostname + (f":{parts.port}" if parts.port else "") if parts.hostname else ""
        url = f"jdbc:{kind}://{host}{parts.path}" if kind != "sqlite" else f"jdbc:sqlite:{parts.path}"
    return lambda table: spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**given).load()


class BaseAdapter:
    """Executors by engine name, and the settings a run hands down. A subclass offers table()."""

    max_failed_rows: int = -1
    use_try_cast: bool = True

    def __init__(self, executors: Mapping[str, Any] | None = None) -> None:
        self._executors = dict(executors or {})

    def get_executors(self) -> dict[str, Any]:
        return dict(self._executors)

    def set_executors(self, executors: Mapping[str, Any]) -> None:
        self._executors = dict(executors)

    def executor(self, engine: str) -> Any:
        if engine not in self._executors:
            raise NotImplementedError(f"no executor for engine {engine!r}; registered are {', '.join(sorted(self._executors)) or 'none'}")
        return self._executors[engine]

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError("this adapter has no tables")

    def test_connection(self, table_name):  # noqa: ANN001, ANN201
        return None


class SparkAdapter(BaseAdapter):
    """Tables of one source: a session's catalog, frames by name, or a reader.

    filter_conditions restrict the rows of every table whose name a key equals or matches as a
    pattern; conditions of several matching keys all hold.
    """

    def __init__(self, spark: SparkSession | None = None, frames: Mapping[str, DataFrame] | None = None, reader: Callable[[str], DataFrame] | None = None, filter_conditions: Mapping[str, Any] | None = None, executors: Mapping[str, Any] | None = None) -> None:
        super().__init__(executors)
        self.frames = dict(frames or {})
        self.spark = next((f.sparkSession for f in self.frames.values()), None) or active_session(spark)
        self.reader = reader
        self._filters = dict(filter_conditions or {})

    @property
    def filter_conditions(self) -> dict[str, Any]:
        return dict(self._filters)

    @property
    def has_filter_conditions(self) -> bool:
        return bool(self._filters)

    def get_sql_dialect(self) -> str:
        return "spark"

    def get_connection(self) -> SparkSession:
        return self.spark

    def is_compatible_with(self, other: object) -> bool:
        """Whether both read through one session; all Spark adapters of a run do."""
        return isinstance(other, SparkAdapter) and other.spark.sparkContext is self.spark.sparkContext

    def unfiltered(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        return self.reader(name) if self.reader else self.spark.table(name)

    def table(self, name: str) -> DataFrame:
        """The table's rows that all its filters let through."""
        return row_filters.apply(self.unfiltered(name), row_filters.for_table(self._filters, name), self.use_try_cast)

    def get_total_rows(self, schema_name: str, max_rows=-1) -> int:
        """Rows after filters, at most max_rows if that isn't negative; 0 if the table can't be read."""
        try:
            df = self.table(schema_name)
            return (df.limit(max_rows) if max_rows >= 0 else df).count()
        except Exception:
            return 0

    def test_connection(self, table_name):  # noqa: ANN001, ANN201
        """None if the table can be read, else why not."""
        try:
            self.unfiltered(table_name).limit(1).isEmpty()
            return None
        except Exception as e:
            return str(e).splitlines()[0] if str(e) else type(e).__name__

    def export_table_as_arrow(self, schema_name) -> pa.Table:
        """The filtered table in the driver's memory; for small tables only."""
        return self.table(schema_name).toArrow()


class MultiSourceAdapter(BaseAdapter):
    """An adapter for each schema; checks over several of them are ordinary Spark joins."""

    def __init__(self, adapters: Mapping[str, BaseAdapter], executors: Mapping[str, Any] | None = None) -> None:
        super().__init__(executors)
        if not adapters:
            raise ValueError("at least one adapter is needed")
        self._adapters = dict(adapters)

    @property
    def adapters(self) -> dict:
        return {**self._adapters}

    @property
    def schema_names(self) -> list[str]:
        return list(self._adapters)

    def get_adapter(self, schema_name) -> BaseAdapter | None:
        return self._adapters.get(schema_name)

    def table(self, name: str) -> DataFrame:
        if name not in self._adapters:
            raise ValueError(f"no adapter for table {name!r}")
        return self._adapters[name].table(name)

    def get_total_rows_by_schema(self, max_rows=-1) -> dict[str, int]:
        return {n: a.get_total_rows(n, max_rows) if hasattr(a, "get_total_rows") else 0 for n, a in self._adapters.items()}

    def test_connections(self, tables_by_schema: Mapping[str, Sequence[str]], seen: Collection[str] = ()) -> dict:
        """For each schema its own table and every other that its checks name: success, skipped, or an error text.

        Tables in seen were read already and are not probed again.
        """
        out: dict = {}
        for name, adapter in self._adapters.items():
            problem = None if name in seen else adapter.test_connection(name)
            found = out[name] = {name: problem or "success"}
            if problem:
                warnings.warn(f"table {name} can't be read: {problem}", stacklevel=2)
            for other in tables_by_schema.get(name, ()):
                if other == name:
                    continue
                if other in self._adapters:
                    found[other] = f"skipped: {other} is a schema of its own"
                    continue
                problem = adapter.test_connection(other)
                found[other] = f"error: {problem}" if problem else "success"
                warnings.warn(f"checks of {name} use {other}, which the contract doesn't declare" + (f" and which can't be read: {problem}" if problem else ""), stacklevel=2)
        return out


def get_adapter(source: Any, table_name: str = "source_data", filter_conditions: Mapping[str, Any] | None = None, spark: SparkSession | None = None) -> BaseAdapter:
    """An adapter of whatever source is: an adapter, a Spark frame or session, a connection or path URI, a local frame."""
    if isinstance(source, (SparkAdapter, MultiSourceAdapter)):
        return source
    if isinstance(source, BaseAdapter):
        raise TypeError(f"adapters of type {type(source).__name__} can't be used as a source here")
    if isinstance(source, DataFrame):
        return SparkAdapter(frames={table_name: source}, filter_conditions=filter_conditions)
    if isinstance(source, SparkSession):
        return SparkAdapter(source, filter_conditions=filter_conditions)
    if isinstance(source, str):
        session = active_session(spark)
        is_path = source.split(":", 1)[0] in FILE_FORMATS or any(source.rstrip("/").endswith("." + f) for f in FILE_FORMATS)
        reader = path_reader(session, source) if is_path else jdbc_reader(session, source)
        return SparkAdapter(session, reader=reader, filter_conditions=filter_conditions)
    local = as_pandas_or_arrow(source)
    if local is None:
        raise TypeError(f"{type(source).__name__} is no source; supported are adapters, Spark frames and sessions, connection and path URIs, and frames that turn into pandas or Arrow")
    return SparkAdapter(frames={table_name: to_spark(active_session(spark), local)}, filter_conditions=filter_conditions)


def create_adapter(source: Any, table_name: str = "source_data", filter_conditions: Mapping[str, Any] | None = None) -> BaseAdapter:
    return get_adapter(source, table_name, filter_conditions)


class DataSourceMapper:
    """get_adapter as an object."""

    def get_adapter(self, data_source: Any, table_name="source_data", filter_conditions: Mapping | None = None) -> BaseAdapter:
        return get_adapter(data_source, table_name, filter_conditions)
