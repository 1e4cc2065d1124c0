"""Local frames into Spark: pandas, Arrow and whatever offers a way to one of them."""

from __future__ import annotations

import warnings
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WRONG_TYPE = (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, TypeError, ValueError)


def as_pandas_or_arrow(frame: Any) -> pd.DataFrame | pa.Table | None:
    """The frame as pandas or Arrow, None if it offers neither."""
    if isinstance(frame, (pd.DataFrame, pa.Table)):
        return frame
    if isinstance(frame, pa.RecordBatch):
        return pa.Table.from_batches([frame])
    for way in ("to_arrow", "to_pandas"):
        if callable(getattr(frame, way, None)):
            return getattr(frame, way)()
    if hasattr(frame, "__arrow_c_stream__"):
        return pa.table(frame)
    return None


def _text(column: pd.Series) -> pd.Series:
    return column.map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v))


def arrow_by_column(frame: pd.DataFrame) -> pa.Table:
    """Arrow table of a pandas frame; only columns whose values don't agree become text (with a warning), nulls stay."""
    columns, texts = {}, []
    for k, name in enumerate(frame.columns):
        column = frame.iloc[:, k]
        try:
            columns[str(name)] = pa.Array.from_pandas(column)
        except _WRONG_TYPE:
            texts.append(str(name))
            columns[str(name)] = pa.Array.from_pandas(_text(column), type=pa.string())
    if texts:
        warnings.warn(f"columns of mixed types are read as text: {', '.join(texts)}", stacklevel=3)
    return pa.table(columns)


def _spark_types(table) -> pa.Table:  # noqa: ANN001
    """Columns of types Spark has none for as their nearest: null and dictionary as text, nanoseconds as microseconds, unsigned as wider."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    fields = []
    for f in table.schema:
        kind = f.type
        if pa.types.is_dictionary(kind):
            kind = kind.value_type
        if pa.types.is_null(kind):
            kind = pa.string()
        if pa.types.is_timestamp(kind):
            kind = pa.timestamp("us", kind.tz)
        fields.append(pa.field(f.name, wider.get(kind, kind)))
    return table.cast(pa.schema(fields), safe=False)


def to_spark(spark: SparkSession, frame: pd.DataFrame | pa.Table) -> DataFrame:
    table = arrow_by_column(frame) if isinstance(frame, pd.DataFrame) else frame
    return spark.createDataFrame(_spark_types(table))
