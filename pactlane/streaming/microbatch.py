"""Validation of a stream: each micro-batch is checked as a table of its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import ValidationConfig
from ..contracts import Contract
from ..result import ValidationResult


def validate_stream(stream: DataFrame, contract: Contract | str, schema: str | None = None, on_result: Callable[[ValidationResult, int], Any] | None = None, checkpoint: str | None = None, good: str | None = None, config: ValidationConfig | None = None, **trigger: Any) -> StreamingQuery:
    """Start a query that validates every micro-batch of stream as the table schema (the contract's first by default).

    on_result gets each result and the batch's number. good: a folder to which batches without a
    failed check are appended as Parquet. Checks see one batch at a time: uniqueness holds within it.
    """
    from ..api import validate_data

    loaded = contract if isinstance(contract, Contract) else Contract.load(contract)
    name = schema or loaded.get_schema_names()[0]
    only = Contract({**loaded.contract_data, "schema": [s for _, s in loaded.schemas() if s["name"] == name]})

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read by the checks, and again where it is kept
        try:
            result = validate_data(only, df=batch, config=config)
            if on_result:
                on_result(result, number)
            if good and result.passed and not result.has_errors:
                batch.write.mode("append").parquet(good)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
