"""Token-id output as Parquet list columns: ordered files with controlled encodings, row groups and page indexes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import shared_dir, ship, slices, table
from .tokens import encoder, vocabulary

#: Tokens and documents of a row group at most (one document at least), and bytes of a data page.
GROUP_TOKENS, GROUP_DOCS, PAGE_BYTES = 1 << 20, 8192, 64 << 10


@dataclass(frozen=True)
class TokenFiles:
    """Files written by write_tokens: folder, and for each file in order its name, documents, tokens and tokens before it."""

    folder: str
    files: list[tuple[str, int, int, int]]
    id_type: str


def _file_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", kind), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])


def _writer(where: pa.NativeFile, kind: pa.DataType) -> pq.ParquetWriter:
    """Dictionary for ids, delta for the increasing columns, column and offset indexes for every page."""
    delta = {"start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}
    if pa.types.is_integer(kind):
        delta["doc_id"] = "DELTA_BINARY_PACKED"
    return pq.ParquetWriter(
        where, _file_schema(kind), compression="zstd", use_dictionary=["ids.list.element"], column_encoding=delta, dictionary_pagesize_limit=4 << 20,
        data_page_size=PAGE_BYTES, write_batch_size=256, write_page_index=True, write_statistics=True, version="2.6",
    )


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every whole text, append end_id, and write the ids in ascending id order, one file a task.

    Rows are range-partitioned by id (then the text's start) and sorted within partitions, so file order is id order. Files
    carry a mark of the task's attempt, are renamed when complete, and only those of the attempts that
    counted are listed in the result. Only a line a file (names and counts) comes to the driver, for
    the offsets.

    A null text is empty (its end id alone). Null ids come first; equal ids are ordered by text.
    An empty table writes no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(tokenizer_path), TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        mark = uuid.uuid4().hex[:12]
        name, tmp = f"tokens-{at.partitionId():06d}-{mark}.parquet", f"{base}/_tmp-{at.partitionId():06d}-{mark}"
        ids, tokens, held, n_docs, start = [], [], 0, 0, 0
        with store.open_output_stream(tmp) as out, _writer(out, kind) as writer:

            def flush() -> None:
                nonlocal ids, tokens, held, start, n_docs
                n = np.fromiter(map(len, tokens), np.int64, len(tokens))
                ends = np.cumsum(n)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(tokens).astype(np.int32)), type=_file_schema(kind).field("ids").type)
                group = pa.Table.from_arrays([pa.array(ids, kind), pa.array(start + ends - n), pa.array(n), values], schema=_file_schema(kind))
                writer.write_table(group, row_group_size=len(ids))
                start, n_docs = start + int(ends[-1]), n_docs + len(ids)
                ids, tokens, held = [], [], 0

            for b in slices(batches, "text", 8 << 20):
                flat, cut = enc.encode(b.column("text"), end_id)
                for i, s, e in zip(b.column("id").to_pylist(), cut[:-1].tolist(), cut[1:].tolist()):
                    if ids and (held + e - s > GROUP_TOKENS or len(ids) >= GROUP_DOCS):
                        flush()
                    ids.append(i)
                    tokens.append(flat[s:e])
                    held += e - s
            if ids:
                flush()
        store.move(tmp, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n_docs]), pa.array([start])], ["name", "docs", "tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The start of the text and the row's place spread the rows of one id (or of none) over tasks; the order stays that of id and text.
    placed = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("id", "head", "place").select("id", "text").sortWithinPartitions("id", "text")
    files, before = [], 0
    for name, n_docs, n in sorted(tuple(r) for r in ordered.mapInArrow(run, "name string, docs bigint, tokens bigint").collect()):
        files.append((name, n_docs, n, before))
        before += n
    return TokenFiles(folder, files, id_type.simpleString())


def read_tokens(spark: SparkSession, written: TokenFiles, where: Column | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start (over all files), n_tokens and, where wanted, ids of the rows that meet the condition.

    The condition on doc_id reaches the scan, which prunes row groups and pages by their statistics
    and page index; without ids the token column is never read.
    """
    schema = f"doc_id {written.id_type}, start bigint, n_tokens bigint" + ", ids array<int>" * ids
    rows = spark.read.schema(schema).parquet(*[f"{written.folder}/{f[0]}" for f in written.files]) if written.files else spark.createDataFrame([], schema)
    if where is not None:
        rows = rows.where(where)
    before = spark.createDataFrame([(f[0], f[3]) for f in written.files], "file string, before bigint")
    named = rows.withColumn("file", F.col("_metadata.file_name")) if written.files else rows.withColumn("file", F.lit(""))
    return named.join(F.broadcast(before), "file").withColumn("start", F.col("start") + F.col("before")).drop("file", "before")


def digests(rows: DataFrame) -> DataFrame:
    """rows of read_tokens with the crc32 of the ids (little-endian unsigned 32-bit) in place of the ids."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            crc = pa.array([zlib.crc32(flat[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), vocabulary("word_bpe_49k.json"), 1)
    return digests(read_tokens(spark, written))
