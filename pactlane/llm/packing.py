"""Cost-balanced packing of documents into fixed-length token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices, table
from .tokens import encoder, vocabulary

#: Tokens gathered before a block is packed; bounds a task's memory. A longer document is its own block.
BLOCK_TOKENS = 2_000_000


def assign(lengths: np.ndarray, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document index, start, length, sequence, offset) of documents of these lengths.

    A document's full multiples of capacity fill sequences of their own. What remains is assigned in
    descending order of cost (linear * length + quadratic * length^2) to the least-cost sequence that
    still takes it whole; if none does, it is cut into the least-cost sequences with any room. As many
    sequences are opened as the tokens need, so a block pads less than one sequence in all.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for i in np.flatnonzero(lengths >= capacity):
        for k in range(int(lengths[i]) // capacity):
            pieces.append((int(i), k * capacity, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    order = np.flatnonzero(rest)[np.argsort(-rest[rest > 0], kind="stable")]
    bins = -(-int(rest.sum()) // capacity)
    room = np.full(bins, capacity, np.int64)
    cost = np.zeros(bins)
    for i in order.tolist():
        start, left = int(lengths[i] - rest[i]), int(rest[i])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            b = int(fits.argmin())
            if fits[b] == np.inf:
                b = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(left, int(room[b]))
            pieces.append((i, start, take, sequence + b, capacity - int(room[b])))
            room[b] -= take
            cost[b] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Each task encodes its rows, packs block after block and emits the pieces, so nothing is shuffled
    and memory is bounded by a block. Sequence ids carry the task's partition in the high bits.

    A null or empty text is its end id alone. Null ids and repeated rows are packed like any other.
    Other columns are left out. An empty table gives no pieces.
    """
    ship(docs.sparkSession)

    def packed(ids: list, tokens: list[np.ndarray], base: int) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        rows = assign(lengths, capacity)
        doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in doc], kind), pa.array(start), pa.array(length), pa.array(lengths[doc]), pa.array(seq + base), pa.array(offset), pa.array([tokens[i][s : s + n].astype("<u4").tobytes() for i, s, n in zip(doc, start, length)], pa.binary())],
            ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        ids, tokens, held = [], [], 0
        for b in slices(batches, "text", 8 << 20):
            flat, at = enc.encode(b.column("text"), end_id)
            ids += b.column("id").to_pylist()
            tokens += [flat[s:e] for s, e in zip(at[:-1], at[1:])]
            held += len(flat)
            if held >= block_tokens:
                out = packed(ids, tokens, base)
                base += 1 + pa.compute.max(out.column("sequence_id")).as_py() - base
                yield out
                ids, tokens, held = [], [], 0
        if ids:
            yield packed(ids, tokens, base)

    field = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(field)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {field.simpleString()}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    )
    return out.withColumnRenamed("id", id_col)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with their ids' crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0))
