"""Plumbing shared by the training-data operators: shared folder, written tables, batch slicing, skew-safe look-ups."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])

#: A table of at most this many (id, small value) rows may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000

#: A key is hot when it holds more than one row in this many; so there are at most this many hot keys.
HOT_PARTS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that crosses to a Python worker, where the session doesn't say otherwise.
BATCH_ROWS = 2_000


#: Settings by which a Python worker gives freed blocks back to the system instead of keeping them for later tasks.
RETURN_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and keep the batches they get small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    for k, v in RETURN_MEMORY.items():
        env.setdefault(k, v)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder all executors share (spark.checkpoint.dir); set only where unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pactlane-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pactlane_path = path
    _LEFT.append(path)
    return out


#: Tables of written() that may still be read; those on a shared file system go when the driver ends.
_LEFT: list[str] = []


@atexit.register
def _clean() -> None:
    for path in _LEFT:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_pactlane_path", None)
    if path is None:
        return
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about max_bytes of the text column (one row at least)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, n = 0, batch.num_rows
        while start < n:
            floor = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, floor + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of small rows joined to about that many rows each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows of equal keys, some at a time: the rows and the number of each row's group.

    Batches come sorted by the keys; no more than a group and a batch is held.
    """
    held: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        if b is not None:
            held.append(b)
            new = _edges(b, keys)
            tail = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if not tail and len(held) > 1 and _same(held[-2], b, keys):
                continue
            whole, rest = [*held[:-1], b.slice(0, tail)], [b.slice(tail)]
        else:
            whole, rest = held, []
        whole = [x for x in whole if x.num_rows]
        if whole:
            t = pa.Table.from_batches(whole).combine_chunks()
            yield t, np.cumsum(_edges(t, keys))
        held = rest


def _edges(t: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Which rows differ in their keys from the row before."""
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return new


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def hash_mod(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts (the fold rule of the labelled splits)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def lookup(big: DataFrame, small: DataFrame, key: str, hot: str, how: str = "inner") -> DataFrame:
    """Join big with one row a key of small; the few keys that small flags as hot are broadcast.

    The caller bounds the hot rows (a key with over 1/HOT_PARTS of all rows: at most HOT_PARTS of
    them), so no single key's rows meet in one task and the broadcast cannot grow with the data.
    """
    hot_side = small.where(F.col(hot)).drop(hot)
    cold_side = small.where(~F.col(hot)).drop(hot)
    a = big.join(F.broadcast(hot_side), key, "inner")
    b = big.join(F.broadcast(hot_side.select(key)), key, "left_anti").join(cold_side, key, how)
    return a.unionByName(b.select(*a.columns))


def semi_by_id(big: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of big whose key is in ids; ids are broadcast only when counted as few."""
    return big.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, key, "left_semi")


def keep_rows(docs: DataFrame, text_col: str, verdict: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of docs, with all their columns, for whose texts verdict gives True; nothing is shuffled."""
    ship(docs.sparkSession)
    plain = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(docs.schema)])  # any name may hold dots or come twice
    text = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1 << 20):
            yield b.filter(pa.array(np.asarray(verdict(b.column(text)), bool)))

    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)


def without_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is not among ids (nulls stay); ids are broadcast only when counted as few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_anti")
