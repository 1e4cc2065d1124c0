"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_mod

#: Labelled rows of each class that a model is fitted on at most.
MAX_PER_CLASS = 8_000


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int | None, held_out: int, id_col: str = "doc_id", text_col: str = "text", per_class: int = MAX_PER_CLASS, max_bytes: int | None = None, lang_col: str | None = None) -> DataFrame:
    """(id, text, y): at most per_class rows of label 0 and of label 1, those of least hash of the id; with lang_col also their lang.

    With parts, rows whose crc32(id as text) mod parts is held_out are never taken. The label rows are
    bounded by this count before they are joined, so their broadcast is too, and each id gives one row, so the
    result is. A null label or id is left out; an id that is labelled twice counts by its least label,
    one that has several texts by the least (of max_bytes bytes at most, if that is set; a null text is empty).
    lang is null where docs has no such column.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("y"))
    if parts:
        known = known.where(hash_mod("id", parts) != held_out)
    few = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(few[0].unionByName(few[1])), "id")
    if max_bytes is not None:
        rows = rows.where(F.octet_length("text") <= max_bytes)
    one = rows.groupBy("id").agg(F.min(F.struct("text", "lang")).alias("t"), F.min("y").alias("y"))
    return one.select("id", "t.text", "y", *(["t.lang"] if lang_col else []))
