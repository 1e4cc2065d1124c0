"""Language ID: blended-spectrum n-gram presence kernel, Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_mod, ship, slices, table

SPECTRUM = (1, 2, 3)

#: Labelled rows, bytes of a training text, and landmarks, at most.
MAX_ROWS, MAX_TRAIN_BYTES, LANDMARKS = 6_000, 16 << 10, 128

RIDGE, SHARPNESS, SEED = 1e-3, 4.0, 3

#: Cells of the presence matrix that a worker holds at once.
CELLS = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(A-Z lower-cased UTF-8 of all texts, offsets)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if texts.offset:
        texts = pa.array(texts.to_pylist(), pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    return _LOWER[np.frombuffer(raw, np.uint8)[: offsets[-1]]] if raw is not None and offsets[-1] else np.zeros(0, np.uint8), offsets


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Code of the n bytes from each position on that has so many left."""
    code = data[: max(len(data) - n + 1, 0)].astype(np.uint32)
    for j in range(1, n):
        code = (code << np.uint32(8)) | data[j : len(data) - n + 1 + j]
    return code


@dataclass
class Kernel:
    """Languages, column of each n-gram that a landmark has, presence of the columns in the landmarks, and the regression weights."""

    languages: list[str]
    columns: dict[int, np.ndarray]
    landmarks: np.ndarray
    weights: np.ndarray
    _tables: dict | None = None

    def tables(self) -> dict[int, np.ndarray]:
        if self._tables is None:
            self._tables, first = {}, 0
            for n, codes in self.columns.items():
                t = np.full(1 << (8 * n), -1, np.int16 if self.landmarks.shape[1] < 1 << 15 else np.int32)
                t[codes] = np.arange(first, first + len(codes))
                self._tables[n], first = t, first + len(codes)
        return self._tables

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """0/1 matrix: which of the columns' n-grams each text has."""
        width = self.landmarks.shape[1]
        flags = np.zeros((len(offsets) - 1) * width, np.uint8)
        lengths = np.diff(offsets)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int64) * width, lengths)
        left = np.repeat(offsets[1:], lengths) - np.arange(len(data))
        for n, t in self.tables().items():
            column = t[_grams(data, n)]
            ok = (column >= 0) & (left[: len(column)] >= n)
            flags[owner[: len(column)][ok] + column[ok]] = 1
        return flags.reshape(len(lengths), width)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Normalised counts of n-grams that each text shares with each landmark."""
        x = x.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))[None, :]
        return (x @ self.landmarks.T.astype(np.float32)) / norm

    def margins(self, texts: pa.Array) -> np.ndarray:
        return self.margins_of(*_bytes(texts))

    def margins_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row a text, one column a language; data are the lower-cased bytes of all texts."""
        step, n = max(1, CELLS // max(self.landmarks.shape[1], 1)), len(offsets) - 1
        out = [self.kernel(self.presence(data[offsets[i] : offsets[min(i + step, n)]], offsets[i : i + step + 1] - offsets[i])) @ self.weights for i in range(0, n, step)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; `und` and 0 where there is no letter or nothing was learned."""
        lettered = has_letter(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        m = self.margins(texts) * SHARPNESS
        e = np.exp(m - m.max(axis=1, keepdims=True))
        best = m.argmax(axis=1)
        score = (e / e.sum(axis=1, keepdims=True))[np.arange(len(m)), best]
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = _bytes(texts)
    total = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        t = texts[int(i)].as_py()
        out[i] = bool(t) and any(c.isalpha() for c in t)
    return out


def fit(texts: pa.Array, langs: list[str], landmarks: int = LANDMARKS, seed: int = SEED) -> Kernel:
    """Landmarks are drawn in turn from each language; ridge regression on the Nystroem features, a +-1 target a language.

    Rows of a language weigh in inverse proportion to its number, so rare languages count alike.
    """
    names = sorted(set(langs))
    if not names:
        return Kernel([], {n: np.zeros(0, np.int64) for n in SPECTRUM}, np.zeros((0, 0), np.uint8), np.zeros((0, 0)))
    y = np.array([names.index(x) for x in langs])
    order = np.random.default_rng(seed).permutation(len(y))
    turn = np.zeros(len(y), np.int64)
    for k in range(len(names)):
        own = order[y[order] == k]
        turn[own] = np.arange(len(own))
    chosen = np.sort(order[np.argsort(turn[order], kind="stable")][:landmarks])
    data, offsets = _bytes(texts.take(pa.array(chosen)))
    columns = {n: np.unique(np.concatenate([_grams(data[a:b], n) for a, b in zip(offsets[:-1], offsets[1:])])).astype(np.int64) for n in SPECTRUM}
    model = Kernel(names, columns, np.zeros((0, sum(map(len, columns.values()))), np.uint8), np.zeros((0, 0)))
    model.landmarks = model.presence(data, offsets)
    values, vectors = np.linalg.eigh(model.kernel(model.landmarks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    data, offsets = _bytes(texts)
    step = max(1, CELLS // max(model.landmarks.shape[1], 1))
    phi = np.concatenate([model.kernel(model.presence(data[offsets[i] : offsets[min(i + step, len(y))]], offsets[i : i + step + 1] - offsets[i])) @ root for i in range(0, len(y), step)])
    weight = (len(y) / len(names) / np.bincount(y))[y][:, None]
    target = np.where(np.arange(len(names))[None, :] == y[:, None], 1.0, -1.0)
    model._tables = None
    model.weights = root @ np.linalg.solve((phi * weight).T @ phi + RIDGE * len(y) * np.eye(phi.shape[1]), (phi * weight).T @ target)
    return model


def train(docs: DataFrame, parts: int | None = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Kernel:
    """Fit on rows outside the held-out fold that have a language and a text of 1 to MAX_TRAIN_BYTES bytes.

    Of each language those of least id hash are taken, languages in turn until there are max_rows, so a rare
    language is learned too. Each (id, language) gives one row, that of its least text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null")
    if parts:
        rows = rows.where(hash_mod("id", parts) != held_out)
    rows = rows.where(F.octet_length("text").between(1, MAX_TRAIN_BYTES))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))  # each task cuts its rows to max_rows a language first
    few = rows.select("id", "lang").withColumn("turn", turn).where(F.col("turn") <= max_rows).orderBy("turn", "lang").limit(max_rows).select("id", "lang").distinct()
    got = rows.join(F.broadcast(few), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("text", "lang").toArrow()
    got = got.sort_by([("lang", "ascending"), ("text", "ascending")])  # the fit doesn't depend on the order in which rows arrive
    return fit(got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()), got.column("lang").to_pylist())


def predict(docs: DataFrame, model: Kernel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; `und` with score 0 if it is null or has no letter.

    Null ids and repeated rows are kept; other columns are left out; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lang, score = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(np.asarray(score, np.float64))], ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; a null doc_id counts as held out, as it is never trained on."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(hash_mod("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
