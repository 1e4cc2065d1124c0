"""Quality classifier: a generalised additive model with pairwise interactions, boosted into look-up tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_mod, keep_rows, ship, slices, table
from .labelled import MAX_PER_CLASS, sample
from .textstats import FEATURES, features

BINS, ROUNDS, RATE, PAIRS, LAMBDA, MIN_ROWS = 32, 60, 0.2, 6, 5.0, 20


@dataclass
class Additive:
    """score(x) = sigmoid(base + sum of one table value a feature + sum of one table value a feature pair)."""

    edges: list[np.ndarray]
    base: float
    tables: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = self.base + self.tables[np.arange(b.shape[1])[None, :], b].sum(axis=1)
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best gain and cut (bins below it go left) of gradient, hessian and count histograms."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    g0, h0, n0 = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + LAMBDA) + (g0 - gl) ** 2 / (h0 - hl + LAMBDA) - g0**2 / (h0 + LAMBDA)
    gain[(nl < MIN_ROWS) | (n0 - nl < MIN_ROWS)] = 0
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf value of each bin of a shallow tree grown best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_cut(g[a:b], h[a:b], n[a:b]), k) for k, (a, b) in enumerate(parts)]
        gain, at, k = max(found)
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + LAMBDA)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts one axis, then each side on the other axis."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh, nn = (g.T, h.T, n.T) if turn else (g, h, n)
        cg, ch, cn = np.cumsum(gg, axis=0), np.cumsum(hh, axis=0), np.cumsum(nn, axis=0)
        for k in range(0, len(gg) - 1, 2):
            cells, gain = np.zeros_like(gg), -(g.sum() ** 2) / (h.sum() + LAMBDA)
            for rows, sg, sh, sn in ((slice(0, k + 1), cg[k], ch[k], cn[k]), (slice(k + 1, None), cg[-1] - cg[k], ch[-1] - ch[k], cn[-1] - cn[k])):
                if sn.sum() < MIN_ROWS:
                    gain = -1.0
                    break
                more, _ = _cut(sg, sh, sn)
                gain += sg.sum() ** 2 / (sh.sum() + LAMBDA) + more
                cells[rows] = _tree(sg, sh, sn, 2)[None, :]
            if gain > best:
                best, out = gain, cells.T if turn else cells
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Additive:
    """Boost one feature's table after another, round after round, then the tables of the best pairs.

    Bins are quantiles of the sample. Pairs are ranked by the gain of a first pair tree on what the
    single features leave. Without rows or with one label only, the score is constant.
    """
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(edges, float(np.log(share / (1 - share))), np.zeros((k, BINS)))
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    margin = np.full(len(y), model.base)
    counts = [np.bincount(b[:, j], minlength=BINS) for j in range(k)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            leaf = RATE * _tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS), counts[j])
            model.tables[j] += leaf
            margin += leaf[b[:, j]]

    def grid(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        return np.bincount(b[:, i] * BINS + b[:, j], v, BINS * BINS).reshape(BINS, BINS)

    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h), grid(i, j, None))[0], i, j) for i in range(k) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 1]
    model.pair_tables = [np.zeros((BINS, BINS)) for _ in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            leaf = RATE * _pair_tree(grid(i, j, g), grid(i, j, h), grid(i, j, None))[1]
            t += leaf
            margin += leaf[b[:, i], b[:, j]]
    return model


def _with_features(rows: DataFrame, keep: str) -> DataFrame:
    ship(rows.sparkSession)
    names = [c.split()[0] for c in keep.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(list(x), pa.list_(pa.float32()))], [*names, "x"])

    return rows.select(*names, "text").mapInArrow(run, f"{keep}, x array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int | None = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", per_class: int = MAX_PER_CLASS) -> Additive:
    """Fit on the features of at most per_class labelled rows of each class outside the held-out fold."""
    rows = _with_features(sample(docs, labels, label, parts, held_out, id_col, text_col, per_class), "y int").toPandas()
    x = np.stack(rows["x"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    y = rows["y"].to_numpy(np.float64)
    order = np.lexsort([*x.T, y])  # the fit doesn't depend on the order in which rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text, 0 to 1, higher: label 1 likelier.

    A null or empty text is scored on all-zero features. Null ids and repeated rows are kept; other
    columns are left out; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shared.value.score(features(b.column("text"))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def drop_poor(docs: DataFrame, model: Additive, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the rows that score below least, all columns kept. Null and empty texts are judged on all-zero features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: shared.value.score(features(texts)) >= least)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a null doc_id counts as held out, as it is never trained on."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(hash_mod("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
