"""Quality rules: fixed limits on word statistics, then an isolation forest on the same statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, ship, slices, table, written
from .textstats import rule_stats, words

TREES, SAMPLE, SEED = 100, 256, 7

#: Share of good labelled rows that the calibrated threshold may reject at most.
MAX_GOOD_REJECTED = 0.003

#: Bad rows that the forest is grown on, as a share of the good ones.
BAD_SHARE = 0.03

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def signals(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees of the statistics: log length, word length, and shares of symbols, repeated lines and repeated words."""
    n = np.maximum(s["n_words"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / np.maximum(s["word_chars"], 1), s["n_dup_lines"] / n, s["n_repeat_words"] / n], axis=1)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Random trees as arrays; children of node k are 2k + 1 and 2k + 2, leaves carry depth plus expected rest."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2^(-mean path length / expected path length) of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, length in zip(self.feature, self.cut, self.length):
            at = np.zeros(len(x), np.int64)
            live = f[at] >= 0
            while live.any():
                r, a = rows[live], at[live]
                at[live] = 2 * a + 1 + (x[r, f[a]] >= c[a])
                live = f[at] >= 0
            total += length[at]
        return 2 ** (-total / max(len(self.feature), 1) / self.norm) if self.norm else np.zeros(len(x))


def weights(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How often a signal is drawn for a split: the square of how far its ranks tell labelled good from bad rows.

    Signals that tell nothing (a twentieth or less) are not drawn; without both labels all are drawn alike.
    """
    if not good.any() or good.all():
        return np.ones(x.shape[1])
    area = []
    for column in x.T:
        values, at, n = np.unique(column, return_inverse=True, return_counts=True)
        rank = (np.cumsum(n) - (n - 1) / 2)[at]
        area.append((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()))
    return _drawn(np.array(area))


def _drawn(area: np.ndarray) -> np.ndarray:
    """Weights from the share of (good, bad) pairs in which the good row has the greater value, ties by half."""
    apart = np.abs(2 * area - 1)
    return np.where(apart > 0.05, apart**2, 0) if (apart > 0.05).any() else np.ones(len(area))


def grow(x: np.ndarray, draw: np.ndarray | None = None, trees: int = TREES, size: int = SAMPLE, seed: int = SEED) -> Forest:
    """Isolation trees over random subsamples, split signals drawn by weight; no rows: a forest that finds nothing anomalous."""
    draw = np.ones(x.shape[1]) if draw is None else draw
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    depth = int(np.ceil(np.log2(max(size, 2))))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees if size > 1 else 0):
        stack = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while stack:
            k, d, part = stack.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero((high > low) & (draw > 0))
            if d == depth or len(part) < 2 or not len(open_):
                length[t, k] = d + _expected(len(part))
                continue
            j = int(rng.choice(open_, p=draw[open_] / draw[open_].sum()))
            feature[t, k], cut[t, k] = j, rng.uniform(low[j], high[j])
            right = part[:, j] >= cut[t, k]
            stack += [(2 * k + 1, d + 1, part[~right]), (2 * k + 2, d + 1, part[right])] if right.any() and not right.all() else []
            if not right.any() or right.all():
                feature[t, k], length[t, k] = -1, d + _expected(len(part))
    return Forest(feature, cut, length, _expected(size))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, most: float = MAX_GOOD_REJECTED) -> Forest:
    """Set the score above which a row is rejected: the most bad rows caught while at most that share of good rows is."""
    forest.threshold = 1.0
    if len(x) and good.any() and not good.all():
        s = forest.score(x)
        candidates = np.unique(s[~good])
        lost = np.array([(s[good] > c).mean() for c in np.concatenate([[0], candidates])])
        edges = np.concatenate([[0], candidates])[lost <= most]
        if len(edges):
            upper = s[~good][s[~good] > edges.min()]
            below = s[good][s[good] <= (upper.min() if len(upper) else 1)]
            # Half way between the last good score kept and the first bad score caught.
            forest.threshold = float((max(edges.min(), below.max() if len(below) else 0) + (upper.min() if len(upper) else 1)) / 2)
    return forest


def _stats(rows: DataFrame, keep: str) -> DataFrame:
    ship(rows.sparkSession)
    names = [c.split()[0] for c in keep.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = rule_stats(words(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(s[c]) for c in STATS)], [*names, *STATS])

    return rows.select(*names, "text").mapInArrow(run, f"{keep}, " + ", ".join(f"{c} bigint" for c in STATS))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text."""
    return _stats(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), f"id {docs.schema[id_col].dataType.simpleString()}")


def areas(rows: DataFrame) -> np.ndarray:
    """Of each signal of rows (y, x0, x1, ...): the share of (good, bad) pairs in which the good row has the greater value, ties by half.

    Values are counted, sorted by range and counted through a part at a time; the driver gets a row a part.
    """
    names = [c for c in rows.columns if c.startswith("x")]
    pairs = F.array(*(F.struct(F.lit(k).alias("j"), F.col(c).alias("v")) for k, c in enumerate(names)))
    counts = rows.select("y", F.explode(pairs).alias("p")).groupBy("p.j", "p.v").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[float, float, float, float]] = {}
        for b in batches:
            j, v, good, bad = (b.column(c).to_numpy().astype(np.float64) for c in ("j", "v", "good", "bad"))
            for k in np.unique(j).astype(int).tolist():
                at = j == k
                first, n1, n0, won = held.get(k, (float(v[at][0]), 0.0, 0.0, 0.0))
                below = n0 + np.cumsum(bad[at]) - bad[at]
                held[k] = first, n1 + good[at].sum(), n0 + bad[at].sum(), won + (good[at] * (below + bad[at] / 2)).sum()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *(pa.array([h[i] for h in held.values()], pa.float64()) for i in range(4))], ["j", "first", "good", "bad", "won"])

    parts = counts.repartitionByRange("j", "v").sortWithinPartitions("j", "v").mapInArrow(run, "j int, first double, good double, bad double, won double").collect()
    out = np.zeros(len(names))
    for k in range(len(names)):
        good = bad = won = 0.0
        for p in sorted((p for p in parts if p.j == k), key=lambda p: p.first):
            won += p.won + p.good * bad
            good, bad = good + p.good, bad + p.bad
        out[k] = won / (good * bad) if good * bad else 0.5
    return out


def _largest(keys: DataFrame, k: int) -> int:
    """The key (not negative) that k keys of the table precede in descending order, found 14 bits at a time."""
    prefix = None
    for shift in (42, 28, 14, 0):
        within = keys if prefix is None else keys.where(F.shiftright("key", shift + 14) == prefix)
        for b, n in sorted(((r.b, r["count"]) for r in within.groupBy(F.shiftright("key", shift).alias("b")).count().collect()), reverse=True):
            if k < n:
                prefix = b
                break
            k -= n
    return prefix


def threshold(scored: DataFrame, n_good: int, most: float = MAX_GOOD_REJECTED) -> float:
    """What calibrate() sets, from a table (y, score, key) of any size; key: the bits of the score as an integer, in its order."""
    lost = int(most * n_good)
    lost += (lost + 1) / n_good <= most
    lost -= lost / n_good > most
    least = float(np.array([_largest(scored.where("y = 1"), lost)], np.int64).view(np.float64)[0])
    good, bad = scored.where("y = 1"), scored.where("y = 0")
    edge = 0.0 if least <= 0 else bad.where(F.col("score") >= least).agg(F.min("score")).first()[0]
    if edge is None:
        return 1.0
    upper = bad.where(F.col("score") > edge).agg(F.coalesce(F.min("score"), F.lit(1.0))).first()[0]
    below = good.where(F.col("score") <= upper).agg(F.coalesce(F.max("score"), F.lit(0.0))).first()[0]
    return float((max(edge, below) + upper) / 2)


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> Forest:
    """The forest of all labelled rows of statistics() that pass the base limits.

    How often a signal is drawn and the threshold are counted over every such row. A tree isolates SAMPLE rows, as the
    method has it; as many rows as all trees take together, those of least id hash, are drawn for them, and bad rows only
    as BAD_SHARE of the good ones, so that they stay few and isolated.

    A null label or id is left out; an id that is labelled twice counts by its least label, one with several rows by the least statistics.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("y"))
    one = stats.where("id is not null").groupBy("id").agg(F.min(F.struct(*STATS)).alias("s")).join(known, "id").select(F.xxhash64(F.lit(SEED), "id").alias("h"), "y", "s.*")
    names = [f"x{k}" for k in range(len(STATS))]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = {c: b.column(c).to_numpy() for c in STATS}
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), *map(pa.array, signals(s).T.astype(np.float64))], ["h", "y", *names]).filter(pa.array(~base_failed(s)))

    rows = written(one.mapInArrow(passed, "h bigint, y int, " + ", ".join(f"{c} double" for c in names)), "rule-rows")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}

    def drawn(y: int, most: int) -> np.ndarray:
        own, share = rows.where(F.col("y") == y), (2 * most + 100) / max(n.get(y, 0), 1)
        if share < 1:  # else every task would send the driver so many rows
            own = own.where(F.col("h") < int(share * (1 << 64)) - (1 << 63))
        x = own.orderBy("h", *names).limit(most).select(*names).toPandas().to_numpy(np.float64)
        return x[np.lexsort(x.T[::-1])]

    both = bool(n.get(0) and n.get(1))
    good = drawn(1, TREES * SAMPLE)
    forest = grow(np.concatenate([good, drawn(0, int(np.ceil(BAD_SHARE * len(good))))]), _drawn(areas(rows)) if both else None)
    if both:
        shared = rows.sparkSession.sparkContext.broadcast(forest)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = shared.value.score(np.stack([b.column(c).to_numpy() for c in names], axis=1))
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(s), pa.array(s.view(np.int64))], ["y", "score", "key"])

        scored = written(rows.mapInArrow(score, "y int, score double, key bigint"), "rule-scores")
        forest.threshold = threshold(scored, n[1])
        dropped(scored)
    dropped(rows)
    return forest


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """learn() from the statistics of docs."""
    return learn(statistics(docs, id_col, text_col), labels, label, id_col)


def judge(stats: DataFrame, forest: Forest) -> DataFrame:
    """The rows of statistics() with base_failed, kept and anomaly."""
    ship(stats.sparkSession)
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = {c: b.column(c).to_numpy() for c in STATS}
            failed, score = base_failed(s), shared.value.score(signals(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(~failed & (score <= shared.value.threshold)), pa.array(score)], [*b.schema.names, "base_failed", "kept", "anomaly"])

    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in STATS) + ", base_failed boolean, kept boolean, anomaly double")


def apply(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly) of every whole text.

    A null or empty text has no words and fails. Null ids and repeated rows are kept; other columns
    are left out; an empty table gives no rows.
    """
    return judge(statistics(docs, id_col, text_col), forest).withColumnRenamed("id", id_col)


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents are written once; the forest learns from those of labelled rows and judges all."""
    stats = written(statistics(table(spark, sf_dir, "documents")), "rule-stats")
    return judge(stats, learn(stats, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
