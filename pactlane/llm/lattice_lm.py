"""LM scoring: marginal probability of a document over all segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, hash_mod, ship, slices, table, written
from .textstats import words
from .tokens import vocabulary

#: Words whose counts and scores are broadcast at most; the others are joined by shuffle.
HOT_WORDS = 200_000

#: Hot words and rounds by which the vocabulary's scores are first fitted on the driver.
WARM_WORDS, WARM_ROUNDS = 40_000, 3

#: Pseudo-count in all of the vocabulary's own scores; slice of text a worker handles at once.
PRIOR_COUNT, SLICE = 1_000.0, 8 << 20

#: Words whose lattices a worker builds at once.
WORDS_AT_ONCE = 30_000

SPACE, LONGEST, _P = "▁", 16, np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


class Vocabulary:
    """Pieces of a vocabulary file with its scores turned into a rank-frequency prior; the last entry is the end of text.

    The file ranks its pieces by score, so the prior of rank r is 1 / (r + 2.7), scaled; the byte
    pieces, which spell characters that are no piece, share one per cent.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.end = n + 1, n
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and 1 <= len(sp.id_to_piece(i)) <= LONGEST]
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.prior = np.zeros(self.size)
        self.prior[order] = 0.98 / (np.arange(len(order)) + 2.7) / (1 / (np.arange(len(order)) + 2.7)).sum()
        self.prior[self.bytes] = 0.01 / 256
        self.prior[self.end] = 0.01
        keys = np.zeros(len(plain), np.uint64)
        for k, i in enumerate(plain):
            h = 0
            for c in sp.id_to_piece(i):
                h = ((h + ord(c) + 1) * int(_P)) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        self.keys, self.ids = keys, np.array(plain)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")
        # Two direct tables: pieces whose slot is taken in the first go to the second, and so on to a short list.
        self.slots, rest = [], np.arange(len(keys))
        while len(rest):
            t = np.full(1 << _SLOTS, -1, np.int32)
            slot = self._slot(keys[rest], len(self.slots))
            first = np.unique(slot, return_index=True)[1]
            t[slot[first]] = rest[first]
            self.slots.append(t)
            rest = np.delete(rest, first)

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93 + 2 * table)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each key, -1 where there is none."""
        out = np.full(h.shape, -1, np.int32)
        for k, t in enumerate(self.slots):
            at = t[self._slot(h, k)]
            ok = (at >= 0) & (self.keys[at] == h)
            out[ok] = self.ids[at[ok]]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All segmentations of words of one length: which piece spans which characters."""

    def __init__(self, vocab: Vocabulary, group: list[str]) -> None:
        t = len(group[0]) + 1
        codes = np.full((len(group), t), ord(SPACE), np.uint64)
        codes[:, 1:] = np.array(group, f"<U{t - 1}").view(np.uint32).reshape(len(group), t - 1)
        self.vocab, self.length, self.arcs = vocab, t, []
        h = np.zeros((len(group), t), np.uint64)
        for k in range(1, min(LONGEST, t) + 1):
            h = (h[:, : t - k + 1] + codes[:, k - 1 :] + np.uint64(1)) * _P
            self.arcs.append(vocab.find(h))
        self.missing = self.arcs[0] < 0
        self.letters, where = np.unique(codes[self.missing], return_inverse=True)
        self.where = where.ravel()
        self.spelled = [self.vocab.bytes[list(chr(int(c)).encode("utf-8", "surrogatepass"))] for c in self.letters]

    def _weights(self, logp: np.ndarray) -> list[np.ndarray]:
        full = np.append(logp, -np.inf)
        out = [full[a] for a in self.arcs]
        if len(self.letters):
            out[0][self.missing] = np.array([logp[s].sum() for s in self.spelled])[self.where]
        return out

    def forward(self, logp: np.ndarray, weights: list[np.ndarray] | None = None) -> np.ndarray:
        """Log sum over the segmentations of each prefix; the last column is the words'."""
        w = weights or self._weights(logp)
        a = np.zeros((len(self.missing), self.length + 1))
        for t in range(1, self.length + 1):
            steps = np.stack([a[:, t - k] + w[k - 1][:, t - k] for k in range(1, min(LONGEST, t) + 1)], axis=1)
            top = steps.max(axis=1)
            a[:, t] = top + np.log(np.exp(steps - top[:, None]).sum(axis=1))
        return a

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, each word counted as often as it occurs."""
        w = self._weights(logp)
        a = self.forward(logp, w)
        n, t = self.length, self.length
        b = np.zeros((len(a), n + 1))
        for t in range(n - 1, -1, -1):
            steps = np.stack([b[:, t + k] + w[k - 1][:, t] for k in range(1, min(LONGEST, n - t) + 1)], axis=1)
            top = steps.max(axis=1)
            b[:, t] = top + np.log(np.exp(steps - top[:, None]).sum(axis=1))
        out = np.zeros(self.vocab.size)
        for k, (arc, weight) in enumerate(zip(self.arcs, w), 1):
            share = np.exp(a[:, : n - k + 1] + weight + b[:, k:] - a[:, -1:]) * counts[:, None]
            used = arc >= 0
            out += np.bincount(arc[used], share[used], self.vocab.size)
            if k == 1 and len(self.letters):
                for spelled, c in zip(self.spelled, np.bincount(self.where, share[self.missing], len(self.letters))):
                    np.add.at(out, spelled, c)
        return out


def _groups(vocab: Vocabulary, distinct: list[str], cells: int = 150_000) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(places, lattice) of the words of each length, in blocks of bounded size."""
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for s, e in zip(edges[:-1], edges[1:]):
        step = max(1, cells // (int(lengths[order[s]]) + 1))
        for k in range(s, e, step):
            at = order[k : min(k + step, e)]
            yield at, Lattice(vocab, [distinct[i] for i in at])


def word_scores(vocab: Vocabulary, logp: np.ndarray, distinct: list[str]) -> np.ndarray:
    """Log10 marginal probability of each word, its leading space included."""
    out = np.zeros(len(distinct))
    for at, lattice in _groups(vocab, distinct):
        out[at] = lattice.forward(logp)[:, -1]
    return out / np.log(10)


def expectations(vocab: Vocabulary, logp: np.ndarray, distinct: list[str], counts: np.ndarray) -> np.ndarray:
    out = np.zeros(vocab.size)
    for at, lattice in _groups(vocab, distinct):
        out += lattice.expected(logp, counts[at])
    return out


def log_probabilities(vocab: Vocabulary, expected: np.ndarray, texts: float) -> np.ndarray:
    """Log probability of each piece from its expected uses, the texts' ends and the vocabulary's prior."""
    e = expected.copy()
    e[vocab.end] += texts
    p = (e + PRIOR_COUNT * vocab.prior) / (e.sum() + PRIOR_COUNT)
    with np.errstate(divide="ignore"):
        return np.log(p)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, uses) of every word of docs(text, train): its uses in the rows to train on (0 for a word of the others only) and in all rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            w = words(b.column("text"), lower=True)
            used = b.column("train").to_numpy(zero_copy_only=False)[w.doc] if len(w.doc) else np.zeros(0, bool)
            counts = [pa.array(np.bincount(code, minlength=len(w.distinct)).astype(np.int64)) for code in (w.code[used], w.code)]
            yield pa.RecordBatch.from_arrays([w.distinct, *counts], ["word", "c", "uses"])

    return docs.select("text", "train").mapInArrow(run, "word string, c bigint, uses bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))


def _hot_from(counts: DataFrame, most: int, by: str = "c") -> int:
    """The least count such that at most that many words have it or more (from a histogram by quarter powers of two)."""
    c = F.col(by)
    steps = counts.where(c > 0).groupBy(F.floor(4 * F.log2(c.cast("double"))).alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("c")).collect()
    held, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["b"]):
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    return least


def score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held_out: int = 2, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The words (A-Z lower-cased, ASCII white space splits) of all rows outside the held-out fold are
    counted. The vocabulary's scores start a fit of the piece probabilities: a few rounds on the most
    frequent words on the driver, then expectations over every counted word on the cluster. score is
    the log10 probability of the text: each word's marginal over all its segmentations (its leading
    space included; no piece crosses a space) and the end of text. base_score is the add-one unigram
    score of the same words and the end.

    Each distinct word is scored once. Words of many uses (at most hot_words of them) are looked up in a
    broadcast table; the rest of each document's words meet their counts by a shuffle join and are
    summed by row before the last shuffle.

    A null or empty text is its end alone. A null id counts as held out. Repeated rows are scored
    each; other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    fold = F.coalesce(hash_mod(id_col, parts) == held_out, F.lit(True))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), fold.alias("held_out"), (~fold).alias("train"), F.col(text_col).cast("string").alias("text"))

    counts = written(word_counts(rows), "word-counts")
    texts = docs.where(~fold).count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train_tokens, floor = total + texts, np.log10(total + texts + (distinct + (texts > 0)) + 1)
    least = _hot_from(counts, hot_words, "uses")  # by uses in all rows, so that a word of held-out rows only can't be a hot key of the join either
    vocab = load(vocabulary_path)
    hot = counts.where(F.col("uses") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    warm = counts.where(F.col("c") >= _hot_from(counts, WARM_WORDS)).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    logp = log_probabilities(vocab, np.zeros(vocab.size), 0)
    for _ in range(WARM_ROUNDS):
        logp = log_probabilities(vocab, expectations(vocab, logp, warm.column("word").to_pylist(), warm.column("c").to_numpy().astype(np.float64)), texts)
    started = spark.sparkContext.broadcast(logp)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, out = load(vocabulary_path), None
        for b in gathered(batches, WORDS_AT_ONCE):
            more = expectations(vocab, started.value, b.column("word").to_pylist(), b.column("c").to_numpy().astype(np.float64))
            out = more if out is None else out + more
        if out is not None:
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["piece", "uses"])

    uses = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    expected = np.zeros(vocab.size)
    expected[uses.column("piece").to_numpy()] = uses.column("uses").to_numpy()
    fitted = log_probabilities(vocab, expected, texts)
    final = spark.sparkContext.broadcast(fitted)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(vocabulary_path)
        for b in gathered(batches, WORDS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(word_scores(vocab, final.value, b.column("word").to_pylist()))], ["word", "c", "lp"])

    rare = written(counts.where(F.col("uses") < least).select("word", "c").mapInArrow(scored, "word string, c bigint, lp double"), "rare-words")
    frequent = spark.sparkContext.broadcast((hot.column("word").combine_chunks().cast(pa.string()) if hot.num_rows else pa.array([], pa.string()), np.append(hot.column("c").to_numpy(), 0), np.append(word_scores(vocab, fitted, hot.column("word").to_pylist()), 0.0)))
    end_base, end_score = float(np.log10(texts + 1) - floor), float(fitted[vocab.end] / np.log(10))
    floor = float(floor)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, lp = frequent.value
        names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "word", "uses"]
        for b in slices(batches, "text", SLICE):
            w = words(b.column("text"), lower=True)
            at = pc.fill_null(pc.index_in(w.distinct, value_set=known), len(known)).to_numpy(zero_copy_only=False)[w.code] if len(w.code) else np.zeros(0, np.int64)
            here = at < len(known)
            doc, at = w.doc[here], at[here]
            n = w.n
            sums = [
                w.per_doc + 1, np.bincount(doc[count[at] > 0], minlength=n) + int(texts > 0), np.bincount(doc, np.log10(count[at] + 1) - floor, n) + end_base, np.bincount(doc, lp[at], n) + end_score,
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *(pa.array(s.astype(np.int64) if i < 2 else s) for i, s in enumerate(sums)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
            pairs, uses = np.unique(w.doc[~here] * (len(w.distinct) + 1) + w.code[~here], return_counts=True)
            if len(pairs):
                doc, code = pairs // (len(w.distinct) + 1), pairs % (len(w.distinct) + 1)
                k = len(pairs)
                empty = [pa.nulls(k, f.type) for f in b.select(["id", "held_out"]).schema]
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(doc)), *empty, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), w.distinct.take(pa.array(code)), pa.array(uses.astype(np.int64))], names)

    out = written(rows.select("row", "id", "held_out", "text").mapInArrow(summed, f"row bigint, id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word string, uses bigint"), "row-sums")
    met = out.where("word is not null").select("row", "word", "uses").join(rare, "word").select(
        "row", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("bigint").alias("n_tokens"), F.when(F.col("c") > 0, F.col("uses")).otherwise(0).alias("n_known"),
        (F.col("uses") * (F.log10(F.col("c") + 1.0) - floor)).alias("base"), (F.col("uses") * F.col("lp")).alias("score"),
    )
    whole = out.where("word is null").select(*met.columns).unionByName(met).groupBy("row").agg(
        F.max("id").alias(id_col), F.bool_or("held_out").alias("held_out"), *(F.sum(c).alias(a) for c, a in (("n_tokens", "n_tokens"), ("n_known", "n_known"), ("base", "base_score"), ("score", "score")))
    )
    return whole.select(id_col, "held_out", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("bigint").alias("train_tokens"), "base_score", "score")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
