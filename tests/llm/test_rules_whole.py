"""The rule forest's split weights and threshold are counted over every labelled row, not over a bounded sample."""

import random

import numpy as np
import pyarrow as pa

from pactlane.llm import rules_forest as rf
from pactlane.llm.textstats import rule_stats, words


def test_weights_and_threshold_come_from_all_labelled_rows(spark):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randint(1, 9) + "#" * (rng.random() < (0.02 if k % 3 else 0.12)) for _ in range(rng.randint(12, 60))) for k in range(14_000)]
    y = [int(k % 3 > 0) for k in range(len(texts))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([*enumerate(y), (None, 1), (3, None)], "doc_id bigint, quality int")
    forest = rf.train(docs, labels)
    s = rule_stats(words(pa.array(texts)))
    passed = ~rf.base_failed(s)
    x, good = rf.signals(s)[passed], np.array(y)[passed] == 1
    assert good.sum() > 4_000 < (~good).sum()
    want = rf.calibrate(rf.Forest(forest.feature, forest.cut, forest.length, forest.norm), x, good)
    assert forest.threshold == want.threshold < 1
    assert (forest.score(x)[good] > forest.threshold).sum() <= rf.MAX_GOOD_REJECTED * good.sum()
    rows = spark.createDataFrame([(int(g), *map(float, v)) for g, v in zip(good, x)], "y int, x0 double, x1 double, x2 double, x3 double, x4 double")
    assert np.allclose(rf._drawn(rf.areas(rows)), rf.weights(x, good))


def test_threshold_of_few_or_tied_scores(spark):
    rng = np.random.default_rng(3)
    for good, bad, most in (([0.4] * 5, [0.4, 0.6], 0.0), ([0.4, 0.7], [0.3], 0.003), (rng.integers(1, 9, 400) / 10, rng.integers(3, 10, 60) / 10, 0.1), ([0.5], [0.5], 0.5)):
        s, y = np.concatenate([good, bad]), np.repeat([1, 0], [len(good), len(bad)])
        rows = spark.createDataFrame([(int(a), float(b), int(np.array(b).view(np.int64))) for a, b in zip(y, s)], "y int, score double, key bigint")
        fixed = rf.Forest(None, None, None, 1.0)
        fixed.score = lambda x: x[:, 0]
        assert rf.threshold(rows, len(good), most) == rf.calibrate(fixed, s[:, None], y == 1, most).threshold


def test_rows_sent_for_the_trees_do_not_grow(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join("x" * rng.randint(1, 9) for _ in range(20 + k % 2 * 9))) for k in range(3_000)], "doc_id bigint, text string").repartition(6)
    labels = docs.selectExpr("doc_id", "doc_id % 2 quality")
    monkeypatch.setattr(rf, "TREES", 1)  # 256 rows for all trees
    sent, limit = [], type(docs).limit

    def watched(self, n):
        sent.append((self.count(), n))
        return limit(self, n)

    monkeypatch.setattr(type(docs), "limit", watched)
    forest = rf.train(docs, labels)
    sent = [x for x in sent if x[1] > 1]  # first() has a limit of 1
    assert [n for _, n in sent] == [256, 8] and all(n <= c <= 3 * n + 200 for c, n in sent)
    assert forest.norm == rf._expected(256)
