import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlane.llm import langid_kernel, quality_gam, rules_forest, textstats, toxicity_cnn
from pactlane.llm.common import hash_mod, table
from pactlane.llm.labelled import sample

from .conftest import prose


def plain_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té#|\x0b中", max_size=60), st.sampled_from(["a b c d e a b c d e", "x y " * 9, "l\nl\n l\nl"])), max_size=5))
def test_rule_stats(texts):
    s = textstats.rule_stats(textstats.words(pa.array(texts, pa.string())))
    assert [tuple(int(s[c][k]) for c in rules_forest.STATS) for k in range(len(texts))] == [plain_stats(t) for t in texts]
    x = textstats.features(pa.array(texts, pa.string()))
    assert x.shape == (len(texts), len(textstats.FEATURES)) and np.isfinite(x).all() and (x >= 0).all()


def test_colliding_hashes_fall_back(monkeypatch):
    w = textstats.words(pa.array(["a b c d e f a b c d e x", "q w e r t y"]))
    want = textstats.repeated_words(w).tolist()
    monkeypatch.setattr(textstats, "_window_keys", lambda owner, ids: np.zeros(len(owner), np.uint64))
    assert textstats.repeated_words(w).tolist() == want == [10, 0]


def test_sample_is_bounded_and_skips_the_fold(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = sample(docs, labels, "quality", 3, 1, per_class=5).select("id", "y").collect()
    assert collections.Counter(r.y for r in got) == {0: 5, 1: 5}
    assert spark.createDataFrame(got).where(hash_mod("id", 3) == 1).count() == 0


def test_additive_model_learns_tables_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5) | (x[:, 2] < 0.05)).astype(float)
    model = quality_gam.fit(x[:2000], y[:2000], rounds=40)
    got = model.score(x[2000:])
    assert ((got >= 0.5) == y[2000:]).mean() > 0.93 and (0, 1) in {tuple(sorted(p)) for p in model.pairs}
    single = quality_gam.fit(x[:2000], y[:2000], rounds=40, pairs=0)
    assert ((single.score(x[2000:]) >= 0.5) == y[2000:]).mean() < 0.8
    b = model.bins(x[:1])[0]
    by_hand = model.base + sum(model.tables[j, b[j]] for j in range(4)) + sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert model.margin(x[:1])[0] == pytest.approx(by_hand)


def test_one_label_or_none():
    x = np.zeros((4, 2), np.float32)
    assert (quality_gam.fit(x, np.ones(4)).score(x) > 0.5).all()
    assert quality_gam.fit(np.zeros((0, 2), np.float32), np.zeros(0)).score(x) == pytest.approx([0.5] * 4)


def test_isolation_paths():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    forest = rules_forest.grow(x)
    s = forest.score(x)
    assert s[-1] > np.quantile(s[:-1], 0.99) and 0 < s.min() and s.max() < 1
    node, depth = 0, 0
    while forest.feature[0, node] >= 0:
        node, depth = 2 * node + 1 + int(x[0, forest.feature[0, node]] >= forest.cut[0, node]), depth + 1
    assert depth <= forest.length[0, node] <= depth + rules_forest._expected(256)
    one = rules_forest.Forest(forest.feature[:1], forest.cut[:1], forest.length[:1], forest.norm)
    assert one.score(x[:1])[0] == pytest.approx(2 ** (-forest.length[0, node] / forest.norm))
    assert (rules_forest.grow(x[:0]).score(x) <= rules_forest.Forest.threshold).all()


def test_threshold_bounds_what_good_rows_lose():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (2000, 2)), rng.normal(8, 0.5, (60, 2))])
    good = np.arange(len(x)) < 2000
    forest = rules_forest.calibrate(rules_forest.grow(x, rules_forest.weights(x, good)), x, good)
    s = forest.score(x)
    assert (s[good] > forest.threshold).mean() <= rules_forest.MAX_GOOD_REJECTED and (s[~good] > forest.threshold).mean() > 0.8


def test_base_limits():
    s = {c: np.array(v) for c, v in zip(rules_forest.STATS, [[9, 10, 100, 100], [1] * 4, [0] * 4, [0] * 4, [0, 0, 20, 21]])}
    assert rules_forest.base_failed(s).tolist() == [True, False, False, True]


def shared(spark, sf_dir, name):
    from pactlane.llm import queries

    return {r.doc_id: r for r in queries.QUERIES[name](spark, sf_dir).collect()}


def test_quality_on_held_out_rows(spark):
    got = shared(spark, "/root/testdata/sf0.01", "op1_quality")
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_rules_on_labelled_rows(spark):
    got = shared(spark, "/root/testdata/sf0.01", "op2_rules")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    assert all(plain_stats(r.text) == tuple(got[r.doc_id][c] for c in rules_forest.STATS) for r in docs)
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    passed = {i: r for i, r in got.items() if not r.base_failed and i in labels}
    assert np.mean([r.kept for i, r in passed.items() if labels[i]]) > 0.98 and np.mean([r.kept for i, r in passed.items() if not labels[i]]) < 0.5


def test_filters_ignore_all_columns_but_the_text(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gam.train(docs, labels)
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 100000})
    a = [r.score for r in quality_gam.score(docs, model).orderBy("doc_id").collect()]
    assert a == [r.score for r in quality_gam.score(moved, model).orderBy("doc_id").collect()]


def toxic_rows(rng, n):
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(n)]
    y = [rng.random() < 0.4 for _ in range(n)]
    for k, bad in enumerate(y):
        if bad:
            w = texts[k].split()
            w.insert(rng.randrange(len(w)), rng.choice(["zark", "blimpo!", "Quux"]))
            texts[k] = " ".join(w)
    return texts, np.array(y, np.float32)


def test_network_finds_words_and_pools_within_texts():
    rng = random.Random(3)
    texts, y = toxic_rows(rng, 700)
    net = toxicity_cnn.fit(toxicity_cnn.tokens(pa.array(texts)), y)
    more, want = toxic_rows(rng, 300)
    got = net.score(toxicity_cnn.tokens(pa.array([*more, None, ""])))
    assert ((got[:300] >= toxicity_cnn.AT) == (want == 1)).mean() > 0.97 and len(got) == 302 and (got[300:] < toxicity_cnn.AT).all()
    for k in range(5):  # a text scores the same alone as among others
        assert net.score(toxicity_cnn.tokens(pa.array([more[k]])))[0] == pytest.approx(got[k], abs=1e-5)


def test_pooling_against_plain_loops():
    rng = np.random.default_rng(4)
    net = toxicity_cnn._new(rng)
    net.bias = rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    w = toxicity_cnn.tokens(pa.array(["one two three four", "", "five", "two one"]))
    ids = toxicity_cnn.buckets(w.distinct)
    got = net.pooled(ids, w.code, w.doc, w.per_doc)
    for d in range(4):
        emb = net.table[ids[w.code[w.doc == d]]].sum(axis=1)
        want, column = [], 0
        for width in toxicity_cnn.WIDTHS:
            z = [sum(emb[p + j] @ net.filters[column + j] for j in range(width) if p + j < len(emb)) for p in range(len(emb))]
            want.append(np.max(z, axis=0) if z else np.full(toxicity_cnn.FILTERS, -np.inf))
            column += width
        want = np.maximum(np.concatenate(want) + net.bias, 0) if len(emb) else np.zeros(len(net.out))
        assert got[d] == pytest.approx(want, abs=1e-4)


def test_thresholds_map_to_the_fixed_score():
    net = toxicity_cnn._new(np.random.default_rng(0))
    net.thresholds = {"": 0.5, "en": 0.9}
    w = toxicity_cnn.tokens(pa.array(["the of and", "zzz"]))
    p, s = net.probability(w), net.score(w)
    for k, t in enumerate((0.9, 0.5)):
        assert (s[k] >= toxicity_cnn.AT) == (p[k] >= t) and 0 <= s[k] <= 1
    assert toxicity_cnn.groups(w) == ["en", ""]


def test_kernel_against_plain_sets():
    texts = ["the red house", "das rote haus", "la casa roja", "a", None]
    model = langid_kernel.fit(pa.array(texts[:3]), ["en", "de", "es"], landmarks=3)
    grams = lambda t: {t.lower().encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    space = set().union(*(grams(t) for t in texts[:3]))
    data, offsets = langid_kernel._bytes(pa.array(texts))
    got = model.presence(data, offsets)
    assert got.sum(axis=1).tolist() == [len(grams(t or "") & space) for t in texts]
    k = model.kernel(got[:3])
    assert np.diag(k) == pytest.approx([1, 1, 1]) and k[0, 1] == pytest.approx(len(grams(texts[0]) & grams(texts[1])) / (len(grams(texts[0])) * len(grams(texts[1]))) ** 0.5, abs=1e-5)


def test_language_of_held_out_rows(spark):
    got = shared(spark, "/root/testdata/sf0.01", "op8_language")
    docs = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    held = [r.lang_pred == docs[i] for i, r in got.items() if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in got.values())


def test_languages_of_odd_rows(spark, odd, empty):
    model = langid_kernel.train(odd)
    got = langid_kernel.predict(odd, model).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.lang_pred, r.score))
    assert len(got) == odd.count() and all(by[k] == {("und", 0.0)} for k in (0, 1, 2)) and next(iter(by[9]))[0] in model.languages
    assert next(iter(by[3]))[0] in model.languages  # a wide letter is a letter
    assert langid_kernel.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid_kernel.predict(odd, langid_kernel.train(empty)).collect()} == {"und"}


def test_trained_operators_on_odd_rows(spark, odd, empty, no_labels, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gam, net, forest = quality_gam.train(docs, labels), toxicity_cnn.train(docs, labels), rules_forest.train(docs, labels)
    for found in (quality_gam.score(odd, gam), toxicity_cnn.score(odd, net)):
        got = found.collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    kept = {r.doc_id: r for r in rules_forest.apply(odd, forest).collect()}
    assert kept[0].base_failed and not kept[0].kept and kept[10].n_repeat_words == 3000 and kept[4].n_words == 40000
    for out in (quality_gam.drop_poor(odd, gam), toxicity_cnn.drop_toxic(odd, net)):
        assert out.schema == odd.schema and out.count() <= odd.count()
    for f in (lambda d: quality_gam.score(d, quality_gam.train(d, no_labels)), lambda d: toxicity_cnn.score(d, toxicity_cnn.train(d, no_labels)), lambda d: rules_forest.apply(d, rules_forest.train(d, no_labels))):
        assert f(odd).count() == odd.count() and f(empty).count() == 0


def test_a_rare_language_is_learned(spark):
    rows = [(k, "the house and the garden of the town " + "x" * (k % 3), "en") for k in range(400)] + [(1000 + k, "der garten und das haus in der stadt", "de") for k in range(5)]
    docs = spark.createDataFrame([*rows, *[rows[0]] * 300, (9999, "y" * 20_000, "xx"), (None, "et la maison", "fr")], "doc_id bigint, text string, lang string")
    model = langid_kernel.train(docs, None, max_rows=12)
    assert model.languages == ["de", "en"]
    assert langid_kernel.train(docs.limit(0), None).languages == []
