import random

import pytest

import corpus_pipeline
from pactlane.llm import jaccard
from pactlane.llm.common import table

from .conftest import COLUMNS, prose, rows
from .test_simhash_graph import plain_fingerprint, roots_of

SF = "/root/testdata/sf0.01"


def plain_shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_links(texts):
    sets, fps = [plain_shingles(t) for t in texts], [plain_fingerprint(t) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return alike, [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("xyz") * rng.randint(1, 9)
    return " ".join(w)


@pytest.mark.parametrize("seed,least", [(1, 10**9), (2, 2)])
def test_groups_against_brute_force(spark, monkeypatch, seed, least):
    monkeypatch.setattr(jaccard, "COMMON_LEAST", least)  # without and with common shingles
    monkeypatch.setattr(jaccard, "BLOCK", 50)
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    for t in list(texts):
        texts += [edited(rng, t, rng.randint(1, 5)) for _ in range(2)] + [t.upper(), t + " " + prose(rng, 9)]
    texts += [None, "", "ÉTÉ à la plage avec nous tous", "été À la plage avec nous tous"]
    alike, close = plain_links(texts)
    assert len(set(alike) - set(close)) > 20
    up = roots_of(range(len(texts)), alike + close)
    docs = spark.createDataFrame(rows([(i, t, None) for i, t in enumerate(texts)]), COLUMNS).repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == up


def test_odd_rows(odd, empty):
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == odd.count() and jaccard.near_duplicates(empty).count() == 0


def test_stage_leaves_no_pair_at_the_similarity(spark):
    docs = table(spark, SF, "documents")
    found = docs.select("doc_id", "text").orderBy("doc_id").collect()
    alike, close = plain_links([r.text for r in found])
    up = roots_of(range(len(found)), alike + close)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(found[k].doc_id for k in set(up.values()))
