import random

import numpy as np
import pytest

from pactlane.llm import jaccard

from .conftest import COLUMNS, prose, rows
from .test_jaccard import edited, plain_links
from .test_simhash_graph import roots_of


@pytest.mark.parametrize("widest,list_rows", [(512, 2000), (16, 2000), (512, 40)])
def test_pairs_of_a_shared_passage_are_not_written(spark, monkeypatch, widest, list_rows):
    monkeypatch.setattr(jaccard, "COMMON_LEAST", 10**9)  # the sample shows no common shingle
    monkeypatch.setattr(jaccard, "WIDEST", widest, raising=False)
    monkeypatch.setattr(jaccard, "LIST_ROWS", list_rows)
    counts, written = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: [out := written(df, name), counts.update({name: out.count()})][0])
    rng = random.Random(3)
    passage, words = prose(rng, 30), lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    texts = [f"{words(k := rng.randrange(10, 60))} {passage} {words(70 - k)}" for _ in range(300)]
    texts += [edited(rng, t, 1) for t in texts[:20]] + [edited(rng, t, 3) for t in texts[20:40]]
    alike, close = plain_links(texts)
    up = roots_of(range(len(texts)), alike + close)
    assert len(set(up.values())) <= len(texts) - 20
    docs = spark.createDataFrame(rows([(i, t, None) for i, t in enumerate(texts)]), COLUMNS).repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == up
    assert counts["candidates"] <= (len(texts) if widest == 512 else len(texts) ** 2)


def test_sketches_never_tell_more_apart_than_there_is():
    rng = np.random.default_rng(1)
    some = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for n in [1, 2, 63, 64, 65, 500, 511, 512, 700, 9000] * 5:
        shared = some(rng.integers(0, n + 1))
        sets = [np.unique(np.concatenate([shared, some(k - min(k, len(shared)))])) for k in (n, n + n // 4 + 1)]
        apart = len(np.setxor1d(*sets))
        for size in (8, 64, 1 << 20):
            sketches = [jaccard.folded(jaccard.sketch(s), size).tobytes() for s in sets]
            assert jaccard.least_apart(sketches, np.array([0, 1, 0]), np.array([1, 0, 0])).tolist()[2] == 0
            assert (jaccard.least_apart(sketches, np.array([0, 1]), np.array([1, 0])) <= apart).all()
    assert jaccard.least_apart([b"", jaccard.sketch(some(9))], np.array([0]), np.array([1])).tolist() == [0]
