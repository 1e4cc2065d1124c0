import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlane.llm import simhash
from pactlane.llm.graph import components

from .conftest import COLUMNS, prose, rows


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if h and 2 * sum(v >> i & 1 for v in h) > len(h))


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉ é\t\n\x0b Z.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_nothing():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_links_are_all_pairs_within_the_distance(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base) | {0, (1 << 64) - 1, 1, 7, 1 << 63}
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = [tuple(sorted(r)) for r in simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), "fp", bits).collect()]
    want = {tuple(sorted((a, b))) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert set(got) == want and len(got) == len(want)


def test_components_of_chain_star_and_ring(spark):
    links = [(k, k + 1) for k in range(200, 260)] + [(5, k) for k in range(300, 400)] + [(k, 900 + (k + 1) % 10) for k in range(900, 910)] + [(1, 1), (None, 4), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None]
    want = {n: r for n, r in roots_of({x for l in real for x in l}, real).items() if n != r}
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(60)]
    for t in list(texts):
        w = t.split()
        if w:
            texts += [t, t.upper(), " ".join(w[:-1])]
    found = list(enumerate(texts)) + [(500, None), (501, ""), (None, texts[0]), (3, texts[3])]
    got = simhash.near_duplicates(spark.createDataFrame(rows([(i, t, None) for i, t in found]), COLUMNS)).collect()
    fps = [plain_fingerprint(t) for _, t in found]
    up = roots_of(range(len(found)), [(a, b) for a in range(len(found)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for k, (i, _) in enumerate(found):
        if i is not None:
            least[up[k]] = min(i, least.get(up[k], i))
    want = sorted((str(i), fps[k], least.get(up[k])) for k, (i, _) in enumerate(found))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, r.component_id) for r in got) == want


def test_hot_class_and_one_each(spark):
    found = [(k, "the same words in every one of these texts", "en") for k in range(50)] + [(100, "another text with other words altogether here", "en"), (None, "a third text that has no id of its own", "en"), (100, "another text with other words altogether here", "en")]
    docs = spark.createDataFrame(rows(found), COLUMNS)
    kept = simhash.one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "100", "None"]


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.fp == 0} == {0}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_each(empty).count() == 0
    assert simhash.one_each(odd).columns == odd.columns
