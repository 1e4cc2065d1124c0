import collections
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from pactlane.llm import lattice_lm as lm
from pactlane.llm.tokens import vocabulary

from .conftest import COLUMNS, prose, rows

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return lm.load(PATH)


def pieces_of(vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    known = set(vocab.ids.tolist())
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if i in known}


def segmentations(word, table, vocab):
    """Every segmentation of a word as lists of piece ids; a character that is no piece is spelled in bytes."""

    @lru_cache(None)
    def below(at):
        if at == len(word):
            return [()]
        out = []
        for n in range(1, 17):
            if at + n > len(word):
                break
            if word[at : at + n] in table:
                out += [(table[word[at : at + n]], *rest) for rest in below(at + n)]
        if word[at] not in table:
            out += [(*vocab.bytes[list(word[at].encode())].tolist(), *rest) for rest in below(at + 1)]
        return out

    return below(0)


def test_marginals_and_expectations(vocab):
    table = pieces_of(vocab)
    logp = lm.log_probabilities(vocab, np.zeros(vocab.size), 3)
    assert np.exp(logp).sum() == pytest.approx(1)
    distinct = ["the", "house", "xq", "é中", "ሴa", "a", "\U0001f600"]
    got = lm.word_scores(vocab, logp, distinct)
    uses = np.zeros(vocab.size)
    for k, w in enumerate(distinct):
        found = segmentations(lm.SPACE + w, table, vocab)
        weights = [math.exp(sum(logp[i] for i in s)) for s in found]
        assert got[k] == pytest.approx(math.log10(sum(weights)))
        for s, x in zip(found, weights):
            for i in s:
                uses[i] += (k + 1) * x / sum(weights)
    assert lm.expectations(vocab, logp, distinct, np.arange(1.0, len(distinct) + 1)) == pytest.approx(uses)


def test_long_words_stay_finite(vocab):
    logp = lm.log_probabilities(vocab, np.zeros(vocab.size), 1)
    assert np.isfinite(lm.word_scores(vocab, logp, ["ab" * 3000])).all()


def test_rounds_raise_the_likelihood(vocab):
    counts = {"river": 9, "rivers": 4, "stone": 7, "the": 40, "stoned": 1}
    logp, last = lm.log_probabilities(vocab, np.zeros(vocab.size), 1), -np.inf
    for _ in range(4):
        now = float((lm.word_scores(vocab, logp, list(counts)) * np.array(list(counts.values()))).sum())
        assert now > last
        last = now
        logp = lm.log_probabilities(vocab, 1000 * lm.expectations(vocab, logp, list(counts), np.array(list(counts.values()), float)), 1)


@pytest.mark.parametrize("hot", [0, 5, 200_000])
def test_scores_against_brute_force(spark, odd, vocab, hot):
    import random

    rng = random.Random(9)
    found = [(k, prose(rng, rng.randint(0, 40)), "en") for k in range(60)]
    docs = spark.createDataFrame(rows(found), COLUMNS).unionByName(odd)
    got = lm.score(docs, PATH, hot_words=hot).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in texts]
    out = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    c = collections.Counter(w for ws, o in zip(words, out) if not o for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), o, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), 5)) for (i, _), ws, o in zip(texts, words, out))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    by = {(str(r.doc_id), r.n_tokens): r.score for r in got}
    # the score adds up over words, so a text's own words and the end give it again
    one = {(str(i), len(ws) + 1): ws for (i, _), ws in zip(texts, words)}
    end = by["1", 1]
    known = {w: by[k] - end for k, ws in one.items() if len(ws) == 1 for w in ws}
    assert by["0", len(words[0]) + 1] < 0 and all(x < 0 for x in known.values())
    if hot == 0:
        test_scores_against_brute_force.seen = by
    elif hasattr(test_scores_against_brute_force, "seen"):
        for k, s in test_scores_against_brute_force.seen.items():
            assert by[k] == pytest.approx(s, rel=1e-9)


def test_empty_table(empty):
    assert lm.score(empty, PATH).count() == 0
