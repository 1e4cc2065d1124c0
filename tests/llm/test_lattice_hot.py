"""A word that only held-out rows have, on every one of them, is no key of the shuffle join."""

import math

from pactlane.llm import lattice_lm
from pactlane.llm.common import hash_mod
from pactlane.llm.tokens import vocabulary


def test_word_of_held_out_rows_only(spark):
    ids = spark.range(900).withColumnRenamed("id", "doc_id")
    docs = ids.selectExpr("doc_id", "concat('shared word', CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2 THEN repeat(' zzyzx', 50) ELSE concat(' own', doc_id) END) AS text")
    results = [{r.doc_id: r for r in lattice_lm.score(docs, vocabulary("piece_bpe_32k.model"), hot_words=n).collect()} for n in (3, 100_000)]
    held = {r.doc_id for r in docs.where(hash_mod("doc_id", 7) == 2).collect()}
    for got in results:
        assert len(got) == 900 and {i for i, r in got.items() if r.held_out} == held
        assert all(r.n_tokens == (53 if i in held else 4) and r.n_known == (3 if i in held else 4) for i, r in got.items())
    for i in list(held)[:20] + [i for i in range(60) if i not in held][:20]:
        assert all(math.isclose(results[0][i][c], results[1][i][c], rel_tol=1e-9) for c in ("base_score", "score"))
    counts = lattice_lm.word_counts(docs.withColumn("train", hash_mod("doc_id", 7) != 2))
    assert lattice_lm._hot_from(counts, 3, "uses") <= 50 * len(held)
