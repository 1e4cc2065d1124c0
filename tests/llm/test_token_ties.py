"""Rows of one id over several files."""

import random

from pactlane.llm import token_output
from pactlane.llm.tokens import vocabulary

from .conftest import prose


def test_rows_of_one_id_are_spread_and_in_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, prose(rng, 30)) for _ in range(300)] + [(5, "one and the same text")] * 300 + [(7, None), (7, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = token_output.write_tokens(docs, f"file://{tmp_path}/t", vocabulary("word_bpe_49k.json"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_output.read_tokens(spark, written).orderBy("start").collect()
    tokenizer = token_output.encoder(vocabulary("word_bpe_49k.json")).tokenizer
    want = sorted(((i is not None, i or 0), t or "") for i, t in rows)
    assert [r.doc_id for r in got] == [i if known else None for (known, i), _ in want]
    assert [list(r.ids) for r in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in want]
    assert max(f[1] for f in written.files) < 300
