import numpy as np
import pytest

import corpus_pipeline
from pactlane.llm import packing, quality_gam, simhash, toxicity_cnn
from pactlane.llm.common import table

from .test_decontam_warc import plain_contained
from .test_simhash_graph import plain_fingerprint, roots_of

NAMES = ["toxicity", "quality", "near_dedup", "decontamination", "packing"]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(docs before, docs after) of every stage, each written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, after
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None
    for name in NAMES[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and 0 < after.count() < before.count()


def test_scored_stages_drop_what_the_operators_reject(spark, stages):
    labels = table(spark, SF, "labels")
    before, after = stages["toxicity"]
    scores = toxicity_cnn.score(before, toxicity_cnn.train(before, labels))
    assert ids(after) == ids(scores.where("score < 0.3"))
    before, after = stages["quality"]
    scores = quality_gam.score(before, quality_gam.train(before, labels))
    assert ids(after) == ids(scores.where("score >= 0.5"))


def test_clean_rows_stay(spark, stages):
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    for name, column, good in (("toxicity", "toxic", 0), ("quality", "quality", 1)):
        before, after = stages[name]
        kept = set(ids(after))
        clean = [i for i in ids(before) if i in labels and labels[i][column] == good]
        assert np.mean([i in kept for i in clean]) > 0.97


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    found = [(r.doc_id, plain_fingerprint(r.text)) for r in before.select("doc_id", "text").collect()]
    roots = roots_of([i for i, _ in found], [(a, b) for k, (a, x) in enumerate(found) for b, y in found[:k] if (x ^ y).bit_count() <= 3])
    assert ids(after) == sorted(set(roots.values()))


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    bad = {i for i, _ in plain_contained(rows, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    assert bad and ids(after) == sorted({i for i, _ in rows} - bad)


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    assert sorted({r.doc_id for r in after.select("doc_id").collect()}) == ids(before)
    for r in after.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect():
        assert r.doc_tokens == r["sum(length)"]


def test_run_gives_the_stages_rows(spark, stages):
    key = lambda df: sorted(tuple(r) for r in packing.digests(df).select("doc_id", "start", "length", "ids_crc32").collect())
    got = corpus_pipeline.run(spark, SF)
    assert sorted({r[0] for r in key(got)}) == sorted({r[0] for r in key(stages["packing"][1])})
    assert got.agg({"length": "sum"}).first()[0] == stages["packing"][1].agg({"length": "sum"}).first()[0]


@pytest.mark.parametrize("name", NAMES)
def test_stages_take_odd_and_empty_documents(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, empty):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = out.collect()
        assert len(got) <= max(docs.count(), 0) or name == "packing"
        if name != "packing":
            assert out.columns == docs.columns


def test_shared_ids_keep_one_row(spark, odd):
    kept = simhash.one_each(odd).groupBy("doc_id").count().where("doc_id is not null and count > 1")
    assert kept.count() == 0
