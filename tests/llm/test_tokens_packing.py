import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactlane.llm import packing, token_output
from pactlane.llm.common import shared_dir
from pactlane.llm.tokens import Encoder, vocabulary

from .conftest import COLUMNS, prose, rows

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    plain = Tokenizer.from_file(vocabulary(request.param))
    plain.encode_special_tokens = True
    return Encoder(vocabulary(request.param)), plain


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="ab'sé1. \n\t 　́\x85\x1c½|<>endoftext", max_size=40)), max_size=6))
def test_encoding_equals_the_tokenizers(pair, texts):
    encoder, plain = pair
    flat, at = encoder.encode(pa.array(texts, pa.string()), 7)
    assert [flat[s:e].tolist() for s, e in zip(at[:-1], at[1:])] == [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


def test_cache_starts_anew(pair, monkeypatch):
    encoder, plain = pair
    monkeypatch.setattr("pactlane.llm.tokens.CACHE_SEGMENTS", 10)
    rng = random.Random(0)
    for _ in range(5):
        t = prose(rng, 50)
        assert encoder.encode(pa.array([t]), 1)[0].tolist()[:-1] == plain.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_assign(lengths):
    got = packing.assign(np.array(lengths, np.int64))
    by_doc, by_seq = {}, {}
    for doc, start, length, seq, offset in got:
        by_doc.setdefault(doc, []).append((start, length))
        by_seq.setdefault(seq, []).append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == n
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_seq) == -(-sum(n % 1024 for n in lengths) // 1024) + sum(n // 1024 for n in lengths)


def test_assign_balances_cost():
    pieces = packing.assign(np.array([600] * 4 + [200] * 8))
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + n + n * n / 1024
    assert max(cost.values()) / min(cost.values()) < 1.2


def checked_pieces(docs, found):
    plain = Tokenizer.from_file(vocabulary(NAMES[0]))
    plain.encode_special_tokens = True
    want = sorted((str(i), *[*plain.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs)
    seqs = {}
    pieces = {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, ids.tolist()))
    for parts in seqs.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)][:-1]]).tolist() and sum(n for _, n in parts) <= 1024
    got_total = sorted(x for p in pieces.values() for _, ids in p for x in ids)
    assert got_total == sorted(x for w in want for x in w[1:])
    return pieces


def test_pack(spark, odd, empty):
    rng = random.Random(2)
    found = [(k, prose(rng, rng.randint(0, 900))) for k in range(80)]
    docs = spark.createDataFrame(rows([(i, t, None) for i, t in found]), COLUMNS).repartition(3, "doc_id")
    out = packing.pack(docs, vocabulary(NAMES[0]), 0, block_tokens=5000)
    pieces = checked_pieces(found, out.collect())
    plain = Tokenizer.from_file(vocabulary(NAMES[0]))
    for i, t in found:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert [x for _, part in sorted(pieces[str(i), len(ids)]) for x in part] == ids
    assert packing.digests(out).where("ids_crc32 is null").count() == 0
    checked_pieces([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], packing.pack(odd, vocabulary(NAMES[0]), 0).collect())
    assert packing.pack(empty, vocabulary(NAMES[0]), 0).count() == 0


def test_token_files(spark, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    written = token_output.write_tokens(odd.repartition(3), folder, vocabulary(NAMES[1]), 1)
    got = token_output.read_tokens(spark, written).orderBy("start").collect()
    plain = Tokenizer.from_file(vocabulary(NAMES[1]))
    plain.encode_special_tokens = True
    source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd.select("doc_id", "text").collect()))
    at = 0
    assert len(got) == len(source)
    for r, (known, i, _, text) in zip(got, source):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i if known else None, at, len(ids), ids)
        at += len(ids)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_output.digests(token_output.read_tokens(spark, written)).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    nothing = token_output.write_tokens(empty, f"file://{tmp_path}/none", vocabulary(NAMES[1]), 1)
    assert token_output.digests(token_output.read_tokens(spark, nothing)).count() == 0


def test_file_layout_and_selective_reads(spark, monkeypatch):
    monkeypatch.setattr(token_output, "GROUP_DOCS", 50)
    rng = random.Random(4)
    docs = spark.createDataFrame(rows([(k, prose(rng, 30), None) for k in range(300)]), COLUMNS).coalesce(1)
    folder = shared_dir(spark, "tokens-test")
    written = token_output.write_tokens(docs, folder, vocabulary(NAMES[1]), 1)
    file = pq.ParquetFile(f"{folder.removeprefix('file://')}/{written.files[0][0]}")
    group = file.metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    some = token_output.read_tokens(spark, written, F.col("doc_id").between(10, 12), ids=False)
    assert [r.doc_id for r in some.orderBy("doc_id").collect()] == [10, 11, 12]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "GreaterThanOrEqual(doc_id,10)" in plan
