import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pactlane.llm import packing
from pactlane.llm.tokens import Encoder, vocabulary

from .conftest import COLUMNS, rows

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "\n", "  ", "½", "hello", "wörld", ".", "|", "<", "　"]


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    return Encoder(vocabulary(request.param)), Tokenizer.from_file(vocabulary(request.param))


def encoded(encoder, texts):
    flat, at = encoder.encode(pa.array(texts, pa.string()), 7)
    return [flat[s : e - 1].tolist() for s, e in zip(at[:-1], at[1:])]


def test_known_ids():
    text = ["hello <|endoftext|> world"]
    assert encoded(Encoder(vocabulary(NAMES[0])), text) == [[31373, 220, 50256, 995]]
    assert encoded(Encoder(vocabulary(NAMES[1])), text) == [[3306, 49407, 1002]]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=5))
def test_equal_to_the_untouched_tokenizer(pair, texts):
    encoder, plain = pair
    assert encoded(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_token_over_two_texts_is_none(pair):
    encoder, plain = pair
    texts = ["a <|endof", "text|> b", "<|endoftext|>" * 3]
    assert encoded(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packed_document_counts_the_token_once(spark):
    docs = spark.createDataFrame(rows([(1, "hello <|endoftext|> world", None)]), COLUMNS)
    assert [r.doc_tokens for r in packing.pack(docs, vocabulary(NAMES[0]), 0).collect()] == [5]
