"""Encoding against the reference library, whole texts at once."""

import hashlib

import public_tokenizers
import pytest

from tenure.llm import bpe
from tenure.llm.registry import VOCABULARY

TEXTS = [
    None,
    "",
    " ",
    "a",
    "It's we'll they've   two  spaces\n\n\tand tabs 12345 !?",
    "x" * 700,
    " " * 300 + "end",
    "naïve café 日本語 🙂🙂 " * 20,
    "don'" + "t" * 3 + " l'll " * 60,
    "word " * 150,
    "1,2;3.4 " * 50 + "y" * 200 + " more words here " * 10,
    "<|endoftext|> is text",
]


@pytest.fixture(scope="module")
def library():
    return bpe.encoding_of(VOCABULARY, public_tokenizers.PATTERN)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 40), (1 << 15, 1 << 11)])
def test_same_ids_as_the_library(spark, library, chunk, overlap):
    rows = [(i, t, "other", 9) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "twice", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, k int")
    ids = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    got = bpe.decode(ids, VOCABULARY).collect()
    assert len(got) == len(rows)
    for row in got:
        text = TEXTS[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.data).decode() == text


def test_digests_and_missing_ids(spark, library):
    docs = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    ids = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    row = bpe.digests(bpe.decode(ids, VOCABULARY)).first()
    expected = library.encode_ordinary("some text")
    assert row.doc_id is None and row.n_tokens == len(expected)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"some text").hexdigest()


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ids = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert bpe.digests(bpe.decode(ids, VOCABULARY)).collect() == []
