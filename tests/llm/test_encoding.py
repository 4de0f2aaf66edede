import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import encoding

FILE = f"{encoding.VOCABULARY_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="vocabulary files are not here")


@pytest.fixture(scope="module")
def own():
    return encoding.encoder(open(FILE, "rb").read())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(FILE.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_merges_and_round_trips(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 30_000, "नमस्ते दुनिया " * 500, "<|endoftext|> x", " \n\n\t  ", "'s're", "\x00\x01"])
def test_odd_texts(own, library, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello", "z"), (3, "hello", "z")], "doc_id bigint, text string, ids string")
    out = encoding.encode(rows)
    assert out.columns == ["doc_id", "ids"]
    got = sorted((r.doc_id, list(r.ids)) for r in out.collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and got[3][1]
    assert encoding.encode(rows.limit(0)).count() == 0
    assert encoding.encode(rows.withColumn("extra", F.lit(1))).columns == ["doc_id", "extra", "ids"]
