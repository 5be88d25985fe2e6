"""Problem 8: the reduction gives the ids of a whole encoding."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
PARTS = ["the ", "it's", " 's", "'", "  ", "\n\n", "学习", "１２", "12", "a", "é", "<|endoftext|>", "—", "!!", "\t", "👩‍👩‍👧", "ह", "ไทย", "\r\n", "  "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.sampled_from([2, 7, 16]))
def test_tree_equals_whole(parts, leaf):
    encoding, sizes = tokens.encoder()
    encode = encoding.encode_ordinary
    text = "".join(parts)
    assert tokens.encode_tree(encode, sizes, text, leaf) == encode(text)


def test_long_runs_without_a_safe_place():
    encoding, sizes = tokens.encoder()
    encode = encoding.encode_ordinary
    for text in ("a" * 5000, "学" * 3000, "!" * 3000, " " * 3000, "7" * 3000, "ab1" * 2000):
        assert tokens.encode_tree(encode, sizes, text) == encode(text)


def test_special_cases_and_other_columns(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (2, "", "x"), (3, None, None), (None, "<|endoftext|>", "x"), (4, "word " * 4000, "x")]
    got = tokens.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    ids = {r.doc_id: r.ids for r in got}
    encoding, sizes = tokens.encoder()
    encode = encoding.encode_ordinary
    assert len(got) == 6 and ids[2] == [] and ids[3] == [] and ids[1] == encode("one two") and ids[None] == encode("<|endoftext|>") and ids[4] == encode("word " * 4000)
    assert tokens.decode(ids[4]) == "word " * 4000
    assert tokens.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_most_documents_go_through_a_join(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    lengths = [r.n for r in spark.read.parquet(path).selectExpr("length(text) n").where("n > 0").collect()]
    assert sum(n > tokens.LEAF for n in lengths) > 0.85 * len(lengths)
