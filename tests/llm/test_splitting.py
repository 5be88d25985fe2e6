"""Problem 3: pieces under the limit, at natural boundaries, with an overlap, that an edit leaves alone."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import splitting

WORDS = ["alpha", "beta.", "gamma,", "delta!", "\n\n", "\n", "\r\n\r\n", "学习目标。", "矩阵", "x" * 300, "é", "👩‍👩‍👧", " ", "निर्देश।"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=300), st.sampled_from([(100, 10, 25), (200, 20, 50)]))
def test_pieces_cover_the_text(parts, bounds):
    limit, overlap, least = bounds
    text = " ".join(parts)
    pieces = splitting.cuts(text, limit, overlap, least)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, _), (s2, _, _) in zip(pieces, pieces[1:], strict=False):
        assert 0 < e - s <= limit and s2 == e - overlap
    assert pieces[-1][1] - pieces[-1][0] <= limit


def test_cuts_lie_on_paragraphs_where_there_are_any():
    rng = random.Random(1)
    text = "\n\n".join("word " * rng.randint(8, 30) + "end." for _ in range(60))
    kinds = [k for *_, k in splitting.cuts(text, 1600, 160, 400)[:-1]]
    assert kinds and set(kinds) == {"paragraph"}


def test_an_edit_alters_neighbouring_pieces_only():
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choice(["loop", "table", "ledger", "unit", "score"]) + str(rng.randint(0, 99)) for _ in range(12)) + "." for _ in range(300))
    pieces = lambda x: {x[s:e] for s, e, _ in splitting.cuts(x, 1600, 160, 400)}
    before, after = pieces(text), pieces(text[:5000] + " and more" + text[5000:])
    assert len(after - before) <= 3


@pytest.mark.parametrize("limit", [20, 50])
def test_no_boundary_at_all(limit):
    pieces = splitting.cuts("x" * 1000, limit, 2, 5)
    assert all(e - s <= limit for s, e, _ in pieces) and pieces[-1][1] == 1000


def test_special_cases_and_latest_version(spark):
    docs = spark.createDataFrame([("d1", "b" * 1601, 2), ("d1", "a", 1), ("d2", "a", 2), ("d2", "b" * 5000, 1), ("d3", None, 1), ("d4", "", 1), (None, "b" * 9000, 1), ("d5", "b" * 1600, 1)], "id string, body string, v int").selectExpr("id", "body", "timestamp_seconds(v) updated_at", "v piece_no")
    chunks = spark.createDataFrame([("c1", "x" * 201), ("c1", "x" * 201), ("c2", "x" * 200), ("c3", None), (None, "x" * 900)], "chunk_id string, text string")
    assert {tuple(r) for r in splitting.found(docs, chunks).collect()} == {("document", "d1"), ("chunk", "c1")}
    rows = splitting.pieces(docs, chunks).where("item_id in ('d3', 'd4')").collect()
    assert [(r.n_pieces, r.text) for r in rows] == [(1, ""), (1, "")]
    assert splitting.found(docs.limit(0), chunks.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_items(docs, 100, 60)
