"""Problem 6: furniture, broken words, misread characters, and paragraphs."""

import pytest

from loomgraph.llm import noise

BODY = "the balance of the account is checked after each chapter of the book\nand the module returns 12 of 80 points on average, the up-to-date value\n第12章的学习目标由矩阵乘法推出，学习目标由矩阵乘法推出"
PAGES = [("a", 1, f"Mock Exam Primer\nChapter 1: loop\n\n{BODY}\n- 4 -")] + [
    ("a", n, f"Mock Exam Primer\nIn round {n * 7} all is well.\n{BODY}\n{n}{n}{n}7\n- {n + 3} -") for n in range(2, 12)
]
NOISY = (
    "a",
    12,
    "Mock Exam Primer\nthe bolance of the accoiint is 8o points, the mod-\nule returns the up-\nto-date value of \n学刁目标由炬阵乘法推出\nof the chap-\n- l5 -",
)
END = ("a", 13, "Mock Exam Primer\nter of the book is checked.\n- 16 -")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [*PAGES, NOISY, NOISY, END, ("a", 14, None), ("a", 15, " "), (None, 1, "x")]
    return spark.createDataFrame(rows, "doc_path string, page_no int, text string")


def test_lines_of_each_kind(pages):
    got = {(r.page_no, r.line_no, r.line_kind) for r in noise.found(pages).collect()}
    assert {x for x in got if x[0] == 12} == {(12, 1, "furniture"), (12, 2, "misread"), (12, 2, "broken_word"), (12, 5, "misread"), (12, 6, "broken_word"), (12, 7, "furniture")}
    # the heading and the rows of numbers belong to the text
    assert {x for x in got if x[0] == 1} == {(1, 1, "furniture"), (1, 7, "furniture")}
    assert {x for x in got if x[0] == 2} == {(2, 1, "furniture"), (2, 7, "furniture")}


def test_word_broken_over_a_page(spark):
    rows = [*PAGES, ("a", 12, "Mock Exam Primer\nthe end of the chap-\n- 15 -"), END]
    got = {(r.page_no, r.line_no, r.line_kind) for r in noise.found(spark.createDataFrame(rows, "doc_path string, page_no int, text string")).collect()}
    assert (12, 2, "broken_word") in got


def test_paragraphs_of_pages_and_joined_text(spark, pages):
    joined = "".join(f"\n\n===== PAGE {n} =====\n{t}" for _, n, t in [*PAGES, NOISY, END])
    docs = spark.createDataFrame([("b", joined), ("c", None)], "doc_path string, text string")
    got = noise.book_paragraphs(pages, docs).orderBy("page_no", "para_no").collect()
    for source in ("page", "doc"):
        text = "\n".join(r.text for r in got if r.source == source)
        assert "the balance of the account is 80 points, the module returns the up-to-date value" in text and "of the chapter of the book" in text
        assert "学习目标由矩阵乘法推出" in text and "Primer" not in text and "- 16 -" not in text and "bolance" not in text


def test_many_rows_of_what_was_learnt_are_joined_and_not_sent(pages):
    sent = sorted(map(tuple, noise.found(pages).collect()))
    assert sent and sorted(map(tuple, noise.found(pages, sent=0).collect())) == sent


def test_paragraph_over_the_end_of_a_stretch(spark):
    rows = [("a", n, f"In round {n} all of the lines go on and\non until the next page of the very same book comes and") for n in range(58, 70)]
    got = noise.book_paragraphs(spark.createDataFrame(rows, "doc_path string, page_no int, text string"), spark.createDataFrame([], "doc_path string, text string")).collect()
    assert len(got) == 1 and got[0].page_no == 58 and all(f"In round {n} all" in got[0].text for n in range(58, 70))


def test_confusions_of_ideographs_are_learnt(spark):
    runs = [("案例先完成", 40), ("练习已完成", 40), ("全部完成了", 40), ("案例先兄成", 1), ("练习已兄成", 1), ("全部兄成了", 1)]
    n = {}
    for text, k in runs:
        for i in range(3):
            n[text[i : i + 3]] = n.get(text[i : i + 3], 0) + k
    pairs = noise.twins(spark.createDataFrame(list(n.items()), "key string, n bigint"))
    assert "完" in pairs["兄"] and "兄" not in pairs.get("完", ())


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "doc_path string, page_no int, text string")
    assert noise.found(pages).count() == 0
    assert noise.book_paragraphs(pages, spark.createDataFrame([], "doc_path string, text string")).count() == 0


@pytest.mark.parametrize("sent", [noise.SENT, 0])
def test_lines_of_ideographic_spaces_only_are_blank(spark, sent):
    schema = "doc_path string, page_no int, text string"
    odd = [("a", 12, "　\nMock Exam Primer\n　　\nthe end of the chap-\n　 \n- 15 -\n　"), END, ("a", 14, "　"), ("b", 1, "　")]
    got = {(r.page_no, r.line_no, r.line_kind) for r in noise.found(spark.createDataFrame([*PAGES, *odd], schema), sent).collect()}
    assert {x for x in got if x[0] == 12} == {(12, 2, "furniture"), (12, 4, "broken_word"), (12, 6, "furniture")} and not [x for x in got if x[0] == 14]
    text = "\n".join(r.text for r in noise.book_paragraphs(spark.createDataFrame([*PAGES, *odd], schema), spark.createDataFrame([("c", "　\n\n===== PAGE 1 =====\n　\nx")], "doc_path string, text string"), sent).collect())
    assert "the end of the chapter of the book is checked." in text


def test_counts_and_wanted_keys_pass_over_indents_alone():
    held = {k: noise.Counter() for k in noise.KINDS}
    noise.observe("　\nthe mod-\n　　\nule", held)
    assert held["break"] == {"mod\tule": 1} and noise.shaped("　\n　x") == "\n　x"
    assert ("cut", "mod\tule") in noise.wanted(["　\nthe mod-\n　　\nule"], {})
