"""Problem 10: what is learnt for sentence boundaries."""

from collections import Counter

import pytest

from loomgraph.llm import sentences


def observed(text, group):
    counts = {k: Counter() for k in sentences.KINDS}
    sentences.observe(text, group, counts)
    return counts


@pytest.mark.parametrize("before", ["1234567890 " * 4, "(" * 45, "1234567890 " * 3 + "12345 "])
def test_a_starter_after_a_long_opening_is_whole(before):
    assert observed(before + "Wonderful things.", "en")["start"] == {"Wonderful": 1}


def learnt(spark, texts):
    return sentences.learn(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_korean_abbreviations_are_learnt(spark):
    said = ["학생은 책을 {n}권 읽었습니다.", "선생님은 수업을 {n}번 준비했습니다.", "이 표는 값을 {n}개 보여 줍니다."]
    texts = [" ".join(s.format(n=n) for s in said) + f" 결과는 약. {n}점이고 앞의 값은 vs. {n}점입니다." for n in range(60)]
    model = learnt(spark, texts)["ko"]
    assert {"약", "vs"} <= model.abbreviations
    assert "읽었습니다" not in model.abbreviations
    text = "결과는 약. 7점입니다. 학생은 책을 읽었습니다."
    assert [text[a:b] for a, b in sentences.split(text, "ko", model)] == ["결과는 약. 7점입니다.", "학생은 책을 읽었습니다."]


def test_hindi_periods_are_learnt(spark):
    said = ["उसने किताब {n} बार पढ़ी।", "डॉ. शर्मा ने उत्तर {n} बार जाँचा।", "यह पुस्तक अच्छी है।"]
    model = learnt(spark, [" ".join(s.format(n=n) for s in said) for n in range(80)])["hi"]
    assert "डॉ" in model.abbreviations and "है" not in model.abbreviations
    text = "यह पुस्तक अच्छी है. डॉ. के. शर्मा ने उत्तर जाँचा."
    assert [text[a:b] for a, b in sentences.split(text, "hi", model)] == ["यह पुस्तक अच्छी है.", "डॉ. के. शर्मा ने उत्तर जाँचा."]


def test_a_collocation_overrules_a_starter():
    model = sentences.Model(abbreviations={"prof"}, starters={"Grant", "Then"}, collocations={"prof\tGrant"})
    text = "We ask Prof. Grant. See Prof. Then stop."
    assert [text[a:b] for a, b in sentences.split(text, "en", model)] == ["We ask Prof. Grant.", "See Prof.", "Then stop."]


def test_collocations_are_learnt(spark):
    texts = [f"Then it rains! Grant waits! We ask Prof. Grant {n} times, e.g. in round {n}." for n in range(60)] + [f"Now it is {n}! Later we rest! Then we go!" for n in range(300)]
    assert "prof\tGrant" in learnt(spark, texts)["en"].collocations


def test_special_cases_and_extra_columns(spark):
    rows = [(1, "One two. Three four.", 5), (1, "One two. Three four.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (None, "Alone.", 5), (5, "word " * 30_000, 5), (6, "\ufeffHead\n\n1. item one. two", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_pos int")
    got = sorted(((r.doc_id or 0, r.start_pos, r.end_pos) for r in sentences.sentences(df, models={}).collect()))
    assert got == [(0, 0, 6), (1, 0, 8), (1, 0, 8), (1, 9, 20), (1, 9, 20), (5, 0, 149_999), (6, 0, 5), (6, 7, 23)]
    assert sentences.found(df.limit(0)).count() == 0
