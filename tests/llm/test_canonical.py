"""Problem 4: texts that look the same become equal, others don't."""

import random
import unicodedata

import pytest

from loomgraph.llm import canonical
from loomgraph.llm.canonical import transducer

SAME = [
    ("ｶﾞ", "ガ"), ("ﾊﾟ", "パ"), ("한", "한"), ("café", "café"),
    ("ＣＡＦＥ", "CAFE"), ("a​b c", "ab c"), ("x‑y", "x-y"), ("а́", "á"), ("Ӏ", "I"), ("ѵ", "v"), ("օ", "o"), ("Ꭲ", "T"), ("ꓮ", "A"),
    ("⼈", "人"), ("a\r\nb", "a\nb"), ("ậ", "ậ"), ("ậ", "ậ"), ("❤️", "❤"),
]
OTHER = [("a؀", "a"), ("۝5", "5"), ("\U0001f468‍\U0001f469", "\U0001f468\U0001f469"), ("x²", "x2"), ("A", "a"), ("é", "e"), ("a  b", "a b"), ("a\nb", "a b"), ("カ", "ガ")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert transducer().apply(a) == transducer().apply(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert transducer().apply(a) != transducer().apply(b)


def test_a_form_maps_to_itself():
    rng, apply = random.Random(3), transducer().apply
    bases = [chr(o) for o in (*range(0x41, 0x7B), *range(0x391, 0x3CA), *range(0x400, 0x460), *range(0x1100, 0x1113), *range(0x3041, 0x30FF), *range(0xAC00, 0xAC40), *range(0xFF66, 0xFF9E))]
    tails = [chr(o) for o in (*range(0x300, 0x345), *range(0x5B0, 0x5C0), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 0x3099, 0x309A, 0xFF9E, 0xFF9F, 0x200D)]
    for _ in range(200_000):
        s = rng.choice(bases) + "".join(rng.choices(tails, k=rng.randint(1, 4)))
        form = apply(s)
        assert apply(form) == form and apply(unicodedata.normalize("NFD", s)) == form


def test_records_of_each_kind(spark):
    items = spark.createDataFrame([("e1", "ｘ１", "q"), ("e2", "x1", "q"), ("e3", None, None), ("e4", "", "q"), ("e5", " ", "q"), ("e2", "x1", "q"), (None, "x1", "q")], "item_id string, stem string, form string")
    docs = spark.createDataFrame([("d1", "new", 2), ("d1", "old", 1), ("d2", "old", 1), ("d3", "nеw", 1)], "id string, body string, v int").selectExpr("id", "body", "timestamp_seconds(v) updated_at")
    pages = spark.createDataFrame([("p", 1, "long " * 20_000), ("p", 2, "long " * 20_000), ("q", None, "x")], "doc_path string, page_no int, text string")
    got = {tuple(r) for r in canonical.found(items, docs, pages, block=1).collect()}
    assert got == {("exam", "e1", "e2"), ("document", "d1", "d3"), ("page", "p#1", "p#2")}
    classes = {(r.item_kind, r.key): (r.class_key, r.n_records) for r in canonical.look_alike_classes(canonical.record_forms(items, docs, pages)).collect()}
    assert classes[("exam", "e2")] == ("e1", 2) and classes[("document", "d2")] == ("d2", 1)
    assert canonical.found(items.limit(0), docs.limit(0), pages.limit(0)).count() == 0
