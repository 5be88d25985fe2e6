"""Problem 9: everything in, nothing overfull, nothing split that fits, hardly any space unused."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 60))
def test_best_subset_is_the_best(counts, room):
    reach = {0}
    for size, k in counts.items():
        reach = {r + i * size for r in reach for i in range(k + 1)}
    chosen = packing.best_subset(counts, room)
    assert all(k <= counts[s] for s, k in chosen.items())
    assert sum(s * k for s, k in chosen.items()) == max(r for r in reach if r <= room)


def check(spark, sizes, capacity=100, **kw):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container string")
    rows = packing.pack(df, capacity, **kw).collect()
    by, load = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        load.setdefault(r.container, []).append((r.offset, r.offset + r.n_tokens))
    assert set(by) == {i for i, n in enumerate(sizes) if n}
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in pieces) == sizes[i] and len(pieces) == -(-sizes[i] // capacity)
        assert [r.first_token for r in pieces] == [k * capacity for k in range(len(pieces))]
    for spans in load.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    return len(load), -(-sum(n for n in sizes if n) // capacity)


def test_random_sizes(spark):
    rng = random.Random(3)
    got, least = check(spark, [rng.randint(1, 60) for _ in range(2000)] + [350, 100, None, 0, 101])
    assert got <= least + 1


def test_a_length_that_most_items_share(spark):
    got, least = check(spark, [37] * 3000 + [26] * 500, ranked=200)
    assert got <= 1.01 * 3000 / 2


def test_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0
