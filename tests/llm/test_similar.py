"""Problem 1: the lists against brute force, by factor, over one and two levels of trees."""

import numpy as np
import pytest

from loomgraph.llm import similar, vptree


def clustered(n, seed=1, width=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, width))
    x = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall(spark, x, **kw):
    df = spark.createDataFrame([(f"v{i:05d}", v.tobytes()) for i, v in enumerate(x)], "id string, vec binary")
    got = {}
    for r in similar.neighbours(df, **kw).collect():
        got.setdefault(r.id, []).append(r.cosine)
    c = x @ x.T
    np.fill_diagonal(c, -2)
    kth = -np.sort(-c, axis=1)[:, 9]
    assert all(len(v) == 10 for v in got.values()) and len(got) == len(x)
    return sum(sum(c >= kth[i] - 1e-5 for c in got[f"v{i:05d}"]) for i in range(len(x))) / (10 * len(x))


@pytest.mark.parametrize(("factor", "least"), [(1.0, 0.9999), (4.0, 0.95), (similar.FACTOR, 0.9)])
def test_recall_by_factor(spark, factor, least):
    assert recall(spark, clustered(1500), factor=factor, shard=128) >= least


def test_recall_over_two_levels(spark):
    # few leaves of the upper tree, so that nearly all are cut by trees of their own
    x = clustered(2000)
    assert recall(spark, x, factor=1.0, shard=64, sample=64) >= 0.9999
    assert recall(spark, x, shard=64, sample=64) >= 0.9


def test_nothing_is_ruled_out_while_fewer_than_k_are_known():
    x = clustered(40)
    tree = vptree.build(x, 4)
    best = vptree.Best(len(x), 10)
    vptree.search(tree, x, x, best, 1000.0, own=True)
    assert (best.who[:, :3] >= 0).all()


def test_special_cases(spark):
    v = clustered(30)
    rows = [(f"c{i}", [float(y) for y in x]) for i, x in enumerate(v)]
    rows += [("same1", rows[0][1]), ("same2", [2 * y for y in rows[0][1]]), rows[3], (None, rows[1][1]), ("null", None), ("empty", []), ("zero", [0.0] * 64), ("short", [1.0] * 63), ("nan", [float("nan")] + [1.0] * 63), ("inf", [float("inf")] + [1.0] * 63), ("hole", [None] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "chunk_id string, embedding array<float>, vec string")
    got = similar.neighbours(similar.usable(df)).collect()
    assert {r.id for r in got} == {f"c{i}" for i in range(30)} | {"same1", "same2"}
    first = {r.id: r for r in got if r["rank"] == 1}
    assert first["c0"].neighbour == "same1" and first["same2"].neighbour == "c0" and first["c0"].cosine > 0.999
    assert {tuple(r) for r in similar.found(df).collect()} >= {("c0", "same1"), ("c0", "same2"), ("same1", "same2")}
    assert similar.neighbours(similar.usable(df.limit(0))).count() == 0


def _around(centres, n, noise, seed=7):
    rng = np.random.default_rng(seed)
    x = np.repeat(centres, n, 0) + noise * rng.normal(size=(len(centres) * n, centres.shape[1])) / centres.shape[1] ** 0.5
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_no_list_stays_short_while_there_are_vectors():
    # two far groups, the smaller of fewer than k
    one = np.eye(64)[:1]
    x = np.concatenate([_around(one, 60, 0.05), _around(-one, 10, 0.05)])
    best = vptree.Best(len(x), 20)
    vptree.search(vptree.build(x, 8), x, x, best, 4.0, own=True)
    assert (best.who >= 0).all()


def test_nothing_is_out_of_reach_without_a_bound():
    one = np.eye(64)[:1]
    x = np.concatenate([_around(one, 60, 0.05), _around(-one, 10, 0.05)])
    tree = vptree.build(x, 8)
    rows, leaves = vptree.reached(tree, x, np.full(len(x), np.inf), 4.0)
    assert len(rows) == len(x) * (len(tree.ends) - 1)
