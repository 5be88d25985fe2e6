"""The k most similar vectors of every vector."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import vptree
from loomgraph.llm.common import spread
from loomgraph.runtime import stash

#: The sample that a tree over shards is fitted on has about this many vectors, whatever the size of the table.
SAMPLE = 16_384
#: Vectors that one task places in, or sends through, the second tree of a region.
PLACED = 200_000
#: Vectors of a shard, about; a shard's block has at most twice as many.
SHARD = 4096
#: Queries that one task searches a block for.
QUERIES = 65_536
#: What the bound is divided by.
FACTOR = 10.0


def usable(chunks: DataFrame, width: int = 64, key: str = "chunk_id", col: str = "embedding") -> DataFrame:
    """(id, vec): vectors of `width` finite entries that aren't all zero, scaled to unit length, as float32 bytes; each id
    once (of rows that differ the greatest vector counts). Null ids are left out."""
    ok = (F.size(col) == width) & ~F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(col, lambda x: x != 0)
    schema = pa.schema([("id", pa.string()), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            v = b.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), _bytes(x)], schema=schema)

    rows = chunks.where(F.col(key).isNotNull() & F.col(col).isNotNull() & ok).select(F.col(key).cast("string").alias("id"), F.col(col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id string, vec binary").groupBy("id").agg(F.max("vec").alias("vec"))


def _bytes(x: np.ndarray) -> pa.Array:
    """The rows of a float32 matrix as binary values."""
    ends = np.arange(0, (len(x) + 1) * x.shape[1] * 4, x.shape[1] * 4, dtype=np.int32)[: len(x) + 1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(a: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    parts = a.chunks if isinstance(a, pa.ChunkedArray) else [a]
    return np.frombuffer(b"".join(x for p in parts for x in p.to_pylist()), np.float32).reshape(-1, width)


def _second(regions: DataFrame, big: DataFrame, shard: int, sample: int, width: int) -> DataFrame:
    """(leaf, tree): a tree over each of the `big` leaves (leaf, n) of the upper tree, fitted on a bounded sample of the
    vectors (vec, leaf) there. The trees are built by the executors and stay there."""
    share = F.greatest(F.lit(1), F.floor(F.col("n") / sample))
    some = regions.join(big, "leaf").where(F.pmod(F.xxhash64(F.lit("second"), "vec"), share) == 0).select("leaf", "vec", "n")

    def fit(t):
        x, n = _matrix(t.column("vec"), width), t.column("n")[0].as_py()
        tree = vptree.build(x, max(16, int(len(x) * shard / n)))
        return pa.table([pa.array([t.column("leaf")[0].as_py()], pa.int32()), pa.array([pickle.dumps(tree)], pa.binary())], names=["leaf", "tree"])

    return stash(some.groupBy("leaf").applyInArrow(fit, "leaf int, tree binary"), "trees")


def _by_tree(rows: DataFrame, trees: DataFrame, big: DataFrame, f, ddl: str, arrow: pa.Schema) -> DataFrame:
    """f(tree, rows) for the rows (rep, leaf, ...) of each leaf with its tree, in parts of about PLACED rows."""
    parts = big.select("leaf", F.ceil(F.col("n") / PLACED).cast("int").alias("parts"))
    left = rows.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
    right = trees.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("leaf", "part", "tree")

    def run(t, tree):
        return f(pickle.loads(tree.column("tree")[0].as_py()), t) if t.num_rows and tree.num_rows else arrow.empty_table()

    return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(run, ddl)


def neighbours(vectors: DataFrame, k: int = 10, factor: float = FACTOR, width: int = 64, shard: int = SHARD, sample: int = SAMPLE, queries: int = QUERIES) -> DataFrame:
    """(id, neighbour, cosine, rank): the k vectors with the greatest cosine to each vector of (id, vec), rank 1 first;
    ties in byte order of the id. Fewer than k vectors give shorter lists; an empty table gives no row.

    An upper vantage-point tree, fitted on a bounded sample, cuts the space into leaves; a leaf with more than twice
    `shard` vectors is cut further by a tree of its own, fitted on a bounded sample of that leaf by the executors. Every
    vector belongs to one shard, a leaf of either level, and each shard has a tree over its vectors. A vector first searches
    its own shard, which gives it a bound, the angle to its k-th neighbour so far; then it goes to the shards that the
    triangle inequality doesn't rule out, with the bound divided by `factor`: 1 is exact, 10 finds 0.98 of the true
    neighbours of these tables (tests measure it by factor, against brute force).

    Copies of one vector are searched once and share the result; each lists its own copies first, so any number of them
    costs k rows each. A shard that still has too many vectors is cut by hash into blocks, a block with many queries by
    hash of the query: no task holds more than a bounded number of either. The driver holds the upper tree and a count
    for each of its leaves, of which there are at most a sixteenth of `sample`. Vectors are routed by their ids.
    """
    spark = vectors.sparkSession
    points = stash(vectors.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "vec", "n"), "points")
    total = points.count()
    if not total:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    # a hash of the vector chooses the sample, about `sample` of all
    every = max(1, total // sample)
    fit = points.where(F.pmod(F.xxhash64(F.lit("sample"), "vec"), F.lit(every)) == 0).select("vec").toArrow()
    fit = _matrix(fit.column(0), width) if fit.num_rows else _matrix(points.select("vec").limit(1).toArrow().column(0), width)
    upper = spark.sparkContext.broadcast(vptree.build(fit, max(16, int(len(fit) * shard / total)) if total > shard else len(fit)))

    def place(batches):
        for b in batches:
            leaf = pa.array(vptree.home(upper.value, _matrix(b.column(1), width)), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, leaf, pa.array(np.zeros(len(leaf), np.int32))], names=["rep", "vec", "leaf", "sub"])

    home = pa.schema([("rep", pa.string()), ("vec", pa.binary()), ("leaf", pa.int32()), ("sub", pa.int32())])
    home_ddl = "rep string, vec binary, leaf int, sub int"
    homes = stash(spread(points.select("rep", "vec"), "rep").mapInArrow(place, home_ddl), "homes")
    counts = [(r["leaf"], r["count"]) for r in homes.groupBy("leaf").count().where(F.col("count") > 2 * shard).collect()]
    big = spark.createDataFrame(counts, "leaf int, n bigint") if counts else None
    if big is not None:
        trees = _second(homes.select("leaf", "vec"), big, shard, sample, width)

        def deeper(tree, t):
            sub = vptree.home(tree, _matrix(t.column("vec"), width)) + 1
            return pa.table([t.column("rep"), t.column("vec"), t.column("leaf"), pa.array(sub, pa.int32())], schema=home)

        small = homes.join(big.select("leaf"), "leaf", "left_anti").select("rep", "vec", "leaf", "sub")
        homes = stash(small.unionByName(_by_tree(homes.drop("sub"), trees, big, deeper, home_ddl, home)), "homes")
    shards = stash(homes.groupBy("leaf", "sub").agg(F.ceil(F.count(F.lit(1)) / (2 * shard)).cast("int").alias("blocks")), "shards")
    placed = homes.join(shards, ["leaf", "sub"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    hits = pa.schema([("rep", pa.string()), ("other", pa.string()), ("cosine", pa.float32())])

    def as_hits(ids: np.ndarray, names: np.ndarray, best: vptree.Best) -> pa.Table:
        rows, cols = np.nonzero(best.who >= 0)
        return pa.table([pa.array(ids[rows], pa.string()), pa.array(names[best.who[rows, cols]], pa.string()), pa.array(best.cos[rows, cols])], schema=hits)

    def within(t):
        names, x = np.array(t.column("rep").to_pylist(), object), _matrix(t.column("vec"), width)
        best = vptree.Best(len(x), k)
        vptree.search(vptree.build(x, 512), x, x, best, factor, own=True)
        return as_hits(names, names, best)

    first = stash(placed.groupBy("leaf", "sub", "block").applyInArrow(within, "rep string, other string, cosine float"), "first")
    # with fewer than k found, nothing may be ruled out
    bar = first.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.min("cosine").alias("m")).select("rep", F.when(F.col("c") >= k, F.col("m")).alias("bar"))
    asking = homes.join(bar, "rep", "left").select("rep", "vec", F.coalesce("bar", F.lit(-2.0)).cast("float").alias("bar"))

    def reached(tree, x, low):
        return vptree.reached(tree, x, np.where(low < -1, np.inf, np.arccos(np.clip(low, -1, 1))), factor)

    def route(batches):
        for b in batches:
            rows, leaves = reached(upper.value, _matrix(b.column(1), width), b.column(2).to_numpy())
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in b.columns], pa.array(leaves, pa.int32())], names=["rep", "vec", "bar", "leaf"])

    routes = asking.mapInArrow(route, "rep string, vec binary, bar float, leaf int")
    to = pa.schema([("rep", pa.string()), ("bar", pa.float32()), ("leaf", pa.int32()), ("sub", pa.int32())])
    if big is None:
        routed = routes.select("rep", "bar", "leaf", F.lit(0).alias("sub"))
    else:
        routes = stash(routes, "routes")

        def further(tree, t):
            rows, subs = reached(tree, _matrix(t.column("vec"), width), t.column("bar").to_numpy())
            rows = pa.array(rows)
            return pa.table([t.column("rep").take(rows), t.column("bar").take(rows), t.column("leaf").take(rows), pa.array(subs + 1, pa.int32())], schema=to)

        asked = routes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(big.select("leaf"), "leaf")
        flat = routes.join(big.select("leaf"), "leaf", "left_anti").select("rep", "bar", "leaf", F.lit(0).alias("sub"))
        routed = flat.unionByName(_by_tree(routes, trees, asked, further, "rep string, bar float, leaf int, sub int", to))
    own = placed.select("rep", "leaf", "sub", "block")
    routed = routed.join(shards, ["leaf", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "leaf", "sub", "block", "bar")
    routed = stash(routed.join(own, ["rep", "leaf", "sub", "block"], "left_anti"), "routed")
    on = ["leaf", "sub", "block"]
    many = routed.groupBy(*on).count().select(*on, F.ceil(F.col("count") / queries).cast("int").alias("turns"))
    ask = routed.join(many, on).withColumn("turn", F.pmod(F.xxhash64("rep"), F.col("turns")).cast("int")).drop("turns").join(points.select("rep", "vec"), "rep")
    held = placed.join(many, on).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")

    def across(q, p):
        if not q.num_rows or not p.num_rows:
            return hits.empty_table()
        x, y = _matrix(q.column("vec"), width), _matrix(p.column("vec"), width)
        best = vptree.Best(len(x), k, q.column("bar").to_numpy())
        vptree.search(vptree.build(y, 512), y, x, best, factor)
        return as_hits(np.array(q.column("rep").to_pylist(), object), np.array(p.column("rep").to_pylist(), object), best)

    on.append("turn")
    second = ask.groupBy(*on).cogroup(held.groupBy(*on)).applyInArrow(across, "rep string, other string, cosine float")
    near = first.unionByName(second)
    # at most k of each block that was searched
    lists = near.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "other"))), 1, k).alias("near"))
    return _with_copies(vectors, points, stash(lists, "lists"), k)


def _with_copies(members: DataFrame, points: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Lists of the vectors' own copies and of the copies of their neighbours, each class by its first k + 1 ids."""
    if points.where("n > 1").limit(1).count() == 0:
        pairs = lists.select(F.col("rep").alias("id"), F.explode("near").alias("x")).select("id", F.col("x.other").alias("neighbour"), (-F.col("x.d")).cast("double").alias("cosine"))
        return _ranked(pairs, k)
    named = members.join(points.select("vec", "rep"), "vec").select("id", "rep")
    heads = named.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("i") <= k + 1).select("rep", F.col("id").alias("neighbour"))
    near = lists.select("rep", F.explode("near").alias("x")).select("rep", F.col("x.other").alias("other"), (-F.col("x.d")).cast("double").alias("cosine"))
    near = near.unionByName(points.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine")))
    # the best k + 1 of each class, its own included; every member takes them without itself
    best = near.join(heads.withColumnRenamed("rep", "other"), "other").select("rep", "neighbour", "cosine")
    best = best.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("i") <= k + 1).drop("i")
    return _ranked(named.join(best, "rep").where("id <> neighbour").select("id", "neighbour", "cosine"), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", F.least("cosine", F.lit(1.0)).alias("cosine"), F.col("rank").cast("int").alias("rank"))


def found(chunks: DataFrame, least: float = 0.95, k: int = 10) -> DataFrame:
    """Pairs of the lists with a cosine of at least `least`; a pair may stand in either list or in both."""
    near = neighbours(usable(chunks), k).where(F.col("cosine") >= least)
    pair = near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b"), "cosine")
    return pair.groupBy("chunk_a", "chunk_b").agg(F.max("cosine").alias("c")).where(F.col("c") >= least).select("chunk_a", "chunk_b")
