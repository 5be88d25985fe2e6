"""Parent-child rows to roots, depths, full paths and descendants, with cycles reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.attempts import folded
from loomgraph.runtime import stash

#: One node in so many is a splitter.
SPLIT = 8
SEED = 20240229


def parent_pointers(nodes: DataFrame, edges: DataFrame, edge_type: str = "prerequisite") -> DataFrame:
    """(pack_id, kp_id, parent): each node once. Edges of the type (without regard to case and white space), between two
    different nodes of the pack. Of several parents of a node the first in byte order is taken; nodes or packs that are
    null are left out."""
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    e = (
        edges.where(folded(F.col("edge_type")) == edge_type).select("pack_id", F.col("from_kp").alias("parent"), F.col("to_kp").alias("kp_id"))
        .where("parent <> kp_id").join(n.withColumnRenamed("kp_id", "parent"), ["pack_id", "parent"], "left_semi")
        .groupBy("pack_id", "kp_id").agg(F.min("parent").alias("parent"))
    )
    return n.join(e, ["pack_id", "kp_id"], "left")


def several_parents(nodes: DataFrame, edges: DataFrame, edge_type: str = "prerequisite") -> DataFrame:
    """(pack_id, kp_id, n_parents): the nodes with more than one parent, of which parent_pointers takes the first."""
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    e = (
        edges.where(folded(F.col("edge_type")) == edge_type).select("pack_id", F.col("from_kp").alias("parent"), F.col("to_kp").alias("kp_id"))
        .where("parent <> kp_id").distinct().join(n.withColumnRenamed("kp_id", "parent"), ["pack_id", "parent"], "left_semi").join(n, ["pack_id", "kp_id"], "left_semi")
    )
    return e.groupBy("pack_id", "kp_id").agg(F.count(F.lit(1)).alias("n_parents")).where("n_parents > 1")


def _run(walk: DataFrame, name: str, paths: bool) -> DataFrame:
    """The walkers (pack_id, kp_id, at, steps[, path], done) that reach a stop, by doubling: those that aren't at one jump
    as far as the walker at their place has come. path has the nodes passed, the walker's own first, without the place it
    has reached. A round writes only the walkers that still were on their way, in two parts.

    It doubles until a round brings no walker to its stop. A walker that is 2^r or more steps from its stop has one on its
    way at more than 2^(r-1) steps, so after such a round all that are left walk for ever."""
    cols = ["pack_id", "kp_id", "at", "steps"] + ["path"] * paths
    walk = stash(walk, name)
    arrived, still = walk.where("done").select(*cols), walk.where("not done").select(*cols)
    left = still.count()
    while left:
        ahead = arrived.withColumn("done", F.lit(True)).unionByName(still.withColumn("done", F.lit(False)))
        ahead = ahead.select("pack_id", F.col("kp_id").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("more"), *[F.col("path").alias("path2")] * paths, "done")
        moved = still.join(ahead, ["pack_id", "at"])
        moved = stash(moved.select("pack_id", "kp_id", F.col("at2").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), *[F.concat("path", "path2").alias("path")] * paths, "done"), name)
        arrived, still = arrived.unionByName(moved.where("done").select(*cols)), moved.where("not done").select(*cols)
        left, before = still.count(), left
        if left == before:
            break
    return arrived


def hierarchy(parents: DataFrame, split: int = SPLIT, paths: bool = True) -> DataFrame:
    """(pack_id, kp_id, root_kp, depth[, path]): path runs from the root to the node. A node on a cycle or below one has
    root_kp '', depth -1 and a null path. Without `paths` only steps are counted, so a chain of n costs n cells, not n².

    Splitters are all roots and the nodes whose hash falls into one of `split` classes. First every node walks to the
    next splitter above it, keeping the nodes it passes (expected `split` steps); then the splitters alone, a graph
    `split` times smaller, are solved by pointer doubling; last each node's path is put together from its splitter's and
    its own steps. Walkers that meet no splitter are in or below a cycle that has none, found by a round without
    progress. Every round joins on (pack, node), so neither a pack nor a tree is ever in one task, and the number of
    rounds is the logarithm of the longest walk.

    An empty table gives no row; repeated nodes and edges count once.
    """
    p = parents.withColumn("stop", F.col("parent").isNull() | (F.pmod(F.xxhash64(F.lit(SEED), "pack_id", "kp_id"), F.lit(split)) == 0))
    p = stash(p, "parents")
    stops = p.where("stop").select("pack_id", F.col("kp_id").alias("parent"), F.lit(True).alias("s"))
    none = F.array().cast("array<string>")
    first = (
        p.where("parent is not null").join(stops, ["pack_id", "parent"], "left")
        .select("pack_id", "kp_id", F.col("parent").alias("at"), F.lit(1).alias("steps"), *[F.array("kp_id").alias("path")] * paths, F.coalesce("s", F.lit(False)).alias("done"))
    )
    walk = _run(first, "walk", paths)
    # the graph of splitters: each points to the next splitter above, over the steps of its walk
    roots = p.where("parent is null").select("pack_id", F.col("kp_id").alias("at"), F.lit(True).alias("r"))
    reduced = (
        walk.join(p.where("stop").select("pack_id", "kp_id"), ["pack_id", "kp_id"], "left_semi")
        .join(roots, ["pack_id", "at"], "left").select("pack_id", "kp_id", "at", "steps", *["path"] * paths, F.coalesce("r", F.lit(False)).alias("done"))
    )
    solved = _run(reduced, "reduced", paths)
    top = solved.select("pack_id", F.col("kp_id").alias("at"), F.col("at").alias("root_kp"), F.col("steps").alias("up_steps"), *[F.col("path").alias("up")] * paths)
    own = roots.select("pack_id", "at", F.col("at").alias("root_kp"), F.lit(0).alias("up_steps"), *[none.alias("up")] * paths)
    steps = walk.unionByName(p.where("parent is null").select("pack_id", "kp_id", F.col("kp_id").alias("at"), F.lit(0).alias("steps"), *[none.alias("path")] * paths))
    whole = steps.join(top.unionByName(own), ["pack_id", "at"]).select(
        "pack_id", "kp_id", "root_kp", (F.col("steps") + F.col("up_steps")).cast("int").alias("depth"), *[F.concat(F.array("root_kp"), F.reverse(F.concat("path", "up"))).alias("path")] * paths
    )
    out = p.select("pack_id", "kp_id").join(whole, ["pack_id", "kp_id"], "left")
    return out.select("pack_id", "kp_id", F.coalesce("root_kp", F.lit("")).alias("root_kp"), F.coalesce("depth", F.lit(-1)).alias("depth"), *["path"] * paths)


def descendants(tree: DataFrame) -> DataFrame:
    """(pack_id, kp_id, descendant, distance): a row for each node above each node. Long form: a root's descendants are
    never gathered in one row."""
    steps = tree.where("path is not null").select("pack_id", F.col("kp_id").alias("descendant"), "depth", F.posexplode("path").alias("d", "kp_id"))
    return steps.where("d < depth").select("pack_id", "kp_id", "descendant", (F.col("depth") - F.col("d")).alias("distance"))


def cycles(parents: DataFrame, tree: DataFrame) -> DataFrame:
    """(pack_id, kp_id, cycle): each node on a cycle, with the first node of the cycle in byte order as its name.

    Among the nodes without a root, 2^r steps up with 2^r beyond their number lead onto the cycle, and every node of a
    cycle is reached; the least node passed names it."""
    lost = stash(parents.join(tree.where("depth < 0").select("pack_id", "kp_id"), ["pack_id", "kp_id"], "left_semi").select("pack_id", "kp_id", F.col("parent").alias("at"), F.col("parent").alias("least")), "lost")
    most = lost.groupBy("pack_id").count().agg(F.max("count")).first()[0] or 0
    jump = lost
    for _ in range(int(most).bit_length()):
        ahead = jump.select("pack_id", F.col("kp_id").alias("at"), F.col("at").alias("at2"), F.col("least").alias("least2"))
        jump = stash(jump.join(ahead, ["pack_id", "at"]).select("pack_id", "kp_id", F.col("at2").alias("at"), F.least("least", "least2").alias("least")), "jump")
    on = jump.select("pack_id", F.col("at").alias("kp_id")).distinct()
    return jump.join(on, ["pack_id", "kp_id"], "left_semi").select("pack_id", "kp_id", F.col("least").alias("cycle"))


def found(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return hierarchy(parent_pointers(nodes, edges), paths=False).select("pack_id", "kp_id", "root_kp", "depth")
