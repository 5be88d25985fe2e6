"""Graph operators over all packs at once: nodes (pack_id, kp_id), edges (pack_id, from_kp, to_kp[, weight]).

Every loop joins on (pack, node), so neither a pack nor a hub is in one task; what a round makes is written to the shared
folder, and the driver holds a count per round. Rows with a null key are left out; repeated edges count once unless it
says otherwise; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.operators.attempts import folded
from loomgraph.operators.hierarchy import hierarchy
from loomgraph.runtime import stash

#: Rounds of a loop between two writes.
EVERY = 5


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are different nodes of their pack."""
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    e = edges.where("from_kp <> to_kp")
    for end in ("from_kp", "to_kp"):
        e = e.join(n.withColumnRenamed("kp_id", end), ["pack_id", end], "left_semi")
    return e


def strongest_edges(edges: DataFrame, ranks: tuple[str, ...] = ("prerequisite", "transfer_gap", "related", "tested", "attach")) -> DataFrame:
    """(pack_id, a, b, from_kp, to_kp, edge_type, weight): of the edges between two nodes, in either direction, the one of
    the strongest type (the first in `ranks`), then of the greatest weight, then the first by its ends."""
    t = folded(F.col("edge_type"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ranks]), t), F.lit(0))
    rank = F.when(rank == 0, F.lit(len(ranks) + 1)).otherwise(rank).cast("int")
    best = F.min(F.struct(rank.alias("rank"), (-F.coalesce("weight", F.lit(0.0))).alias("minus"), "from_kp", "to_kp", t.alias("edge_type")))
    e = edges.where("from_kp is not null and to_kp is not null and from_kp <> to_kp and pack_id is not null")
    e = e.groupBy("pack_id", F.least("from_kp", "to_kp").alias("a"), F.greatest("from_kp", "to_kp").alias("b")).agg(best.alias("x"))
    return e.select("pack_id", "a", "b", "x.from_kp", "x.to_kp", "x.edge_type", (-F.col("x.minus")).alias("weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pack_id, kp_id, n_in, n_out, hub): degrees over valid edges, each counted; hub is sqrt(in x out) + (in + out) / 4."""
    ends = valid_edges(nodes, edges).select("pack_id", F.explode(F.array(F.struct(F.col("to_kp").alias("kp_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_kp").alias("kp_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    d = ends.select("pack_id", "x.*").groupBy("pack_id", "kp_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    d = n.join(d, ["pack_id", "kp_id"], "left").fillna(0, ["n_in", "n_out"])
    return d.withColumn("hub", f.hub_score(F.col("n_in"), F.col("n_out")))


def pack_report(nodes: DataFrame, edges: DataFrame, least_nodes: int = 30, least_edges: int = 40) -> DataFrame:
    """(pack_id, nodes, edges, bad_weight, bad_source, bad_end, density, valid): a pack is valid with enough nodes and
    edges, weights within (0, 2], sources that aren't blank, and both ends of every edge known. Cycles are apart."""
    n = nodes.where("pack_id is not null and kp_id is not null").select("pack_id", "kp_id").distinct()
    ends = edges.where("pack_id is not null")
    for end in ("from_kp", "to_kp"):
        ends = ends.join(n.select("pack_id", F.col("kp_id").alias(end), F.lit(1).alias("_" + end)), ["pack_id", end], "left")
    e = ends.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("weight").isNull() | (F.col("weight") <= 0) | (F.col("weight") > 2)).alias("bad_weight"),
        F.count_if(F.col("source").isNull() | (F.btrim("source") == "")).alias("bad_source"), F.count_if(F.col("_from_kp").isNull() | F.col("_to_kp").isNull()).alias("bad_end"),
    )
    r = n.groupBy("pack_id").agg(F.count(F.lit(1)).alias("nodes")).join(e, "pack_id", "left").fillna(0)
    ok = (F.col("nodes") >= least_nodes) & (F.col("edges") >= least_edges) & (F.col("bad_weight") + F.col("bad_source") + F.col("bad_end") == 0)
    return r.select("pack_id", "nodes", "edges", "bad_weight", "bad_source", "bad_end", f.density(F.col("edges"), F.col("nodes")).alias("density"), ok.alias("valid"))


def endless(edges: DataFrame) -> DataFrame:
    """The edges that remain when edges from nodes without a parent are taken off again and again: what lies on a cycle or
    below one. Their number falls every round; the count tells when it stops."""
    e = stash(edges.select("pack_id", "from_kp", "to_kp").distinct(), "peel")
    left = e.count()
    while left:
        kept = stash(e.join(e.select("pack_id", F.col("to_kp").alias("from_kp")).distinct(), ["pack_id", "from_kp"], "left_semi").select("pack_id", "from_kp", "to_kp"), "peel")
        left, before, e = kept.count(), left, kept
        if left == before:
            break
    return e


def longest_paths(edges: DataFrame, most: int = 24) -> DataFrame:
    """(pack_id, a, b, steps): all pairs with a path from a to b in an acyclic graph, and its longest length.

    By doubling: after round r all paths of up to 2^r steps are known, so the rounds are the logarithm of the longest
    path. Its pairs are the closure that was asked for. A graph with a cycle never ends and is refused."""
    e = edges.select("pack_id", F.col("from_kp").alias("a"), F.col("to_kp").alias("b")).distinct().withColumn("steps", F.lit(1))
    pairs = stash(e, "closure")
    size = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("steps"), F.lit(0))).first()
    for _ in range(most):
        on = pairs.select("pack_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("steps").alias("more"))
        longer = pairs.join(on, ["pack_id", "b"]).select("pack_id", "a", F.col("c").alias("b"), (F.col("steps") + F.col("more")).alias("steps"))
        pairs = stash(pairs.unionByName(longer).groupBy("pack_id", "a", "b").agg(F.max("steps").alias("steps")), "closure")
        now = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("steps"), F.lit(0)), F.count_if(F.col("a") == F.col("b"))).first()
        if now[2]:
            raise ValueError("the graph has a cycle")
        if now[0] == size[0] and now[1] == size[1]:
            return pairs
        size = now
    raise ValueError("a path is longer than expected")


def layers(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(pack_id, kp_id, layer, position): the longest path from any node without a parent, and the place in the order by
    layer and id, which is a topological order."""
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    d = closure.groupBy("pack_id", F.col("b").alias("kp_id")).agg(F.max("steps").alias("layer"))
    out = n.join(d, ["pack_id", "kp_id"], "left").withColumn("layer", F.coalesce("layer", F.lit(0)))
    # the place: by the number of nodes in the layers before, so a pack is ranked by layer
    size = out.groupBy("pack_id", "layer").agg(F.count(F.lit(1)).alias("k"))
    size = size.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("pack_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    place = F.row_number().over(Window.partitionBy("pack_id", "layer").orderBy("kp_id")) + F.col("before")
    return out.join(size, ["pack_id", "layer"]).select("pack_id", "kp_id", "layer", place.cast("bigint").alias("position"))


def downstream_mass(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(pack_id, kp_id, mass): how many nodes can be reached."""
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    m = closure.groupBy("pack_id", F.col("a").alias("kp_id")).agg(F.count(F.lit(1)).alias("mass"))
    return n.join(m, ["pack_id", "kp_id"], "left").withColumn("mass", F.coalesce("mass", F.lit(0)))


def critical_path(layered: DataFrame, edges: DataFrame) -> DataFrame:
    """(pack_id, kp_id, place): a longest chain of each pack: it ends at the deepest node, the first by id, and goes up to
    the first parent by id that lies one layer higher. These parents make a forest, whose paths hierarchy() finds."""
    up = edges.select("pack_id", "from_kp", "to_kp").distinct().join(layered.select("pack_id", F.col("kp_id").alias("from_kp"), F.col("layer").alias("above")), ["pack_id", "from_kp"])
    up = up.join(layered.select("pack_id", F.col("kp_id").alias("to_kp"), "layer"), ["pack_id", "to_kp"]).where("above = layer - 1")
    up = up.groupBy("pack_id", F.col("to_kp").alias("kp_id")).agg(F.min("from_kp").alias("parent"))
    tree = hierarchy(layered.select("pack_id", "kp_id").join(up, ["pack_id", "kp_id"], "left"))
    end = layered.groupBy("pack_id").agg(F.min(F.struct((-F.col("layer")).alias("l"), "kp_id")).alias("x")).select("pack_id", F.col("x.kp_id").alias("kp_id"))
    return tree.join(end, ["pack_id", "kp_id"], "left_semi").select("pack_id", F.posexplode("path").alias("place", "kp_id")).select("pack_id", "kp_id", "place")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 50, damping: float = 0.85) -> DataFrame:
    """(pack_id, kp_id, rank), summing to 1 in each pack; parallel edges count each, the rank of nodes without an edge out
    is shared by all nodes of the pack. Two sums and two joins a round; every EVERY rounds the ranks are written."""
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    size = n.groupBy("pack_id").agg(F.count(F.lit(1)).cast("double").alias("size"))
    out = edges.groupBy("pack_id", F.col("from_kp").alias("kp_id")).agg(F.count(F.lit(1)).cast("double").alias("out"))
    n = stash(n.join(size, "pack_id").join(out, ["pack_id", "kp_id"], "left"), "nodes")
    e = stash(edges.groupBy("pack_id", "from_kp", "to_kp").agg(F.count(F.lit(1)).cast("double").alias("times")), "edges")
    r = n.withColumn("rank", f.lit(1) / F.col("size"))
    for i in range(rounds):
        flow = e.join(r.select("pack_id", F.col("kp_id").alias("from_kp"), (F.col("rank") / F.col("out")).alias("each")), ["pack_id", "from_kp"])
        flow = flow.groupBy("pack_id", F.col("to_kp").alias("kp_id")).agg(F.sum(F.col("each") * F.col("times")).alias("got"))
        lost = r.groupBy("pack_id").agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(f.lit(0))).alias("lost"))
        new = (f.lit(1 - damping) + f.lit(damping) * F.col("lost")) / F.col("size") + f.lit(damping) * F.coalesce("got", f.lit(0))
        r = n.join(flow, ["pack_id", "kp_id"], "left").join(lost, "pack_id").select("pack_id", "kp_id", "size", "out", new.alias("rank"))
        if (i + 1) % EVERY == 0:
            r = stash(r, "ranks")
    return r.select("pack_id", "kp_id", "rank")


def diffusion(edges: DataFrame, seeds: DataFrame, depth: int = 6, alpha: float = 0.55) -> DataFrame:
    """(pack_id, kp_id, gain): what seeds (pack_id, kp_id, amount; within 0 to 100) bring to the nodes below: at each of
    `depth` steps alpha x weight (within 0 to 2) of what came the step before; all steps are summed. Nodes that nothing
    reaches have no row. The same pass ranks repairs when the seeds are the impacts at the children."""
    e = edges.select("pack_id", F.col("from_kp").alias("kp_id"), F.col("to_kp").alias("to"), (f.lit(alpha) * f.clamp(F.col("weight"), 0, 2)).alias("w"))
    e = stash(e, "weights")
    now = seeds.groupBy("pack_id", "kp_id").agg(F.sum("amount").alias("amount")).withColumn("amount", f.clamp(F.col("amount"), 0, 100))
    total = now
    for _ in range(depth):
        now = stash(now.join(e, ["pack_id", "kp_id"]).groupBy("pack_id", F.col("to").alias("kp_id")).agg(F.sum(F.col("amount") * F.col("w")).alias("amount")), "wave")
        total = total.unionByName(now)
    return total.groupBy("pack_id", "kp_id").agg(F.sum("amount").alias("gain"))


def learning_path(layered: DataFrame, mass: DataFrame, critical: DataFrame, ranks: DataFrame) -> DataFrame:
    """(pack_id, kp_id, layer, priority, reason, place): by layer, then by 2.5 x share of the greatest mass + 1.5 on the
    critical path + 0.8 x share of the greatest rank; reason tells which."""
    key = ["pack_id", "kp_id"]
    j = layered.join(mass, key).join(ranks, key).join(critical.select(*key, F.lit(True).alias("critical")), key, "left")
    most = j.groupBy("pack_id").agg(F.greatest(F.lit(1), F.max("mass")).alias("m"), F.max("rank").alias("r"))
    on = F.coalesce("critical", F.lit(False))
    priority = f.lit(2.5) * F.col("mass") / F.col("m") + f.lit(1.5) * on.cast("int") + f.lit(0.8) * F.col("rank") / F.col("r")
    reason = F.when(on, "critical path").when(F.col("mass") > 0, "blocks later points").otherwise("by layer")
    j = j.join(most, "pack_id").select(*key, "layer", F.round(priority, 9).alias("priority"), reason.alias("reason"), "mass")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("pack_id", "layer").orderBy(F.desc("priority"), "kp_id")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(pack_id, kp_id, types, next): the distinct neighbours out of a node, in order of (type, id), as a compressed row,
    with a bit for each type (its place in the alphabet of types, modulo 32)."""
    types = ["attach", "prerequisite", "related", "tested", "transfer_gap"]
    t = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in types]), folded(F.col("edge_type"))), F.lit(0)) - 1, F.lit(31)).cast("int")
    e = edges.where("pack_id is not null and from_kp is not null and to_kp is not null").select("pack_id", F.col("from_kp").alias("kp_id"), t.alias("type"), "to_kp").distinct()
    return e.groupBy("pack_id", "kp_id").agg(F.bit_or(F.expr("shiftleft(1L, type)")).alias("types"), F.sort_array(F.collect_list(F.struct("type", "to_kp"))).alias("next"))


def two_hop(edges: DataFrame) -> DataFrame:
    """(pack_id, kp_id, to_kp): nodes two edges away, without the node itself."""
    e = edges.select("pack_id", "from_kp", "to_kp").where("from_kp is not null and to_kp is not null").distinct()
    b = e.select("pack_id", F.col("from_kp").alias("mid"), F.col("to_kp").alias("far"))
    a = e.select("pack_id", F.col("from_kp").alias("kp_id"), F.col("to_kp").alias("mid"))
    return a.join(b, ["pack_id", "mid"]).where("kp_id <> far").select("pack_id", "kp_id", F.col("far").alias("to_kp")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pack_id, kp_id, component): the least id that can be reached over edges in either direction. Every round takes the
    least label among the neighbours and then the label of that label, so long chains close in few rounds."""
    n = nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct()
    both = edges.select("pack_id", F.explode(F.array(F.struct(F.col("from_kp").alias("a"), F.col("to_kp").alias("b")), F.struct(F.col("to_kp").alias("a"), F.col("from_kp").alias("b")))).alias("x")).select("pack_id", "x.*").distinct()
    both = stash(both, "both")
    label = stash(n.withColumn("component", F.col("kp_id")), "labels")
    while True:
        least = both.join(label.select("pack_id", F.col("kp_id").alias("b"), "component"), ["pack_id", "b"]).groupBy("pack_id", F.col("a").alias("kp_id")).agg(F.min("component").alias("near"))
        new = label.join(least, ["pack_id", "kp_id"], "left").select("pack_id", "kp_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = label.select("pack_id", F.col("kp_id").alias("component"), F.col("component").alias("further"))
        new = stash(new.join(jump, ["pack_id", "component"]).select("pack_id", "kp_id", "old", F.least("component", "further").alias("component")), "labels")
        label = new.drop("old")
        if not new.where("old <> component").limit(1).count():
            return label


def acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pack_id, from_kp, to_kp, weight): the edges without those that close cycles: as long as there is a cycle, the
    weakest edge of each pack (by weight, then by its ends) among those on or below cycles is dropped."""
    e = stash(valid_edges(nodes, edges).groupBy("pack_id", "from_kp", "to_kp").agg(F.max("weight").alias("weight")), "edges")
    key = ["pack_id", "from_kp", "to_kp"]
    turned = lambda x: x.select("pack_id", F.col("to_kp").alias("from_kp"), F.col("from_kp").alias("to_kp"))
    on, kept = e.select(*key), e
    while True:
        # what lies below a cycle only is no part of one: peel from the other side too; what was peeled stays away
        on = turned(endless(turned(endless(on))))
        weak = e.join(on, key, "left_semi").groupBy("pack_id").agg(F.min(F.struct("weight", "from_kp", "to_kp")).alias("x")).select("pack_id", "x.from_kp", "x.to_kp")
        weak = stash(weak, "weak")
        if not weak.limit(1).count():
            return kept
        kept, on = kept.join(weak, key, "left_anti").select(*key, "weight"), stash(on.join(weak, key, "left_anti"), "on")


def share_of_most(value: Column, by: str) -> Column:
    """A value over the greatest of its group, 0 if that is 0."""
    most = F.max(value).over(Window.partitionBy(by))
    return F.when(most > 0, value / most).otherwise(f.lit(0))
