"""Queries of graph operators over knowledge_nodes and knowledge_edges, each with its SQL.

The tables' edges hold cycles. Where an acyclic graph is asked for, the edges of all types are turned from the lesser to
the greater kp_id, which gives one with several parents a node.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graphs as g
from loomgraph.queries.pipeline import FOLD
from loomgraph.queries.registry import Registry
from loomgraph.runtime import stash, table

R = Registry()
NODES = "n AS (SELECT DISTINCT pack_id, kp_id FROM knowledge_nodes WHERE pack_id IS NOT NULL AND kp_id IS NOT NULL)"
VALID = f"""WITH RECURSIVE {NODES}, v AS (SELECT e.* FROM knowledge_edges e JOIN n a ON a.pack_id = e.pack_id AND a.kp_id = e.from_kp JOIN n b ON b.pack_id = e.pack_id AND b.kp_id = e.to_kp WHERE from_kp <> to_kp)"""
DAG = f"""{VALID}, e AS (SELECT pack_id, least(from_kp, to_kp) AS a, greatest(from_kp, to_kp) AS b, max(weight) AS weight FROM v GROUP BY 1, 2, 3)"""
LAYERS = f"""{DAG}, w AS (SELECT pack_id, kp_id, 0 AS layer FROM n UNION SELECT e.pack_id, e.b, w.layer + 1 FROM w JOIN e ON e.pack_id = w.pack_id AND e.a = w.kp_id),
  ly AS (SELECT pack_id, kp_id, max(layer) AS layer FROM w GROUP BY 1, 2)"""
CLOSURE = "cl AS (SELECT pack_id, a, b FROM e UNION SELECT cl.pack_id, cl.a, e.b FROM cl JOIN e ON e.pack_id = cl.pack_id AND e.a = cl.b)"
CRITICAL = """up AS (SELECT e.pack_id, e.b AS kp_id, min(e.a) AS parent FROM e JOIN ly x ON x.pack_id = e.pack_id AND x.kp_id = e.a JOIN ly y ON y.pack_id = e.pack_id AND y.kp_id = e.b WHERE x.layer = y.layer - 1 GROUP BY 1, 2),
  ends AS (SELECT pack_id, kp_id, layer FROM ly QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY layer DESC, kp_id) = 1),
  cp AS (SELECT pack_id, kp_id, layer AS place FROM ends UNION ALL SELECT up.pack_id, up.parent, cp.place - 1 FROM cp JOIN up ON up.pack_id = cp.pack_id AND up.kp_id = cp.kp_id)"""
RANK = """sz AS (SELECT pack_id, count(*)::DOUBLE AS size FROM n GROUP BY 1), deg AS (SELECT pack_id, a, count(*) AS o FROM e GROUP BY 1, 2),
  mx AS (SELECT e.pack_id, e.a, e.b, 1.0::DOUBLE / o AS p FROM e JOIN deg ON deg.pack_id = e.pack_id AND deg.a = e.a UNION ALL
    SELECT n.pack_id, n.kp_id, m.kp_id, 1 / size FROM n JOIN sz ON sz.pack_id = n.pack_id JOIN n m ON m.pack_id = n.pack_id WHERE NOT EXISTS (SELECT 1 FROM deg WHERE deg.pack_id = n.pack_id AND deg.a = n.kp_id)),
  tel AS (SELECT a.pack_id, a.kp_id AS a, b.kp_id AS b, 0.15::DOUBLE / size AS p FROM n a JOIN n b ON b.pack_id = a.pack_id JOIN sz ON sz.pack_id = a.pack_id),
  mat AS (SELECT pack_id, a, b, sum(p) AS p FROM (SELECT pack_id, a, b, 0.85::DOUBLE * p AS p FROM mx UNION ALL SELECT * FROM tel) GROUP BY 1, 2, 3),
  pr AS (SELECT n.pack_id, n.kp_id, 1 / size AS r, 0 AS it FROM n JOIN sz ON sz.pack_id = n.pack_id
    UNION ALL SELECT mat.pack_id, mat.b, sum(pr.r * mat.p), pr.it + 1 FROM pr JOIN mat ON mat.pack_id = pr.pack_id AND mat.a = pr.kp_id WHERE pr.it < 50 GROUP BY mat.pack_id, mat.b, pr.it)"""


def _tables(spark, d):
    return table(spark, d, "knowledge_nodes"), table(spark, d, "knowledge_edges")


def _dag(spark, d):
    nodes, edges = _tables(spark, d)
    v = g.valid_edges(nodes, edges).groupBy("pack_id", F.least("from_kp", "to_kp").alias("a"), F.greatest("from_kp", "to_kp").alias("b")).agg(F.max("weight").alias("weight"))
    return nodes, stash(v.select("pack_id", F.col("a").alias("from_kp"), F.col("b").alias("to_kp"), "weight"), "dag")


@R.add("graph_edges", f"{VALID} SELECT pack_id, from_kp, to_kp, {FOLD.format('edge_type')} AS edge_type, weight, count(*) AS copies FROM v GROUP BY 1, 2, 3, 4, 5")
def graph_edges(spark, d):
    from loomgraph.operators.attempts import folded

    v = g.valid_edges(*_tables(spark, d)).withColumn("edge_type", folded(F.col("edge_type")))
    return v.groupBy("pack_id", "from_kp", "to_kp", "edge_type", "weight").agg(F.count(F.lit(1)).alias("copies"))


@R.add(
    "graph_strongest",
    f"""WITH t AS (SELECT *, {FOLD.format('edge_type')} AS t FROM knowledge_edges WHERE pack_id IS NOT NULL AND from_kp IS NOT NULL AND to_kp IS NOT NULL AND from_kp <> to_kp)
    SELECT pack_id, least(from_kp, to_kp) AS a, greatest(from_kp, to_kp) AS b, from_kp, to_kp, t AS edge_type, coalesce(weight, 0) AS weight FROM t
    QUALIFY row_number() OVER (PARTITION BY pack_id, least(from_kp, to_kp), greatest(from_kp, to_kp) ORDER BY CASE t WHEN 'prerequisite' THEN 1 WHEN 'transfer_gap' THEN 2 WHEN 'related' THEN 3 WHEN 'tested' THEN 4 WHEN 'attach' THEN 5 ELSE 6 END, coalesce(weight, 0) DESC, from_kp, to_kp) = 1""",
)
def graph_strongest(spark, d):
    return g.strongest_edges(table(spark, d, "knowledge_edges"))


@R.add(
    "graph_degrees",
    f"""{VALID} SELECT n.pack_id, n.kp_id, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out, round(sqrt(coalesce(i, 0)::DOUBLE * coalesce(o, 0)) + 0.25 * (coalesce(i, 0) + coalesce(o, 0)), 6) AS hub FROM n
    LEFT JOIN (SELECT pack_id, to_kp, count(*) AS i FROM v GROUP BY 1, 2) x ON x.pack_id = n.pack_id AND x.to_kp = n.kp_id LEFT JOIN (SELECT pack_id, from_kp, count(*) AS o FROM v GROUP BY 1, 2) y ON y.pack_id = n.pack_id AND y.from_kp = n.kp_id""",
)
def graph_degrees(spark, d):
    return g.degrees(*_tables(spark, d)).withColumn("hub", F.round("hub", 6))


@R.add(
    "graph_report",
    f"""WITH {NODES}, e AS (SELECT x.pack_id, count(*) AS edges, count(*) FILTER (weight IS NULL OR weight <= 0 OR weight > 2) AS bad_weight, count(*) FILTER (source IS NULL OR trim(source) = '') AS bad_source, count(*) FILTER (a.kp_id IS NULL OR b.kp_id IS NULL) AS bad_end
    FROM knowledge_edges x LEFT JOIN n a ON a.pack_id = x.pack_id AND a.kp_id = x.from_kp LEFT JOIN n b ON b.pack_id = x.pack_id AND b.kp_id = x.to_kp WHERE x.pack_id IS NOT NULL GROUP BY 1), s AS (SELECT pack_id, count(*) AS nodes FROM n GROUP BY 1)
    SELECT s.pack_id, nodes, coalesce(edges, 0) AS edges, coalesce(bad_weight, 0) AS bad_weight, coalesce(bad_source, 0) AS bad_source, coalesce(bad_end, 0) AS bad_end, round(CASE WHEN nodes > 1 THEN coalesce(edges, 0) / (nodes::DOUBLE * (nodes - 1)) ELSE 0 END, 9) AS density,
    nodes >= 30 AND coalesce(edges, 0) >= 40 AND coalesce(bad_weight + bad_source + bad_end, 0) = 0 AS valid FROM s LEFT JOIN e ON e.pack_id = s.pack_id""",
)
def graph_report(spark, d):
    return g.pack_report(*_tables(spark, d)).withColumn("density", F.round("density", 9))


@R.add("graph_sources", f"{VALID} SELECT pack_id, kp_id FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pack_id = n.pack_id AND v.to_kp = n.kp_id)")
def graph_sources(spark, d):
    nodes, edges = _tables(spark, d)
    v = g.valid_edges(nodes, edges).select("pack_id", F.col("to_kp").alias("kp_id"))
    return nodes.select("pack_id", "kp_id").where("pack_id is not null and kp_id is not null").distinct().join(v, ["pack_id", "kp_id"], "left_anti")


@R.add("graph_layers", f"{LAYERS} SELECT pack_id, kp_id, layer, row_number() OVER (PARTITION BY pack_id ORDER BY layer, kp_id) AS position FROM ly")
def graph_layers(spark, d):
    nodes, e = _dag(spark, d)
    return g.layers(nodes, g.longest_paths(e))


@R.add("graph_mass", f"{DAG}, {CLOSURE} SELECT n.pack_id, n.kp_id, count(cl.b) AS mass FROM n LEFT JOIN cl ON cl.pack_id = n.pack_id AND cl.a = n.kp_id GROUP BY 1, 2")
def graph_mass(spark, d):
    nodes, e = _dag(spark, d)
    return g.downstream_mass(nodes, g.longest_paths(e))


@R.add("graph_critical", f"{LAYERS}, {CRITICAL} SELECT pack_id, kp_id, place::INT AS place FROM cp")
def graph_critical(spark, d):
    nodes, e = _dag(spark, d)
    return g.critical_path(g.layers(nodes, g.longest_paths(e)), e)


@R.add("graph_pagerank", f"{DAG}, {RANK} SELECT pack_id, kp_id, round(r, 9) AS rank FROM pr WHERE it = 50")
def graph_pagerank(spark, d):
    return g.pagerank(*_dag(spark, d)).withColumn("rank", F.round("rank", 9))


@R.add(
    "graph_diffusion",
    f"""{DAG}, ws AS (SELECT pack_id, a, b, 0.55::DOUBLE * least(2, greatest(0, weight)) AS w FROM e), seeds AS (SELECT pack_id, min(kp_id) AS kp_id FROM n GROUP BY 1),
    df AS (SELECT pack_id, kp_id, 20.0::DOUBLE AS amount, 0 AS it FROM seeds UNION ALL SELECT ws.pack_id, ws.b, sum(df.amount * ws.w), df.it + 1 FROM df JOIN ws ON ws.pack_id = df.pack_id AND ws.a = df.kp_id WHERE df.it < 6 GROUP BY ws.pack_id, ws.b, df.it)
    SELECT pack_id, kp_id, round(sum(amount), 6) AS gain FROM df GROUP BY 1, 2""",
)
def graph_diffusion(spark, d):
    nodes, e = _dag(spark, d)
    seeds = nodes.where("kp_id is not null and pack_id is not null").groupBy("pack_id").agg(F.min("kp_id").alias("kp_id")).withColumn("amount", F.lit(20.0))
    return g.diffusion(e, seeds).withColumn("gain", F.round("gain", 6))


@R.add(
    "graph_learning_path",
    f"""{LAYERS}, {CLOSURE}, {CRITICAL}, {RANK}, ms AS (SELECT n.pack_id, n.kp_id, count(cl.b) AS mass FROM n LEFT JOIN cl ON cl.pack_id = n.pack_id AND cl.a = n.kp_id GROUP BY 1, 2),
    q AS (SELECT ly.pack_id, ly.kp_id, layer, mass, cp.kp_id IS NOT NULL AS crit, 2.5::DOUBLE * mass / greatest(1, max(mass) OVER (PARTITION BY ly.pack_id)) + CASE WHEN cp.kp_id IS NOT NULL THEN 1.5::DOUBLE ELSE 0 END + 0.8::DOUBLE * r / max(r) OVER (PARTITION BY ly.pack_id) AS p
      FROM ly JOIN ms ON ms.pack_id = ly.pack_id AND ms.kp_id = ly.kp_id JOIN pr ON pr.pack_id = ly.pack_id AND pr.kp_id = ly.kp_id AND pr.it = 50 LEFT JOIN cp ON cp.pack_id = ly.pack_id AND cp.kp_id = ly.kp_id)
    SELECT pack_id, kp_id, layer, round(p, 6) AS priority, CASE WHEN crit THEN 'critical path' WHEN mass > 0 THEN 'blocks later points' ELSE 'by layer' END AS reason, row_number() OVER (PARTITION BY pack_id, layer ORDER BY round(p, 9) DESC, kp_id)::INT AS place FROM q""",
)
def graph_learning_path(spark, d):
    nodes, e = _dag(spark, d)
    closure = g.longest_paths(e)
    layered = stash(g.layers(nodes, closure), "layers")
    p = g.learning_path(layered, g.downstream_mass(nodes, closure), g.critical_path(layered, e), g.pagerank(nodes, e))
    return p.select("pack_id", "kp_id", "layer", F.round("priority", 6).alias("priority"), "reason", "place")


@R.add(
    "graph_neighbours",
    f"""WITH x AS (SELECT DISTINCT pack_id, from_kp AS kp_id, to_kp, coalesce(list_position(['attach', 'prerequisite', 'related', 'tested', 'transfer_gap'], {FOLD.format('edge_type')}) - 1, 31) AS type FROM knowledge_edges WHERE pack_id IS NOT NULL AND from_kp IS NOT NULL AND to_kp IS NOT NULL)
    SELECT pack_id, kp_id, bit_or(1::BIGINT << type::INT) AS types, string_agg(type || ':' || to_kp, ',' ORDER BY type, to_kp) AS next FROM x GROUP BY 1, 2""",
)
def graph_neighbours(spark, d):
    return g.neighbours(table(spark, d, "knowledge_edges")).withColumn("next", F.array_join(F.transform("next", lambda x: F.concat(x["type"].cast("string"), F.lit(":"), x["to_kp"])), ","))


@R.add("graph_two_hop", f"{VALID} SELECT DISTINCT x.pack_id, x.from_kp AS kp_id, y.to_kp FROM v x JOIN v y ON y.pack_id = x.pack_id AND y.from_kp = x.to_kp WHERE x.from_kp <> y.to_kp")
def graph_two_hop(spark, d):
    return g.two_hop(g.valid_edges(*_tables(spark, d)))


@R.add(
    "graph_components",
    f"""{VALID}, b AS (SELECT pack_id, from_kp AS a, to_kp AS b FROM v UNION SELECT pack_id, to_kp, from_kp FROM v), r AS (SELECT pack_id, kp_id, kp_id AS t FROM n UNION SELECT r.pack_id, r.kp_id, b.b FROM r JOIN b ON b.pack_id = r.pack_id AND b.a = r.t)
    SELECT pack_id, kp_id, min(t) AS component FROM r GROUP BY 1, 2""",
)
def graph_components(spark, d):
    nodes, edges = _tables(spark, d)
    return g.components(nodes, g.valid_edges(nodes, edges))


@R.add("graph_acyclic")
def graph_acyclic(spark, d):
    from loomgraph.operators.attempts import folded

    nodes, edges = _tables(spark, d)
    return g.acyclic(nodes, edges.where(folded(F.col("edge_type")) == "prerequisite"))
