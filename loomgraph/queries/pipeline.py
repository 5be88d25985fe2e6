"""The queries of the general training-data operators: features (p2), sessions (p5), hierarchies (p7)."""

from __future__ import annotations

from loomgraph.operators import features, hierarchy, sessions
from loomgraph.queries.registry import Registry
from loomgraph.runtime import WHITE_SPACE, table

R = Registry()

#: The white space of runtime.WHITE_SPACE, in DuckDB's SQL.
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
FOLD = f"lower(trim({{}}, {WS}))"
LATEST = """latest AS (
  SELECT * FROM attempts
  QUALIFY attempt_id IS NULL OR row_number() OVER (PARTITION BY attempt_id ORDER BY created_at DESC NULLS LAST, occurred_at DESC NULLS LAST, student_id DESC NULLS LAST) = 1)"""


@R.add(
    "p2_found",
    f"""WITH {LATEST},
    kps AS (SELECT {FOLD.format("kp_id")} AS k, min(kp_id) AS kp_id FROM course_kps GROUP BY 1)
    SELECT l.student_id, kps.kp_id, count(*) AS n_attempts, CAST(count(*) FILTER (l.correct) AS BIGINT) AS n_correct,
      CAST(strftime(max(l.occurred_at) AT TIME ZONE 'UTC', '%Y%m%d') AS INTEGER) AS last_day
    FROM latest l JOIN kps ON {FOLD.format("l.kp_id")} = kps.k WHERE l.student_id IS NOT NULL GROUP BY 1, 2""",
)
def p2_found(spark, d):
    return features.found(table(spark, d, "attempts"), table(spark, d, "course_kps"))


@R.add("p2_features")
def p2_features(spark, d):
    return features.entity_features(table(spark, d, "attempts"), table(spark, d, "course_kps"))


@R.add(
    "p2_dense",
    f"""WITH {LATEST}, kps AS (SELECT {FOLD.format("kp_id")} AS k, min(kp_id) AS kp_id FROM course_kps WHERE kp_id IS NOT NULL GROUP BY 1),
    st AS (SELECT student_id, count(*) AS n_attempts FROM latest WHERE student_id IS NOT NULL GROUP BY 1),
    c AS (SELECT l.student_id, kps.kp_id, count(*) AS n, count(*) FILTER (l.correct) AS c FROM latest l JOIN kps ON {FOLD.format("l.kp_id")} = kps.k WHERE l.student_id IS NOT NULL GROUP BY 1, 2)
    SELECT st.student_id, any_value(n_attempts) AS n_attempts, string_agg(coalesce(c.n, 0)::VARCHAR, ',' ORDER BY t.kp_id) AS counts, string_agg(coalesce(c.c, 0)::VARCHAR, ',' ORDER BY t.kp_id) AS right_ones
    FROM st CROSS JOIN (SELECT DISTINCT kp_id FROM course_kps WHERE kp_id IS NOT NULL) t LEFT JOIN c ON c.student_id = st.student_id AND c.kp_id = t.kp_id GROUP BY 1""",
)
def p2_dense(spark, d):
    from pyspark.sql import functions as F

    kps = table(spark, d, "course_kps")
    wide = features.entity_features(table(spark, d, "attempts"), kps)
    dense = features.dense_features(wide, kps)
    cut = lambda letter: F.array_join(F.concat(*[F.col(letter + b[1:]) for b in features.block_columns(wide)]).cast("array<string>"), ",")
    return dense.select("student_id", "n_attempts", cut("n").alias("counts"), cut("c").alias("right_ones"))


SESSIONS_SQL = f"""WITH {LATEST},
    t AS (SELECT student_id, epoch_us(occurred_at) AS t FROM latest WHERE student_id IS NOT NULL AND occurred_at IS NOT NULL),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY student_id ORDER BY t) <= {sessions.GAP_US} THEN 0 ELSE 1 END AS new FROM t),
    r AS (SELECT *, sum(new) OVER (PARTITION BY student_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g),
    s AS (SELECT student_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_attempts FROM r GROUP BY student_id, no)"""


@R.add("p5_found", f"{SESSIONS_SQL} SELECT * FROM s")
def p5_found(spark, d):
    return sessions.found(table(spark, d, "attempts"))


@R.add(
    "p5_sessions",
    f"""{SESSIONS_SQL} SELECT student_id, start_us, end_us, end_us - start_us AS duration_us, n_attempts AS n_events,
    row_number() OVER (PARTITION BY student_id ORDER BY start_us) AS session_no FROM s""",
)
def p5_sessions(spark, d):
    return sessions.numbered(sessions.attempt_sessions(table(spark, d, "attempts")))


TREE_SQL = f"""WITH RECURSIVE n AS (SELECT DISTINCT pack_id, kp_id FROM knowledge_nodes WHERE pack_id IS NOT NULL AND kp_id IS NOT NULL),
    e AS (SELECT x.pack_id, to_kp AS kp_id, min(from_kp) AS parent FROM knowledge_edges x
      JOIN n a ON a.pack_id = x.pack_id AND a.kp_id = x.from_kp JOIN n b ON b.pack_id = x.pack_id AND b.kp_id = x.to_kp
      WHERE {FOLD.format("edge_type")} = 'prerequisite' AND from_kp <> to_kp GROUP BY 1, 2),
    t AS (SELECT n.pack_id, n.kp_id, n.kp_id AS root_kp, 0 AS depth, [n.kp_id] AS path FROM n ANTI JOIN e ON n.pack_id = e.pack_id AND n.kp_id = e.kp_id
      UNION ALL SELECT e.pack_id, e.kp_id, t.root_kp, t.depth + 1, list_append(t.path, e.kp_id) FROM t JOIN e ON e.pack_id = t.pack_id AND e.parent = t.kp_id)"""


@R.add(
    "p7_found",
    f"""{TREE_SQL} SELECT n.pack_id, n.kp_id, coalesce(root_kp, '') AS root_kp, CAST(coalesce(depth, -1) AS INTEGER) AS depth
    FROM n LEFT JOIN t ON n.pack_id = t.pack_id AND n.kp_id = t.kp_id""",
)
def p7_found(spark, d):
    return hierarchy.found(table(spark, d, "knowledge_nodes"), table(spark, d, "knowledge_edges"))


def _tree(spark, d):
    p = hierarchy.parent_pointers(table(spark, d, "knowledge_nodes"), table(spark, d, "knowledge_edges"))
    return p, hierarchy.hierarchy(p)


@R.add(
    "p7_paths",
    f"""{TREE_SQL} SELECT n.pack_id, n.kp_id, array_to_string(path, '>') AS path FROM n LEFT JOIN t ON n.pack_id = t.pack_id AND n.kp_id = t.kp_id""",
)
def p7_paths(spark, d):
    from pyspark.sql import functions as F

    return _tree(spark, d)[1].select("pack_id", "kp_id", F.array_join("path", ">").alias("path"))


@R.add(
    "p7_descendants",
    f"""{TREE_SQL} SELECT pack_id, path[i] AS kp_id, kp_id AS descendant, CAST(depth + 1 - i AS INTEGER) AS distance
    FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM t)""",
)
def p7_descendants(spark, d):
    return hierarchy.descendants(_tree(spark, d)[1])


@R.add(
    "p7_parents",
    f"""WITH n AS (SELECT DISTINCT pack_id, kp_id FROM knowledge_nodes WHERE pack_id IS NOT NULL AND kp_id IS NOT NULL)
    SELECT x.pack_id, to_kp AS kp_id, count(DISTINCT from_kp) AS n_parents FROM knowledge_edges x
    JOIN n a ON a.pack_id = x.pack_id AND a.kp_id = x.from_kp JOIN n b ON b.pack_id = x.pack_id AND b.kp_id = x.to_kp
    WHERE {FOLD.format("edge_type")} = 'prerequisite' AND from_kp <> to_kp GROUP BY 1, 2 HAVING count(DISTINCT from_kp) > 1""",
)
def p7_parents(spark, d):
    return hierarchy.several_parents(table(spark, d, "knowledge_nodes"), table(spark, d, "knowledge_edges"))


@R.add(
    "p7_cycles",
    f"""{TREE_SQL}, lost AS (SELECT e.* FROM e ANTI JOIN t ON e.pack_id = t.pack_id AND e.kp_id = t.kp_id),
    w AS (SELECT pack_id, kp_id, parent AS spot FROM lost UNION SELECT w.pack_id, w.kp_id, lost.parent FROM w JOIN lost ON lost.pack_id = w.pack_id AND lost.kp_id = w.spot)
    SELECT w.pack_id, w.kp_id, min(w.spot) AS cycle FROM w JOIN (SELECT pack_id, kp_id FROM w WHERE kp_id = spot) o ON o.pack_id = w.pack_id AND o.kp_id = w.kp_id GROUP BY 1, 2""",
)
def p7_cycles(spark, d):
    return hierarchy.cycles(*_tree(spark, d))
