"""Queries of streams and of sources, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.queries.learning import GRADED
from loomgraph.queries.registry import Registry
from loomgraph.runtime import stash_path, table
from loomgraph.sources import files
from loomgraph.streaming import attempts as s

R = Registry()
#: Attempts as the stream takes them: an attempt_id counts once.
ONCE = "u AS (SELECT attempt_id, min(student_id) AS student_id, min(kp_id) AS kp_id, min(occurred_at) AS occurred_at, bool_and(correct) AS correct FROM attempts WHERE attempt_id IS NOT NULL AND student_id IS NOT NULL AND correct IS NOT NULL AND occurred_at IS NOT NULL GROUP BY 1)"


def _once(spark, d):
    """The attempts, each id once, as files that a stream can read."""
    a = table(spark, d, "attempts").where("attempt_id is not null and student_id is not null and correct is not null and occurred_at is not null")
    a = a.groupBy("attempt_id").agg(F.min("student_id").alias("student_id"), F.min("kp_id").alias("kp_id"), F.min("occurred_at").alias("occurred_at"), F.bool_and("correct").alias("correct"))
    path = stash_path(spark, "attempts")
    a.write.parquet(path)
    return s.read_stream(spark, path)


@R.add("stream_daily", f"WITH {ONCE} SELECT student_id, epoch_us(date_trunc('day', occurred_at AT TIME ZONE 'UTC')) AS day_us, count(*) AS n, sum(correct::INT)::BIGINT AS \"right\" FROM u GROUP BY 1, 2")
def stream_daily(spark, d):
    return s.drain(s.daily(_once(spark, d)), ["student_id", "day_us"], mode="complete")


@R.add("stream_sliding", f"WITH {ONCE} SELECT kp_id, epoch_us(date_trunc('day', occurred_at AT TIME ZONE 'UTC')) - k * 86400000000 AS start_us, count(*) AS n FROM u, unnest(range(0, 7)) AS r(k) WHERE kp_id IS NOT NULL GROUP BY 1, 2")
def stream_sliding(spark, d):
    return s.drain(s.sliding(_once(spark, d)), ["kp_id", "start_us"], mode="complete")


@R.add(
    "stream_sessions",
    f"""WITH {ONCE}, t AS (SELECT student_id, epoch_us(occurred_at) AS t FROM u), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY student_id ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS new FROM t),
    r AS (SELECT *, sum(new) OVER (PARTITION BY student_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT student_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM r GROUP BY student_id, no""",
)
def stream_sessions(spark, d):
    return s.drain(s.sessions(_once(spark, d)), ["student_id", "start_us"], mode="complete")


@R.add(
    "stream_moving",
    f"""WITH RECURSIVE {ONCE}, i AS (SELECT *, row_number() OVER (PARTITION BY student_id, kp_id ORDER BY occurred_at, attempt_id) AS i, count(*) OVER (PARTITION BY student_id, kp_id) AS n FROM u WHERE kp_id IS NOT NULL),
    w AS (SELECT student_id, kp_id, i, n, CASE WHEN correct THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS acc, CASE WHEN correct THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS sev, correct::INT AS streak FROM i WHERE i = 1
      UNION ALL SELECT i.student_id, i.kp_id, i.i, i.n, (9 * w.acc + i.correct::INT) / 10, least(1, w.sev * CASE WHEN i.correct THEN 0.9::DOUBLE ELSE 1.05::DOUBLE END), CASE WHEN i.correct THEN w.streak + 1 ELSE 0 END FROM w JOIN i ON i.student_id = w.student_id AND i.kp_id = w.kp_id AND i.i = w.i + 1)
    SELECT student_id, kp_id, round(acc, 6) AS acc, round(sev, 6) AS sev, streak::BIGINT AS streak, n FROM w WHERE i = n""",
)
def stream_moving(spark, d):
    m = s.drain(s.moving(_once(spark, d)), ["student_id", "kp_id"], "n", "update")
    return m.select("student_id", "kp_id", F.round("acc", 6).alias("acc"), F.round("sev", 6).alias("sev"), "streak", "n")


@R.add("source_pack_files", "SELECT DISTINCT pack_id, from_kp, to_kp, edge_type, weight, source FROM knowledge_edges WHERE pack_id IS NOT NULL")
def source_pack_files(spark, d):
    e = table(spark, d, "knowledge_edges").where("pack_id is not null").distinct()
    path = stash_path(spark, "packs")
    files.export_json(e, path)
    r = spark.read.schema("pack_id string, from_kp string, to_kp string, edge_type string, weight double, source string").json(path)
    return r


@R.add("source_json_lines", "SELECT kp_id, min(kp_name) AS kp_name FROM course_kps WHERE kp_id IS NOT NULL GROUP BY 1")
def source_json_lines(spark, d):
    k = table(spark, d, "course_kps").where("kp_id is not null").groupBy("kp_id").agg(F.min("kp_name").alias("kp_name"))
    path = stash_path(spark, "lines")
    # an older row of each key and a line that can't be read stand before each row
    k.select(F.concat(F.lit('{"kp_id": "'), "kp_id", F.lit('", "kp_name": "older"}\n{broken\n'), F.to_json(F.struct("kp_id", "kp_name"))).alias("value")).write.text(path)
    return files.json_lines(spark, path, "kp_id string, kp_name string", ["kp_id"])


@R.add("source_joined_parts", "WITH c AS (SELECT doc_id, idx, max(text) AS text FROM kb_chunks WHERE doc_id IS NOT NULL AND idx IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2) SELECT doc_id AS upload_id, string_agg(text, '' ORDER BY idx) AS text, count(*) AS n_parts FROM c GROUP BY 1")
def source_joined_parts(spark, d):
    return files.joined_parts(table(spark, d, "kb_chunks").select(F.col("doc_id").alias("upload_id"), "idx", F.col("text").alias("part")))


@R.add("source_upserted", "SELECT id, epoch_us(updated_at) AS updated_us, body FROM kb_documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, body DESC NULLS LAST) = 1")
def source_upserted(spark, d):
    k = table(spark, d, "kb_documents").where("id is not null").groupBy("id", "updated_at").agg(F.max("body").alias("body"))
    older = F.pmod(F.xxhash64("id", "updated_at"), F.lit(2)) == 0
    return files.upserted(k.where(older), k.where(~older), ["id"], "updated_at").select("id", F.unix_micros("updated_at").alias("updated_us"), "body")


@R.add("source_not_cached", "SELECT DISTINCT doc_path, page_no, sha1(doc_path || '|' || page_no) AS key FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL AND page_no % 3 <> 0")
def source_not_cached(spark, d):
    p = table(spark, d, "page_extracts").select("doc_path", "page_no").where("doc_path is not null and page_no is not null").distinct()
    cache = p.where("page_no % 3 = 0").select(F.sha1(F.concat_ws("|", "doc_path", F.col("page_no").cast("string"))).alias("key"))
    return files.not_cached(p, cache, ["doc_path", "page_no"]).select("doc_path", "page_no", "key")
