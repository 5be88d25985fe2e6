"""Queries of sets, votes, choices and formats, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.functions import text as t
from loomgraph.operators import reports
from loomgraph.operators.attempts import folded
from loomgraph.queries.learning import LINKS, _debts, _mastery, r6
from loomgraph.queries.pipeline import FOLD
from loomgraph.queries.registry import Registry
from loomgraph.queries.reported import JOINED
from loomgraph.queries.texted import WIDE
from loomgraph.runtime import bounded_broadcast, table

R = Registry()


@R.add("name_edit_rates", "WITH n AS (SELECT course, kp_id, min(kp_name) AS ok FROM course_kps WHERE kp_id IS NOT NULL AND length(kp_name) > 0 AND NOT regexp_matches(kp_name, '[^ -~]') GROUP BY 1, 2), x AS (SELECT *, lead(ok) OVER (PARTITION BY course ORDER BY kp_id) AS found FROM n) SELECT kp_id, round(levenshtein(found, ok)::DOUBLE / length(ok), 6) AS rate FROM x WHERE found IS NOT NULL")
def name_edit_rates(spark, d):
    n = table(spark, d, "course_kps").where("kp_id is not null and length(kp_name) > 0 and not kp_name rlike '[^ -~]'").groupBy("course", "kp_id").agg(F.min("kp_name").alias("ok"))
    x = n.withColumn("found", F.lead("ok").over(Window.partitionBy("course").orderBy("kp_id"))).where("found is not null")
    return x.select("kp_id", r6(t.error_rate(F.col("found"), F.col("ok"))).alias("rate"))


@R.add("exam_sections", "SELECT paper_id, coalesce(section_title, '(none)') AS section, count(DISTINCT item_id) AS items FROM exam_items WHERE paper_id IS NOT NULL GROUP BY 1, 2")
def exam_sections(spark, d):
    e = table(spark, d, "exam_items").where("paper_id is not null and item_id is not null").select("paper_id", F.coalesce("section_title", F.lit("(none)")).alias("section"), "item_id").distinct()
    return e.groupBy("paper_id", "section").agg(F.count(F.lit(1)).alias("items"))


@R.add(
    "exam_overlap",
    """WITH x AS (SELECT DISTINCT item_id, list_sort(list_distinct(list_filter(coalesce(kps, []), lambda k: k IS NOT NULL))) AS k, paper_id, item_no FROM exam_items WHERE item_id IS NOT NULL), o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY array_to_string(k, ','), item_no) = 1),
    n AS (SELECT item_id, k, lead(k) OVER (PARTITION BY paper_id ORDER BY item_no, item_id) AS nk FROM o WHERE paper_id IS NOT NULL)
    SELECT item_id, round(CASE WHEN len(list_distinct(list_concat(k, nk))) > 0 THEN len(list_intersect(k, nk))::DOUBLE / len(list_distinct(list_concat(k, nk))) ELSE 0 END, 6) AS jaccard FROM n WHERE nk IS NOT NULL""",
)
def exam_overlap(spark, d):
    k = F.array_sort(F.array_distinct(F.filter(F.coalesce("kps", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    x = table(spark, d, "exam_items").where("item_id is not null").select("item_id", k.alias("k"), "paper_id", "item_no").distinct()
    o = x.groupBy("item_id").agg(F.min(F.struct(F.array_join("k", ",").alias("s"), "item_no", "k", "paper_id")).alias("x")).select("item_id", "x.*").where("paper_id is not null")
    n = o.withColumn("nk", F.lead("k").over(Window.partitionBy("paper_id").orderBy("item_no", "item_id"))).where("nk is not null")
    union = F.size(F.array_union("k", "nk"))
    return n.select("item_id", F.when(union > 0, F.round(F.size(F.array_intersect("k", "nk")) / union, 6)).otherwise(0.0).alias("jaccard"))


@R.add("shared_points", f"SELECT {FOLD.format('kp_id')} AS k FROM attempts WHERE kp_id IS NOT NULL INTERSECT SELECT {FOLD.format('x')} FROM (SELECT unnest(kps) AS x FROM exam_items) WHERE x IS NOT NULL INTERSECT SELECT {FOLD.format('kp_id')} FROM knowledge_nodes WHERE kp_id IS NOT NULL")
def shared_points(spark, d):
    a = table(spark, d, "attempts").where("kp_id is not null").select(folded(F.col("kp_id")).alias("k"))
    e = table(spark, d, "exam_items").select(F.explode("kps").alias("x")).where("x is not null").select(folded(F.col("x")).alias("k"))
    n = table(spark, d, "knowledge_nodes").where("kp_id is not null").select(folded(F.col("kp_id")).alias("k"))
    return a.intersect(e).intersect(n)


@R.add("unknown_points", f"SELECT DISTINCT {FOLD.format('kp_id')} AS k FROM attempts WHERE kp_id IS NOT NULL AND {FOLD.format('kp_id')} NOT IN (SELECT {FOLD.format('kp_id')} FROM course_kps WHERE kp_id IS NOT NULL)")
def unknown_points(spark, d):
    known = bounded_broadcast(table(spark, d, "course_kps").where("kp_id is not null").select(folded(F.col("kp_id")).alias("k")).distinct())
    return table(spark, d, "attempts").where("kp_id is not null").select(folded(F.col("kp_id")).alias("k")).distinct().join(known, "k", "left_anti")


@R.add(
    "target_pages",
    """WITH p AS (SELECT doc_path, page_no, max(coalesce(length(text), 0)) AS chars, bool_or(ocr_used) AS used FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL GROUP BY 1, 2), m AS (SELECT doc_path, quantile_cont(chars::DOUBLE, 0.5) AS m FROM p WHERE chars >= 60 GROUP BY 1 HAVING count(*) >= 3)
    SELECT doc_path, page_no FROM p WHERE used UNION SELECT p.doc_path, page_no FROM p JOIN m ON m.doc_path = p.doc_path WHERE chars < greatest(20, 0.4::DOUBLE * m) UNION SELECT doc_path, min(page_no) FROM p GROUP BY 1""",
)
def target_pages(spark, d):
    p = table(spark, d, "page_extracts")
    known = p.where("doc_path is not null and page_no is not null")
    used = known.where("ocr_used").select("doc_path", "page_no")
    return used.unionByName(reports.weak_pages(p).select("doc_path", "page_no")).unionByName(known.groupBy("doc_path").agg(F.min("page_no").alias("page_no"))).distinct()


@R.add(
    "garbled_pages",
    """WITH p AS (SELECT doc_path, page_no, min(text) AS text FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2), l AS (SELECT doc_path, page_no, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 4)) AS x FROM p),
    g AS (SELECT doc_path, page_no, count(*) AS n_lines, count(*) FILTER (length(regexp_replace(x, '[\\p{L}\\p{N}\\s]', '', 'g'))::DOUBLE / length(x) > 0.25) AS odd FROM l GROUP BY 1, 2) SELECT doc_path, page_no, n_lines, odd FROM g WHERE odd::DOUBLE / n_lines >= 0.1""",
)
def garbled_pages(spark, d):
    p = table(spark, d, "page_extracts").where("doc_path is not null and page_no is not null and text is not null").groupBy("doc_path", "page_no").agg(F.min("text").alias("text"))
    kept = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 4)
    odd = F.filter(kept, lambda x: F.length(F.regexp_replace(x, r"[\p{L}\p{N}\s]", "")) / F.length(x) > 0.25)
    g = p.select("doc_path", "page_no", F.size(kept).cast("bigint").alias("n_lines"), F.size(odd).cast("bigint").alias("odd"))
    return g.where("n_lines > 0 and odd / n_lines >= 0.1")


@R.add(
    "stem_votes",
    f"""WITH s AS (SELECT DISTINCT item_id, stem, md5(replace(trim(regexp_replace({WIDE}, '[ \\t\\r\\n]+', ' ', 'g')), ' ', '')) AS form FROM exam_items WHERE item_id IS NOT NULL AND stem <> ''), v AS (SELECT form, stem, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT form, count(DISTINCT item_id) AS items FROM s GROUP BY 1 HAVING count(DISTINCT item_id) >= 2)
    SELECT v.form, stem AS best, n AS votes, items FROM v JOIN k ON k.form = v.form QUALIFY row_number() OVER (PARTITION BY v.form ORDER BY n DESC, stem) = 1""",
)
def stem_votes(spark, d):
    s = table(spark, d, "exam_items").where("item_id is not null and stem <> ''").select("item_id", "stem", F.md5(t.vote_key(F.col("stem"))).alias("form")).distinct()
    k = s.select("form", "item_id").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("items")).where("items >= 2")
    best = s.groupBy("form", "stem").agg(F.count(F.lit(1)).alias("n")).groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("m"), "stem")).alias("x"))
    return best.join(k, "form").select("form", F.col("x.stem").alias("best"), (-F.col("x.m")).alias("votes"), "items")


@R.add(
    "concept_resolution",
    f"""WITH c AS (SELECT lower(regexp_replace(kp_name, ' \\d+$', '')) AS term, min(kp_id) AS kp_id FROM course_kps WHERE kp_id IS NOT NULL AND kp_name IS NOT NULL GROUP BY 1), u AS (SELECT DISTINCT kp_id AS id, lower(description) AS x FROM course_kps WHERE description IS NOT NULL AND kp_id IS NOT NULL)
    SELECT id, c.kp_id, term FROM u JOIN c ON contains(x, term) QUALIFY row_number() OVER (PARTITION BY id, x ORDER BY x = term DESC, length(term) DESC, term) = 1""",
)
def concept_resolution(spark, d):
    k = table(spark, d, "course_kps")
    c = k.where("kp_id is not null and kp_name is not null").groupBy(F.lower(F.regexp_replace("kp_name", r" \d+$", "")).alias("term")).agg(F.min("kp_id").alias("kp_id"))
    u = k.where("description is not null and kp_id is not null").select(F.col("kp_id").alias("id"), F.lower("description").alias("x")).distinct()
    j = u.join(bounded_broadcast(c, 10_000), F.col("x").contains(F.col("term")))
    best = j.groupBy("id", "x").agg(F.min(F.struct((F.col("x") != F.col("term")).alias("other"), (-F.length("term")).alias("l"), "term", "kp_id")).alias("b"))
    return best.select("id", F.col("b.kp_id").alias("kp_id"), F.col("b.term").alias("term"))


@R.add("best_extraction", f"""WITH p AS (SELECT doc_path, page_no, min(text) AS text FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL GROUP BY 1, 2), {JOINED}, q AS (SELECT p.doc_path, p.page_no, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS a, length(regexp_replace(coalesce(joined, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS b FROM p LEFT JOIN jp ON jp.doc_path = p.doc_path AND jp.page_no = p.page_no)
    SELECT doc_path, page_no, CASE WHEN b > 1.25 * a THEN 'joined' ELSE 'page' END AS source, greatest(a, CASE WHEN b > 1.25 * a THEN b ELSE a END)::INT AS readable FROM q""")
def best_extraction(spark, d):
    p = table(spark, d, "page_extracts").where("doc_path is not null and page_no is not null").groupBy("doc_path", "page_no").agg(F.min("text").alias("text"))
    j = p.join(reports.joined_pages(table(spark, d, "doc_extracts")).withColumnRenamed("text", "joined"), ["doc_path", "page_no"], "left")
    n = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))
    more = n("joined") > f.lit(1.25) * n("text")
    return j.select("doc_path", "page_no", F.when(more, "joined").otherwise("page").alias("source"), F.when(more, n("joined")).otherwise(n("text")).alias("readable"))


@R.add("impact_per_minute", f"{LINKS}, r AS (SELECT student_id, from_kp, to_kp, round(impact / least(greatest(round_even(impact / 8, 0) + 6, 6), 20), 9) AS rate FROM d WHERE impact > 0) SELECT student_id, from_kp, to_kp, round(rate, 6) AS rate, (row_number() OVER (PARTITION BY student_id ORDER BY rate DESC, from_kp, to_kp))::INT AS place FROM r")
def impact_per_minute(spark, d):
    x = _debts(spark, d).where("impact > 0").withColumn("rate", F.round(F.col("impact") / f.minutes_of_impact(F.col("impact")), 9))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("rate"), "from_kp", "to_kp")))
    return x.select("student_id", "from_kp", "to_kp", r6(F.col("rate")).alias("rate"), "place")


@R.add("formatted_scores", f"{LINKS} SELECT student_id, kp_id, printf('%.6f of %d', score, n) AS said FROM m")
def formatted_scores(spark, d):
    return _mastery(spark, d).select("student_id", "kp_id", F.format_string("%.6f of %d", F.col("score"), F.col("n")).alias("said"))
