"""Queries of reports, samples and merges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.functions import text as t
from loomgraph.operators import graphs, hierarchy, learners, texts
from loomgraph.operators import reports as o
from loomgraph.queries.graphed import DAG, VALID, _dag, _tables
from loomgraph.queries.learning import AS_OF, LINKS, _debts, _graded, _links, _mastery, r6
from loomgraph.queries.pipeline import FOLD, TREE_SQL
from loomgraph.queries.registry import Registry
from loomgraph.queries.texted import DOCS, HEADS, ONE, _docs, _one
from loomgraph.runtime import table

R = Registry()
STATES = ["ready", "parsing", "archived", "failed"]
ANCHORS = [("drill", "exercise"), ("drill", "练习"), ("check", "true or false"), ("check", "vrai ou faux"), ("explain", "简述"), ("explain", "difference"), ("compute", "计算"), ("compute", "ledger"), ("compute", "balance")]
PATTERNS = ["ledger", "hash table", "练习", "区别", "balance", "table"]


@R.add("doc_status_counts", f"WITH {DOCS.replace('SELECT *', 'SELECT *')} SELECT coalesce(course_code, '(none)') AS course_code, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATES) + " FROM docs GROUP BY 1")
def doc_status_counts(spark, d):
    from loomgraph.operators.attempts import latest_by_key

    docs = latest_by_key(table(spark, d, "kb_documents").where("id is not null"), "id", ["updated_at", "body", "title"], ["id", "updated_at", "body", "title", "course_code", "status"])
    return o.status_counts(docs, "course_code", "status", STATES)


@R.add("page_sample", f"WITH {ONE.replace(' AND text IS NOT NULL', '')}, i AS (SELECT doc_path, page_no, row_number() OVER (PARTITION BY doc_path ORDER BY page_no) - 1 AS i, count(*) OVER (PARTITION BY doc_path) AS k FROM pg) SELECT doc_path, page_no FROM i WHERE k <= 5 OR list_contains(list_transform(range(0, 5), lambda j: (j * (k - 1)) // 4), i)")
def page_sample(spark, d):
    return o.sampled_pages(table(spark, d, "page_extracts"))


@R.add(
    "weak_pages",
    """WITH p AS (SELECT doc_path, page_no, max(coalesce(length(text), 0)) AS chars FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL GROUP BY 1, 2), m AS (SELECT doc_path, quantile_cont(chars::DOUBLE, 0.5) AS m FROM p WHERE chars >= 60 GROUP BY 1 HAVING count(*) >= 3)
    SELECT p.doc_path, page_no, chars::INT AS chars, round(greatest(20, 0.4::DOUBLE * m), 6) AS bar FROM p JOIN m ON m.doc_path = p.doc_path WHERE chars < greatest(20, 0.4::DOUBLE * m)""",
)
def weak_pages(spark, d):
    return o.weak_pages(table(spark, d, "page_extracts")).withColumn("bar", r6(F.col("bar")))


JOINED = """dx AS (SELECT doc_path, regexp_extract_all(chr(10) || chr(10) || ltrim(text), '\\n\\n===== PAGE (\\d+) =====\\n', 1) AS no, string_split_regex(chr(10) || chr(10) || ltrim(text), '\\n\\n===== PAGE \\d+ =====\\n') AS x FROM doc_extracts WHERE doc_path IS NOT NULL AND text IS NOT NULL),
  jp AS (SELECT doc_path, no[i]::INT AS page_no, min(x[i + 1]) AS joined FROM dx, unnest(range(1, len(no) + 1)) AS u(i) GROUP BY 1, 2)"""


@R.add("page_pairs", f"WITH p AS (SELECT doc_path, page_no, min(text) AS text FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL GROUP BY 1, 2), {JOINED} SELECT p.doc_path, p.page_no, coalesce(length(text), 0)::INT AS chars, length(joined)::INT AS joined_chars FROM p LEFT JOIN jp ON jp.doc_path = p.doc_path AND jp.page_no = p.page_no")
def page_pairs(spark, d):
    return o.page_pairs(table(spark, d, "page_extracts"), table(spark, d, "doc_extracts"))


PROBE = "CASE WHEN contains(joined, substr(text, floor((length(text) - 18) * {}::DOUBLE)::INT + 1, 18)) THEN 1 ELSE 0 END"


@R.add("page_probes", f"WITH p AS (SELECT doc_path, page_no, min(text) AS text FROM page_extracts WHERE length(text) >= 18 GROUP BY 1, 2), {JOINED} SELECT p.doc_path, p.page_no, ({' + '.join(PROBE.format(x) for x in (0.2, 0.5, 0.8))})::INT AS hit FROM p LEFT JOIN jp ON jp.doc_path = p.doc_path AND jp.page_no = p.page_no")
def page_probes(spark, d):
    return o.page_probes(table(spark, d, "page_extracts"), table(spark, d, "doc_extracts"))


@R.add("owning_chapters", f"""WITH {HEADS}, p AS (SELECT doc_path, page_no, min(text) AS text FROM pg GROUP BY 1, 2), a AS (SELECT p.*, hd.chapter FROM p ASOF LEFT JOIN (SELECT doc_path, page_no, max_by(chapter, line_no) AS chapter FROM heads GROUP BY 1, 2) hd ON hd.doc_path = p.doc_path AND p.page_no >= hd.page_no),
    tk AS (SELECT doc_path, chapter, unnest(regexp_extract_all(lower(text), '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}|[A-Za-z_][A-Za-z0-9_]+')) AS token FROM a WHERE chapter IS NOT NULL), c AS (SELECT doc_path, token, chapter, count(*) AS n FROM tk GROUP BY 1, 2, 3)
    SELECT doc_path, token, chapter, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_path, token ORDER BY n DESC, chapter) = 1""")
def owning_chapters(spark, d):
    pages = table(spark, d, "page_extracts")
    at = texts.chapter_of_pages(pages, texts.outline(pages)).where("chapter is not null")
    tokens = _one(spark, d).join(at, ["doc_path", "page_no"]).select("doc_path", "chapter", F.explode(t.tokens(F.col("text"))).alias("token"))
    return o.owning_chapters(tokens)


@R.add("book_report", f"""WITH {ONE}, q AS (SELECT doc_path, page_no, length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))::DOUBLE AS cj, length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS le, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM pg),
    s AS (SELECT doc_path, page_no, 0.35::DOUBLE + 0.3 * least(CASE WHEN le > 0 THEN cj / le ELSE 0 END / 0.6, 1) + 0.2 * (1 - CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]{{1,8}}$')))::DOUBLE / len(l) ELSE 0 END) AS score FROM q),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_path ORDER BY round(score, 9), page_no) AS i FROM s) SELECT doc_path, count(*) AS pages, round(avg(score), 6) AS mean_score, string_agg(page_no::VARCHAR, ',' ORDER BY i) FILTER (i <= 10) AS worst FROM r GROUP BY 1""")
def book_report(spark, d):
    return o.book_report(texts.quality(_one(spark, d))).withColumn("mean_score", r6(F.col("mean_score")))


@R.add("graph_triples", f"WITH n AS (SELECT pack_id, kp_id, min(kp_name) AS nm FROM knowledge_nodes WHERE kp_id IS NOT NULL GROUP BY 1, 2) SELECT DISTINCT e.pack_id, coalesce(a.nm, from_kp) || ' -[' || {FOLD.format('edge_type')} || ']-> ' || coalesce(b.nm, to_kp) AS triple FROM knowledge_edges e LEFT JOIN n a ON a.pack_id = e.pack_id AND a.kp_id = from_kp LEFT JOIN n b ON b.pack_id = e.pack_id AND b.kp_id = to_kp WHERE e.pack_id IS NOT NULL AND from_kp IS NOT NULL AND to_kp IS NOT NULL AND edge_type IS NOT NULL")
def graph_triples(spark, d):
    return o.triples(*_tables(spark, d))


@R.add("graph_direct", f"{VALID} SELECT DISTINCT pack_id, to_kp AS kp_id, from_kp AS parent FROM v WHERE {FOLD.format('edge_type')} = 'prerequisite'")
def graph_direct(spark, d):
    from loomgraph.operators.attempts import folded

    return graphs.valid_edges(*_tables(spark, d)).where(folded(F.col("edge_type")) == "prerequisite").select("pack_id", F.col("to_kp").alias("kp_id"), F.col("from_kp").alias("parent")).distinct()


@R.add("graph_repeated", "SELECT pack_id, from_kp, to_kp, edge_type, weight, source, count(*) - 1 AS again FROM knowledge_edges GROUP BY ALL HAVING count(*) > 1")
def graph_repeated(spark, d):
    e = table(spark, d, "knowledge_edges").select("pack_id", "from_kp", "to_kp", "edge_type", "weight", "source")
    return e.exceptAll(e.distinct()).groupBy(*e.columns).agg(F.count(F.lit(1)).alias("again"))


@R.add("exam_cotested", "WITH x AS (SELECT DISTINCT item_id, unnest(kps) AS k FROM exam_items WHERE item_id IS NOT NULL AND kps IS NOT NULL), y AS (SELECT item_id, k FROM x WHERE k IS NOT NULL), z AS (SELECT DISTINCT a.item_id, a.k AS a, b.k AS b FROM y a JOIN y b ON a.item_id = b.item_id AND a.k < b.k) SELECT a, b, count(*) AS items FROM z GROUP BY 1, 2")
def exam_cotested(spark, d):
    return o.cotested(table(spark, d, "exam_items"))


@R.add("graph_merged", f"""{DAG}, a AS (SELECT pack_id, from_kp, to_kp, max(weight) AS weight, 1 AS origin FROM v WHERE source IS NULL OR source <> 'ai-extract' GROUP BY 1, 2, 3), b AS (SELECT pack_id, a AS from_kp, b AS to_kp, weight, 2 AS origin FROM e), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY pack_id, from_kp, to_kp ORDER BY origin, weight DESC) = 1) SELECT pack_id, from_kp, to_kp, weight, origin FROM m QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY origin, weight DESC, from_kp, to_kp) <= 300""")
def graph_merged(spark, d):
    _, dag = _dag(spark, d)
    first = graphs.valid_edges(*_tables(spark, d)).where("source is null or source <> 'ai-extract'").groupBy("pack_id", "from_kp", "to_kp").agg(F.max("weight").alias("weight"))
    return o.merged_edges(first, dag)


@R.add("cycle_paths", f"""{TREE_SQL}, lost AS (SELECT e.* FROM e ANTI JOIN t ON e.pack_id = t.pack_id AND e.kp_id = t.kp_id), w AS (SELECT pack_id, kp_id, parent AS spot FROM lost UNION SELECT w.pack_id, w.kp_id, lost.parent FROM w JOIN lost ON lost.pack_id = w.pack_id AND lost.kp_id = w.spot),
    oc AS (SELECT w.pack_id, w.kp_id, min(w.spot) AS cycle FROM w JOIN (SELECT pack_id, kp_id FROM w WHERE kp_id = spot) o ON o.pack_id = w.pack_id AND o.kp_id = w.kp_id GROUP BY 1, 2),
    g AS (SELECT pack_id, cycle, kp_id, kp_id AS path, 1 AS k FROM oc WHERE kp_id = cycle UNION ALL SELECT g.pack_id, g.cycle, oc.kp_id, g.path || '>' || oc.kp_id, k + 1 FROM g JOIN lost ON lost.pack_id = g.pack_id AND lost.parent = g.kp_id JOIN oc ON oc.pack_id = g.pack_id AND oc.kp_id = lost.kp_id AND oc.cycle = g.cycle WHERE oc.kp_id <> g.cycle)
    SELECT pack_id, cycle, path || '>' || cycle AS path FROM g QUALIFY row_number() OVER (PARTITION BY pack_id, cycle ORDER BY k DESC) = 1""")
def cycle_paths(spark, d):
    p = hierarchy.parent_pointers(*_tables(spark, d))
    return o.cycle_paths(p, hierarchy.cycles(p, hierarchy.hierarchy(p, paths=False)))


VALUES = ", ".join(f"('{a}', '{b}')" for a, b in ANCHORS)


@R.add("intent_scores", f"""WITH u AS (SELECT DISTINCT item_id AS key, lower(stem) AS text FROM exam_items WHERE item_id IS NOT NULL AND length(stem) > 0), a(intent, phrase) AS (VALUES {VALUES}),
    g AS (SELECT key, intent, max(0.5::DOUBLE + 0.5 * least(length(phrase) / 8.0::DOUBLE, 1)) AS best, sum(0.5::DOUBLE + 0.5 * least(length(phrase) / 8.0::DOUBLE, 1)) AS al, sum(length(phrase)) AS cov, max(length(text)) AS n FROM u JOIN a ON contains(text, phrase) GROUP BY 1, 2),
    s AS (SELECT key, intent, round_even(least(1, best + 0.5::DOUBLE * least(al - best, 1) + 0.15::DOUBLE * least(cov::DOUBLE / n, 1)), 6) AS score FROM g) SELECT key, intent, score, (row_number() OVER (PARTITION BY key ORDER BY score DESC, intent))::INT AS rank FROM s QUALIFY rank <= 2""")
def intent_scores(spark, d):
    a = spark.createDataFrame(ANCHORS, "intent string, phrase string")
    return o.intent_scores(table(spark, d, "exam_items").select(F.col("item_id").alias("key"), F.col("stem").alias("text")), a)


WIDE = "lower(translate(stem, '" + "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　', '" + "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''") + " '))"


@R.add("pattern_hits", f"""WITH u AS (SELECT DISTINCT item_id AS key, trim(regexp_replace({WIDE}, '[ \\t\\r\\n]+', ' ', 'g')) AS x FROM exam_items WHERE stem IS NOT NULL), p AS (SELECT unnest({PATTERNS}) AS p), j AS (SELECT key, x, p, instr(x, p) AS spot FROM u JOIN p ON contains(x, p))
    SELECT key, (list(p ORDER BY spot, length(p) DESC, p))[1] AS first, (list(p ORDER BY length(p) DESC, p))[1] AS longest FROM j GROUP BY 1""")
def pattern_hits(spark, d):
    p = spark.createDataFrame([(x,) for x in PATTERNS], "pattern string")
    return o.first_hit(table(spark, d, "exam_items").where("stem is not null").select(F.col("item_id").alias("key"), F.col("stem").alias("text")), p)


@R.add("numeric_claims", f"WITH {DOCS} SELECT id, coalesce(regexp_matches(body, '[0-9]+(\\.[0-9]+)?\\s*(%|个百分点)|[0-9]+(\\.[0-9]+)?\\s*分([^钟]|$)'), false) AS claims FROM docs")
def numeric_claims(spark, d):
    return _docs(spark, d).select("id", F.coalesce(o.claims(F.col("body")), F.lit(False)).alias("claims"))


@R.add("doc_changes", "WITH v AS (SELECT id, updated_at, max(coalesce(body, '')) AS b FROM kb_documents WHERE id IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, lag(b) OVER (PARTITION BY id ORDER BY updated_at) AS pb FROM v) SELECT id, epoch_us(updated_at) AS updated_us, pb IS NULL OR pb <> b AS changed FROM l")
def doc_changes(spark, d):
    v = table(spark, d, "kb_documents").where("id is not null").groupBy("id", "updated_at").agg(F.max(F.coalesce("body", F.lit(""))).alias("b"))
    return o.changes(v, "id", "updated_at", ["b"]).select("id", F.unix_micros("updated_at").alias("updated_us"), "changed")


@R.add(
    "best_questions",
    f"""{LINKS}, im AS (SELECT student_id, to_kp AS kp_id, sum(impact) AS impact FROM d GROUP BY 1, 2), qs AS (SELECT question_id, min({FOLD.format('kp_id')}) AS k FROM attempts WHERE question_id IS NOT NULL AND kp_id IS NOT NULL GROUP BY 1), qk AS (SELECT question_id, kps.kp_id FROM qs JOIN kps ON kps.k = qs.k),
    c AS (SELECT m.student_id, question_id, coalesce(hard.difficulty, 3) / 5.0::DOUBLE AS dif, m.score / 100 AS s, coalesce(impact, 0) AS impact, greatest((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(last_at)) / 86400000000.0::DOUBLE, 0) AS age FROM m JOIN qk ON qk.kp_id = m.kp_id LEFT JOIN hard ON hard.kp_id = m.kp_id LEFT JOIN im ON im.student_id = m.student_id AND im.kp_id = m.kp_id),
    p AS (SELECT student_id, question_id, round(pow(1 - s, 1.2) * (impact + 0.05) * exp(-4 * (dif - least(1, s + 0.15)) * (dif - least(1, s + 0.15))) * (1 + age / 14), 9) AS priority FROM c)
    SELECT student_id, question_id, round(priority, 5) AS priority FROM p QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY priority DESC, question_id) = 1""",
)
def best_questions(spark, d):
    from loomgraph.operators.attempts import folded, known_types

    kps = table(spark, d, "course_kps")
    q = table(spark, d, "attempts").where("question_id is not null and kp_id is not null").groupBy("question_id").agg(F.min(folded(F.col("kp_id"))).alias("type_key")).join(known_types(kps), "type_key").select("question_id", F.col("type_id").alias("kp_id"))
    hard = kps.where("kp_id is not null").groupBy("kp_id").agg((F.coalesce(F.min("difficulty"), F.lit(3)) / f.lit(5)).alias("difficulty"))
    im = _debts(spark, d).groupBy("student_id", F.col("to_kp").alias("kp_id")).agg(F.sum("impact").alias("impact"))
    age = F.greatest(learners.days_between(F.col("last_at"), F.lit(AS_OF).cast("timestamp")), f.lit(0))
    c = _mastery(spark, d).join(q, "kp_id").join(hard, "kp_id", "left").join(im, ["student_id", "kp_id"], "left")
    c = c.select("student_id", "question_id", F.coalesce("difficulty", f.lit(0.6)).alias("difficulty"), (F.col("score") / 100).alias("score"), F.coalesce("impact", f.lit(0)).alias("impact"), age.alias("age"))
    return o.best_questions(c).withColumn("priority", F.round("priority", 5))


@R.add("rotated_bank", f"WITH q AS (SELECT DISTINCT {FOLD.format('kp_id')} AS k, question_id FROM attempts WHERE kp_id IS NOT NULL AND question_id IS NOT NULL), i AS (SELECT k, question_id, row_number() OVER (PARTITION BY k ORDER BY question_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM q) SELECT k, question_id FROM i WHERE ((i - 7) % n + n) % n < 3")
def rotated_bank(spark, d):
    from loomgraph.operators.attempts import folded

    q = table(spark, d, "attempts").where("kp_id is not null and question_id is not null").select(folded(F.col("kp_id")).alias("k"), "question_id").distinct()
    return o.rotated(q, "k", "question_id", 7, 3)


@R.add(
    "link_weights",
    f"""{LINKS}, x AS (SELECT student_id, from_kp, to_kp, impact, max(impact) OVER (PARTITION BY student_id) AS mi, n_to::DOUBLE AS mins, max(n_to) OVER (PARTITION BY student_id) AS mm FROM d)
    SELECT student_id, from_kp, to_kp, round(0.45::DOUBLE * CASE WHEN mi > 0 THEN impact / mi ELSE 0 END + 0.2::DOUBLE * 0.5 + 0.15::DOUBLE * 1 + 0.1::DOUBLE * 0.25 + 0.1::DOUBLE * CASE WHEN mm > 0 THEN mins / mm ELSE 0 END, 6) AS weight FROM x""",
)
def link_weights(spark, d):
    from pyspark.sql import Window

    m = _mastery(spark, d).select("student_id", F.col("kp_id").alias("to_kp"), F.col("n").cast("double").alias("mins"))
    x = _debts(spark, d).join(m, ["student_id", "to_kp"])
    w = Window.partitionBy("student_id")
    v = f.projected_weight(F.col("impact"), F.max("impact").over(w), f.lit(0.5), f.lit(1), f.lit(0.25), F.col("mins"), F.max("mins").over(w))
    return x.select("student_id", "from_kp", "to_kp", v.alias("weight"))


@R.add("prereq_simulation", f"{LINKS} SELECT from_kp AS kp_id, count(*) AS links, round(sum(impact), 6) AS before, round(sum(impact) * 25 / 50.0::DOUBLE, 6) AS after FROM d WHERE impact > 0 GROUP BY 1")
def prereq_simulation(spark, d):
    g = _debts(spark, d).where("impact > 0").groupBy(F.col("from_kp").alias("kp_id")).agg(F.count(F.lit(1)).alias("links"), F.sum("impact").alias("b"))
    return g.select("kp_id", "links", r6(F.col("b")).alias("before"), r6(f.simulated_impact(F.col("b"), f.lit(25))).alias("after"))


@R.add("involved_nodes", f"{LINKS}, i AS (SELECT DISTINCT student_id, unnest([from_kp, to_kp]) AS kp_id FROM d WHERE impact > 0), o AS (SELECT DISTINCT d.student_id, l.to_kp AS kp_id FROM d JOIN links l ON l.from_kp = d.from_kp WHERE d.impact > 0) SELECT u.student_id, u.kp_id, m.score FROM (SELECT * FROM i UNION SELECT * FROM o) u LEFT JOIN m ON m.student_id = u.student_id AND m.kp_id = u.kp_id")
def involved_nodes(spark, d):
    x = _debts(spark, d).where("impact > 0")
    ends = x.select("student_id", F.explode(F.array("from_kp", "to_kp")).alias("kp_id"))
    out = x.select("student_id", "from_kp").distinct().join(_links(spark, d).select("from_kp", F.col("to_kp").alias("kp_id")), "from_kp").select("student_id", "kp_id")
    return ends.unionByName(out).distinct().join(_mastery(spark, d).select("student_id", "kp_id", "score"), ["student_id", "kp_id"], "left")


@R.add("weakest_points", f"{LINKS} SELECT student_id, kp_id, score, (row_number() OVER (PARTITION BY student_id ORDER BY score, kp_id))::INT AS place FROM m QUALIFY place <= 8")
def weakest_points(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("student_id").orderBy("score", "kp_id")
    return _mastery(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 8").select("student_id", "kp_id", "score", "place")


@R.add("conf_levels", f"{LINKS} SELECT self_conf AS conf, count(*) AS n, round(avg(y), 9) AS accuracy, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM a WHERE self_conf IS NOT NULL GROUP BY 1")
def conf_levels(spark, d):
    g = _graded(spark, d).where("self_conf is not null").groupBy(F.col("self_conf").alias("conf")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("a"))
    total = F.broadcast(g.agg(F.sum("n").alias("all")))  # a single row
    return g.join(total).select("conf", "n", F.round("a", 9).alias("accuracy"), F.round(F.col("n") / F.col("all"), 9).alias("share"))
