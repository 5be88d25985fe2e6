"""Queries of text operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.operators import texts as o
from loomgraph.operators.attempts import latest_by_key
from loomgraph.queries.registry import Registry
from loomgraph.runtime import table

R = Registry()
LINE_WS = "chr(32) || chr(9) || chr(13) || chr(10) || chr(12288)"
TOKENS = "regexp_extract_all(lower({}), '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}|[A-Za-z_][A-Za-z0-9_]+')"
PAGES = "pg AS (SELECT DISTINCT doc_path, page_no, text FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL AND text IS NOT NULL)"
ONE = "pg AS (SELECT doc_path, page_no, min(text) AS text FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)"
DOCS = "docs AS (SELECT * FROM kb_documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, body DESC NULLS LAST, title DESC NULLS LAST) = 1)"
LINES = "ls AS (SELECT doc_path, page_no, i AS line_no, trim(l[i], " + LINE_WS + ") AS line FROM (SELECT doc_path, page_no, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM pg), unnest(range(1, len(l) + 1)) AS u(i))"


def _pages(spark, d):
    return table(spark, d, "page_extracts")


def _one(spark, d):
    return _pages(spark, d).where("doc_path is not null and page_no is not null and text is not null").groupBy("doc_path", "page_no").agg(F.min("text").alias("text"))


def _docs(spark, d):
    cols = ["updated_at", "body", "title", "tags", "visibility", "owner_user_id", "course_code"]
    return latest_by_key(table(spark, d, "kb_documents").where("id is not null"), "id", ["updated_at", "body", "title"], ["id", *cols])


@R.add("text_tokens", f"WITH {DOCS}, x AS (SELECT id, {TOKENS.format('body')} AS x FROM docs), u AS (SELECT id, x[i] AS token, i - 1 AS pos FROM x, unnest(range(1, len(x) + 1)) AS u(i)) SELECT id, token, count(*) AS n, min(pos)::INT AS first_at FROM u GROUP BY 1, 2")
def text_tokens(spark, d):
    return o.token_stats(_docs(spark, d), "id", "body")


WIDE = "translate(lower(stem), '" + "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　', '" + "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''") + " ')"


@R.add("text_plain_width", f"""SELECT item_id, md5(p) AS form, md5(replace(p, ' ', '')) AS vote FROM (SELECT DISTINCT item_id, trim(regexp_replace({WIDE}, '[ \\t\\r\\n]+', ' ', 'g')) AS p FROM exam_items WHERE stem IS NOT NULL)""")
def text_plain_width(spark, d):
    e = table(spark, d, "exam_items").where("stem is not null").select("item_id", t.plain_width(F.col("stem")).alias("p"), t.vote_key(F.col("stem")).alias("v")).distinct()
    return e.select("item_id", F.md5("p").alias("form"), F.md5("v").alias("vote"))


@R.add("text_slices", f"WITH {DOCS} SELECT id, i::INT AS idx, substr(body, i * 200 + 1, 200) AS text FROM docs, unnest(range(0, (length(body) + 199) // 200)) AS u(i) WHERE body <> ''")
def text_slices(spark, d):
    return _docs(spark, d).select("id", F.posexplode(t.slices(F.col("body"))).alias("idx", "text"))


@R.add("text_snippets", f"WITH {DOCS} SELECT id, CASE WHEN length(body) > 120 THEN left(body, 120) || '…' ELSE body END AS snippet, sha256(coalesce(body, '')) AS digest FROM docs")
def text_snippets(spark, d):
    return _docs(spark, d).select("id", t.snippet(F.col("body")).alias("snippet"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"))


@R.add(
    "text_noise_lines",
    f"""WITH {ONE}, {LINES} SELECT doc_path, page_no, count(*) AS n_lines, count(*) FILTER (NOT (line = '' OR (length(line) = 1 AND NOT regexp_matches(line, '[0-9]')) OR regexp_matches(line, '^[^\\p{{L}}\\p{{N}}]{{1,8}}$|^[-–—~·*|]{{1,3}}\\s*[0-9]{{1,4}}\\s*[-–—~·*|]{{1,3}}$|^第\\s*[0-9]{{1,4}}\\s*页$')
    OR (length(regexp_replace(line, '\\P{{L}}', '', 'g')) > 30 AND NOT regexp_matches(regexp_replace(line, '\\P{{L}}', '', 'g'), '\\P{{Lu}}')))) AS kept FROM ls GROUP BY 1, 2""",
)
def text_noise_lines(spark, d):
    return o.lines(_one(spark, d), ["doc_path", "page_no"]).groupBy("doc_path", "page_no").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~o.is_noise(F.col("line"))).alias("kept"))


@R.add(
    "text_boilerplate",
    f"""WITH {ONE}, {LINES}, c AS (SELECT doc_path, line, count(DISTINCT page_no) AS pages FROM ls WHERE length(line) BETWEEN 1 AND 40 AND NOT regexp_matches(line, '^[0-9]{{1,4}}$') GROUP BY 1, 2), s AS (SELECT doc_path, count(*) AS n FROM pg GROUP BY 1)
    SELECT c.doc_path, line, pages FROM c JOIN s ON s.doc_path = c.doc_path WHERE pages >= 3 AND pages >= ceil(n * 0.3::DOUBLE)""",
)
def text_boilerplate(spark, d):
    return o.boilerplate(_one(spark, d))


@R.add(
    "text_quality",
    f"""WITH {ONE}, q AS (SELECT doc_path, page_no, length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))::DOUBLE AS cj, length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS le, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM pg),
    r AS (SELECT doc_path, page_no, len(l)::INT AS n_lines, CASE WHEN le > 0 THEN cj / le ELSE 0 END AS cjk, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]{{1,8}}$')))::DOUBLE / len(l) ELSE 0 END AS noise FROM q),
    s AS (SELECT *, 0.35::DOUBLE + 0.3 * least(cjk / 0.6, 1) + 0.2 * (1 - noise) AS score FROM r)
    SELECT doc_path, page_no, n_lines, round(cjk, 6) AS cjk, round(noise, 6) AS noise, round(score, 6) AS score, CASE WHEN score >= 0.845 THEN 'A' WHEN score >= 0.7 THEN 'B' WHEN score >= 0.5 THEN 'C' ELSE 'D' END AS grade FROM s""",
)
def text_quality(spark, d):
    q = o.quality(_one(spark, d))
    return q.select("doc_path", "page_no", "n_lines", *[F.round(c, 6).alias(c) for c in ("cjk", "noise", "score")], "grade")


HEADS = f"""{PAGES}, {LINES}, h AS (SELECT doc_path, page_no, line_no, line, coalesce(nullif(regexp_extract(line, '^第\\s*([0-9]{{1,3}})\\s*章\\s*(.{{0,60}})$', 1), ''), nullif(regexp_extract(line, '^(?:Chapter|Kapitel)\\s+([0-9]{{1,3}}):\\s*(.{{0,60}})$', 1), ''))::INT AS chapter FROM ls WHERE length(line) <= 80),
  heads AS (SELECT doc_path, page_no, line_no, chapter, trim(coalesce(nullif(regexp_extract(line, '^第\\s*([0-9]{{1,3}})\\s*章\\s*(.{{0,60}})$', 2), ''), regexp_extract(line, '^(?:Chapter|Kapitel)\\s+([0-9]{{1,3}}):\\s*(.{{0,60}})$', 2))) AS title FROM h WHERE chapter IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_path, chapter ORDER BY page_no, line_no, line) = 1)"""


@R.add("text_outline", f"WITH {HEADS} SELECT doc_path, page_no, line_no::INT AS line_no, chapter FROM heads")
def text_outline(spark, d):
    return o.outline(_pages(spark, d)).drop("title")


@R.add("text_chapter_of_pages", f"WITH {HEADS}, p AS (SELECT DISTINCT doc_path, page_no FROM page_extracts WHERE doc_path IS NOT NULL AND page_no IS NOT NULL) SELECT p.doc_path, p.page_no, heads.chapter FROM p ASOF LEFT JOIN (SELECT doc_path, page_no, max_by(chapter, line_no) AS chapter FROM heads GROUP BY 1, 2) heads ON heads.doc_path = p.doc_path AND p.page_no >= heads.page_no")
def text_chapter_of_pages(spark, d):
    return o.chapter_of_pages(_pages(spark, d), o.outline(_pages(spark, d)))


@R.add("text_sequence_edges", f"WITH {HEADS} SELECT doc_path, chapter AS from_chapter, to_chapter FROM (SELECT *, lead(chapter) OVER (PARTITION BY doc_path ORDER BY page_no, line_no, chapter) AS to_chapter FROM heads) WHERE to_chapter IS NOT NULL")
def text_sequence_edges(spark, d):
    return o.sequence_edges(o.outline(_pages(spark, d)))


TOK = f"tk AS (SELECT id, x[i] AS w, i AS pos FROM (SELECT id, {TOKENS.format('body')} AS x FROM docs), unnest(range(1, len(x) + 1)) AS u(i))"


@R.add(
    "text_associations",
    f"""WITH {DOCS}, {TOK}, c AS (SELECT w, count(*) AS c FROM tk GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM tk),
    p AS (SELECT least(a.w, b.w) AS a, greatest(a.w, b.w) AS b, count(*) AS k FROM tk a JOIN tk b ON a.id = b.id AND b.pos > a.pos AND b.pos < a.pos + 8 WHERE a.w <> b.w GROUP BY 1, 2 HAVING count(*) >= 5)
    SELECT a, b, k AS n, round(log2(k * n / (x.c::DOUBLE * y.c)), 6) AS pmi, round(least(1, greatest(-1, log2(k * n / (x.c::DOUBLE * y.c)) / -log2(k / n))), 6) AS npmi FROM p JOIN c x ON x.w = a JOIN c y ON y.w = b, n""",
)
def text_associations(spark, d):
    return o.associations(_docs(spark, d), "id", "body").select("a", "b", "n", F.round("pmi", 6).alias("pmi"), F.round("npmi", 6).alias("npmi"))


@R.add(
    "text_rank",
    f"""WITH RECURSIVE {DOCS}, {TOK}, p AS (SELECT a.id, a.w AS a, b.w AS b, 1.0::DOUBLE / (b.pos - a.pos) AS w FROM tk a JOIN tk b ON a.id = b.id AND b.pos > a.pos AND b.pos < a.pos + 5 WHERE a.w <> b.w),
    e AS (SELECT id, a, b, sum(w) AS w FROM (SELECT * FROM p UNION ALL SELECT id, b, a, w FROM p) GROUP BY 1, 2, 3), g AS (SELECT id, a, sum(w) AS dg FROM e GROUP BY 1, 2), nt AS (SELECT DISTINCT id, w FROM tk), sz AS (SELECT id, count(*)::DOUBLE AS size FROM nt GROUP BY 1),
    m AS (SELECT e.id, e.a, e.b, 0.85::DOUBLE * w / dg AS p FROM e JOIN g ON g.id = e.id AND g.a = e.a UNION ALL SELECT id, w, w, NULL FROM nt),
    r AS (SELECT nt.id, nt.w, 1 / size AS r, size, 0 AS it FROM nt JOIN sz ON sz.id = nt.id UNION ALL SELECT m.id, m.b, 0.15::DOUBLE / r.size + coalesce(sum(r.r * m.p), 0), r.size, r.it + 1 FROM r JOIN m ON m.id = r.id AND m.a = r.w WHERE r.it < 30 GROUP BY m.id, m.b, r.size, r.it)
    SELECT id, w AS token, round(r / sum(r) OVER (PARTITION BY id), 8) AS rank FROM r WHERE it = 30""",
)
def text_rank(spark, d):
    return o.text_rank(_docs(spark, d), "id", "body").withColumn("rank", F.round("rank", 8))


NAMES = """nm AS (SELECT n.kp_id, min(n.kp_name) AS found, min(c.kp_name) AS ok FROM knowledge_nodes n JOIN course_kps c ON c.kp_id = n.kp_id WHERE n.kp_name IS NOT NULL AND c.kp_name IS NOT NULL GROUP BY 1)"""


@R.add(
    "text_error_rates",
    f"""WITH {NAMES}, ch AS (SELECT kp_id, x, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 2) AS b FROM (SELECT kp_id, 1 AS s, unnest(string_split(regexp_replace(found, '\\s', '', 'g'), '')) AS x FROM nm UNION ALL SELECT kp_id, 2, unnest(string_split(regexp_replace(ok, '\\s', '', 'g'), '')) FROM nm) GROUP BY 1, 2),
    z AS (SELECT kp_id, sum(least(a, b)) AS bo, sum(a) AS na, sum(b) AS nb FROM ch GROUP BY 1)
    SELECT kp_id, (nb - bo)::INT AS missing, (na - bo)::INT AS extra, round(bo / nb, 6) AS recall, round(bo / na, 6) AS precision, round(2 * bo / (na + nb), 6) AS f1 FROM z""",
)
def text_error_rates(spark, d):
    n, c = table(spark, d, "knowledge_nodes"), table(spark, d, "course_kps")
    j = n.select("kp_id", F.col("kp_name").alias("found")).join(c.select("kp_id", F.col("kp_name").alias("ok")), "kp_id").where("found is not null and ok is not null").groupBy("kp_id").agg(F.min("found").alias("found"), F.min("ok").alias("ok"))
    x = o.character_difference(j, "kp_id", "found", "ok")
    return x.select("kp_id", "missing", "extra", *[F.round(v, 6).alias(v) for v in ("recall", "precision", "f1")])


@R.add("text_near_names", "WITH n AS (SELECT DISTINCT kp_name AS a FROM knowledge_nodes WHERE kp_name IS NOT NULL AND NOT regexp_matches(kp_name, '[^ -~]')) SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a < y.a AND abs(length(x.a) - length(y.a)) < 2 WHERE levenshtein(x.a, y.a) = 1")
def text_near_names(spark, d):
    return o.near_names(table(spark, d, "knowledge_nodes").where("kp_name is not null and not kp_name rlike '[^ -~]'"), "kp_name")


@R.add("text_lexicon_hits")
def text_lexicon_hits(spark, d):
    kps = table(spark, d, "course_kps").select(F.col("kp_id").alias("term_id"), F.regexp_replace("kp_name", r" \d+$", "").alias("term"))
    return o.lexicon_hits(table(spark, d, "exam_items").select(F.col("item_id").alias("key"), F.col("stem").alias("text")).distinct(), kps)


@R.add("exam_papers")
def exam_papers(spark, d):
    e = table(spark, d, "exam_items").where("paper_id is not null and item_no is not null").groupBy("paper_id", "item_no").agg(F.min(F.struct("section_title", "raw_text", "option_texts", "answer")).alias("x"))
    text = F.concat_ws("\n", F.coalesce("x.section_title", F.lit("")), F.coalesce("x.raw_text", F.lit("")), F.array_join(F.transform(F.coalesce("x.option_texts", F.array().cast("array<string>")), lambda y, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), y)), "\n"), F.concat(F.lit("答案："), F.col("x.answer")))
    rows = o.lines(e.select("paper_id", "item_no", text.alias("text")), ["paper_id", "item_no"]).where("line <> ''")
    return o.paper_items(rows.select("paper_id", (F.col("item_no").cast("bigint") * 100_000 + F.col("line_no")).alias("line_no"), "line"))


@R.add(
    "exam_heads",
    """SELECT item_id, nullif(regexp_extract(trim(raw_text), '^([0-9]{1,3})\\s*[.、．)]\\s*(\\S.*)$', 1), '')::INT AS number, coalesce(len(option_texts), 0)::INT AS n_options, count(*) AS copies FROM exam_items WHERE raw_text IS NOT NULL AND NOT contains(raw_text, chr(10)) GROUP BY 1, 2, 3""",
)
def exam_heads(spark, d):
    e = table(spark, d, "exam_items").where("raw_text is not null and instr(raw_text, '\n') = 0")
    number = F.nullif(F.regexp_extract(F.trim("raw_text"), r"^([0-9]{1,3})\s*[.、．)]\s*(\S.*)$", 1), F.lit("")).cast("int")
    return e.groupBy("item_id", number.alias("number"), F.greatest(F.coalesce(F.size("option_texts"), F.lit(0)), F.lit(0)).alias("n_options")).agg(F.count(F.lit(1)).alias("copies"))


QUERY_WORDS = ["ledger", "矩阵", "review", "利息"]
HASHED = """gr AS (SELECT id, txt, n, substr(txt, i, n) AS g FROM tx, unnest([2, 3]) AS s(n), unnest(range(1, length(txt) - n + 2)) AS u(i) WHERE length(txt) >= n),
  hv AS (SELECT id, (('0x' || substr(sha256(g), 1, 8))::BIGINT % 64) AS dim, count(*)::DOUBLE AS v FROM gr GROUP BY 1, 2), nrm AS (SELECT id, sqrt(sum(v * v)) AS nn FROM hv GROUP BY 1)"""


@R.add("hash_vectors", f"WITH {DOCS}, tx AS (SELECT id, coalesce(title, '') AS txt FROM docs), {HASHED} SELECT hv.id, dim::INT AS dim, round(v / nn, 6) AS value FROM hv JOIN nrm ON nrm.id = hv.id")
def hash_vectors(spark, d):
    v = o.hash_vectors(_docs(spark, d).select(F.col("id").alias("key"), F.col("title").alias("text")))
    return v.select(F.col("key").alias("id"), F.posexplode("vec").alias("dim", "value")).where("value > 0").withColumn("value", F.round("value", 6))


@R.add(
    "search_hybrid",
    f"""WITH {DOCS}, vis AS (SELECT * FROM docs WHERE visibility IN ('public', 'course')), q AS (SELECT unnest(['{"', '".join(QUERY_WORDS)}']) AS query),
    w AS (SELECT query, id, updated_at, CASE WHEN contains(lower(coalesce(title, '')), query) THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(coalesce(body, '')), query) THEN 1 ELSE 0 END + CASE WHEN len(list_filter(coalesce(tags, []), lambda z: contains(lower(z), query))) > 0 THEN 1.5 ELSE 0 END AS s FROM vis, q),
    fr AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s DESC, updated_at DESC, id) AS text_rank FROM w WHERE s > 0),
    tx AS (SELECT id, coalesce(title, '') || ' ' || coalesce(body, '') AS txt FROM vis UNION ALL SELECT '?' || query, query FROM q), {HASHED},
    dots AS (SELECT q.query, vis.id, coalesce(sum(a.v / na.nn * b.v / nb.nn), 0) AS dot FROM vis CROSS JOIN q LEFT JOIN nrm na ON na.id = vis.id LEFT JOIN nrm nb ON nb.id = '?' || q.query LEFT JOIN hv a ON a.id = vis.id LEFT JOIN hv b ON b.id = '?' || q.query AND b.dim = a.dim GROUP BY 1, 2),
    vr AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(1 - dot, 9), id) AS vector_rank FROM dots),
    f AS (SELECT coalesce(fr.query, vr.query) AS query, coalesce(fr.id, vr.id) AS id, text_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + text_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS rrf FROM fr FULL JOIN vr ON fr.query = vr.query AND fr.id = vr.id)
    SELECT query, id, text_rank, vector_rank, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 12) DESC, id)::INT AS place FROM f QUALIFY place <= 20""",
)
def search_hybrid(spark, d):
    q = spark.createDataFrame([(x,) for x in QUERY_WORDS], "query string")
    return o.search(o.visible(_docs(spark, d), "", "student"), q).withColumn("rrf", F.round("rrf", 9))


@R.add("chunk_context", """WITH c AS (SELECT doc_id, idx, max(text) AS text FROM kb_chunks WHERE doc_id IS NOT NULL AND idx IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)
    SELECT a.doc_id, a.idx, string_agg(b.text, chr(10) ORDER BY b.idx) AS context FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.idx BETWEEN a.idx - 1 AND a.idx + 1 GROUP BY 1, 2""")
def chunk_context(spark, d):
    return o.around(table(spark, d, "kb_chunks"))


@R.add("tag_tree", f"WITH {DOCS}, u AS (SELECT course_code, unnest(CASE WHEN len(coalesce(tags, [])) = 0 THEN ['(none)'] ELSE tags END) AS tag FROM docs) SELECT coalesce(course_code, '(none)') AS course, coalesce(tag, '(none)') AS tag, count(*) AS n FROM u GROUP BY 1, 2")
def tag_tree(spark, d):
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0, F.array(F.lit("(none)"))).otherwise(F.col("tags"))
    return _docs(spark, d).select(F.coalesce("course_code", F.lit("(none)")).alias("course"), F.explode(tags).alias("tag")).groupBy("course", F.coalesce("tag", F.lit("(none)")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@R.add("vector_ranks", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.e), 6) AS dist FROM embeddings, q) SELECT vec_id, dist FROM x")
def vector_ranks(spark, d):
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # a single row
    return e.join(q).select("vec_id", F.round(t.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("dist"))


@R.add("html_text", "SELECT doc_id, 'Title <' || title || chr(10) || chr(10) || 'A & B' || chr(10) || 'end' AS text FROM documents WHERE title IS NOT NULL AND title <> '' AND NOT regexp_matches(title, '[<>&]|  |\\t|\\n|\\r|^ | $')")
def html_text(spark, d):
    e = table(spark, d, "documents").where(r"title is not null and title <> '' and not title rlike '[<>&]|  |\\t|\\n|\\r|^ | $'")
    page = F.concat(F.lit("<html><style>p {x}</style><!-- a\nb --><body><h1>Title &#60;"), F.col("title"), F.lit("</h1>\n\n\n<script>var x = '<p>';</script><p class='a'>A &amp;  B</p><i>end</i></body></html>"))
    return e.select("doc_id", t.html_text(page).alias("text"))
