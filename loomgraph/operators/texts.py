"""Lines, tokens, associations, outlines, exam papers and search over texts."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.functions import text as t
from loomgraph.runtime import stash


def lines(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, line_no, line): the lines of each row, from 1, trimmed; null texts have none."""
    return pages.select(*key, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("i", "line")).select(*key, (F.col("i") + 1).alias("line_no"), F.btrim("line", F.lit(" \t\r\n　")).alias("line"))


def is_noise(line: Column) -> Column:
    """A line that says nothing: empty, a single character that is no digit, marks only, a decorated page number, or a
    long line of capitals."""
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    return (line == "") | ((F.length(line) == 1) & ~line.rlike("[0-9]")) | line.rlike(t.DECORATION) | ((letters > 30) & ~line.rlike(r"[^\P{L}\p{Lu}]"))


def boilerplate(pages: DataFrame, share: float = 0.3, longest: int = 40) -> DataFrame:
    """(doc_path, line, pages): short lines that stand on at least `share` of a book's pages and on three. Each page counts
    a line once, before the shuffle by line; a book's number of pages is joined, not gathered."""
    p = pages.where("doc_path is not null and page_no is not null and text is not null").select("doc_path", "page_no", "text").dropDuplicates(["doc_path", "page_no"])
    per = lines(p, ["doc_path", "page_no"]).where((F.length("line") > 0) & (F.length("line") <= longest) & ~F.col("line").rlike("^[0-9]{1,4}$"))
    n = per.select("doc_path", "page_no", "line").distinct().groupBy("doc_path", "line").agg(F.count(F.lit(1)).alias("pages"))
    size = p.groupBy("doc_path").agg(F.count(F.lit(1)).alias("all"))
    return n.join(size, "doc_path").where((F.col("pages") >= 3) & (F.col("pages") >= F.ceil(F.col("all") * share))).select("doc_path", "line", "pages")


def quality(pages: DataFrame) -> DataFrame:
    """(doc_path, page_no, n_lines, cjk, noise, score, grade): share of ideographs among letters and of decoration among
    lines, each page row by row without a shuffle."""
    p = pages.where("text is not null").select("doc_path", "page_no", "text")
    kept = F.filter(F.split("text", "\n"), lambda x: x != "")
    cjk, letters = F.length(F.regexp_replace("text", r"[^\x{4e00}-\x{9fff}]", "")), F.length(F.regexp_replace("text", r"\P{L}", ""))
    p = p.withColumn("n_lines", F.size(kept)).withColumn("cjk", F.when(letters > 0, cjk / letters).otherwise(0.0))
    p = p.withColumn("noise", F.when(F.col("n_lines") > 0, F.size(F.filter(kept, lambda x: x.rlike(r"^[^\p{L}\p{N}]{1,8}$"))) / F.col("n_lines")).otherwise(0.0))
    score = f.lit(0.35) + f.lit(0.3) * F.least(F.col("cjk") / f.lit(0.6), f.lit(1)) + f.lit(0.2) * (f.lit(1) - F.col("noise"))
    p = p.withColumn("score", score)
    return p.select("doc_path", "page_no", "n_lines", "cjk", "noise", "score", F.when(F.col("score") >= 0.845, "A").when(F.col("score") >= 0.7, "B").when(F.col("score") >= 0.5, "C").otherwise("D").alias("grade"))


def outline(pages: DataFrame) -> DataFrame:
    """(doc_path, page_no, line_no, chapter, title): the first place of each chapter's heading in a book."""
    p = pages.where("doc_path is not null and page_no is not null and text is not null").select("doc_path", "page_no", "text").distinct()
    h = lines(p, ["doc_path", "page_no"]).where(F.length("line") <= 80).withColumn("chapter", t.chapter_number(F.col("line"))).where("chapter is not null")
    first = h.groupBy("doc_path", "chapter").agg(F.min(F.struct("page_no", "line_no", "line")).alias("x"))
    return first.select("doc_path", "x.page_no", "x.line_no", "chapter", t.chapter_title(F.col("x.line")).alias("title"))


def chapter_of_pages(pages: DataFrame, heads: DataFrame, block: int = 256) -> DataFrame:
    """(doc_path, page_no, chapter): the chapter whose heading is the last at or before a page's end, an as-of join: pages
    and headings in one order, and the last heading so far. The order is made per block of pages; what a block begins with
    comes from a second window over the blocks, so a book of any length is spread over tasks."""
    p = pages.where("doc_path is not null and page_no is not null").select("doc_path", "page_no").distinct().withColumn("line_no", F.lit(2**31 - 1)).withColumn("chapter", F.lit(None).cast("int"))
    u = p.unionByName(heads.select("doc_path", "page_no", "line_no", "chapter")).withColumn("b", F.floor(F.col("page_no") / F.lit(block)))
    last = u.groupBy("doc_path", "b").agg(F.max(F.when(F.col("chapter").isNotNull(), F.struct("page_no", "line_no", "chapter")))["chapter"].alias("last"))
    before = last.withColumn("before", F.last("last", ignorenulls=True).over(Window.partitionBy("doc_path").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    by = Window.partitionBy("doc_path", "b").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("at", F.last("chapter", ignorenulls=True).over(by)).where(F.col("line_no") == 2**31 - 1).join(before, ["doc_path", "b"])
    return u.select("doc_path", "page_no", F.coalesce("at", "before").alias("chapter"))


def sequence_edges(heads: DataFrame) -> DataFrame:
    """(doc_path, from_chapter, to_chapter): each heading to the next one of its book."""
    by = Window.partitionBy("doc_path").orderBy("page_no", "line_no", "chapter")
    return heads.withColumn("to_chapter", F.lead("chapter").over(by)).where("to_chapter is not null").select("doc_path", F.col("chapter").alias("from_chapter"), "to_chapter")


def token_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n, first_at): counts and first places (from 0) of each token of a text."""
    e = docs.select(key, F.posexplode(t.tokens(F.col(text))).alias("i", "token"))
    return e.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_at"))


def window_pairs(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(key, a, b, gap): the pairs of tokens less than `window` places apart, in order. Slices of the token array are
    exploded within the row, so there is no join and no shuffle."""
    x = docs.select(key, t.tokens(F.col(text)).alias("x"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window - 1)), lambda k: F.transform(F.arrays_zip(F.slice("x", F.lit(1), F.greatest(F.size("x") - k, F.lit(0))).alias("a"), F.slice("x", k + 1, F.greatest(F.size("x") - k, F.lit(0))).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), k.alias("gap")))))
    return x.where(F.size("x") > 0).select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("a is not null and b is not null")


def associations(docs: DataFrame, key: str, text: str, window: int = 8, least: int = 5) -> DataFrame:
    """(a, b, n, pmi, npmi) of unordered pairs of different tokens seen `least` times or more within the window, against
    the tokens' counts over all texts."""
    c = docs.select(F.explode(t.tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    c = stash(c, "tokens")
    total = c.agg(F.sum("c").cast("double").alias("total"))
    p = window_pairs(docs, key, text, window).where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    j = p.join(c.select(F.col("w").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("w").alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(total))  # a single row
    return j.select("a", "b", "n", f.pmi(F.col("n"), F.col("ca"), F.col("cb"), F.col("total")).alias("pmi"), f.npmi(F.col("n"), F.col("ca"), F.col("cb"), F.col("total")).alias("npmi"))


def _text_ranks(text: np.ndarray, word: np.ndarray, own: np.ndarray, window: int, rounds: int, damping: float) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each different word of a key, its rank) of words in order: `text` tells the texts apart that a word
    stands in, `own` the keys; both rise."""
    _, first, at = np.unique(own * (word.max() + 1) + word, return_index=True, return_inverse=True)
    n = len(first)
    _, key = np.unique(own[first], return_inverse=True)
    pairs = []
    for k in range(1, window):
        near = np.flatnonzero((text[:-k] == text[k:]) & (at[:-k] != at[k:]))
        pairs.append((at[near], at[near + k], 1 / k))
    degree = sum((w * (np.bincount(a, minlength=n) + np.bincount(b, minlength=n)) for a, b, w in pairs), np.zeros(n))
    size = np.bincount(key)[key].astype(float)
    rank = 1 / size
    for _ in range(rounds):
        share = np.divide(rank, degree, out=np.zeros(n), where=degree > 0)
        got = sum((w * (np.bincount(b, share[a], n) + np.bincount(a, share[b], n)) for a, b, w in pairs), np.zeros(n))
        rank = (1 - damping) / size + damping * got
    return first, rank / np.bincount(key, rank)[key]


def text_rank(docs: DataFrame, key: str, text: str, window: int = 5, rounds: int = 30, damping: float = 0.85, at_once: int = 200_000) -> DataFrame:
    """(key, token, rank): TextRank of each text's tokens, summing to 1: pairs of different tokens within the window, both
    ways, with weight 1 / gap. Tokens without a pair share what the damping leaves.

    No pair leads from one key to another, so the texts of a key are brought together once and all rounds are made in the
    task that has them, for texts of about `at_once` tokens together; pairs and ranks are never shuffled or written."""
    x = docs.where(F.col(key).isNotNull()).select(key, t.tokens(F.col(text)).alias("x")).where(F.size("x") > 0)
    kind = x.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).flatten()
            if not len(texts):
                continue
            words = texts.flatten()
            # where the texts of a key, and their words, begin
            of_key, of_text = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]) for c in (b.column(1), texts))
            begins = of_text[of_key]
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(begins, begins[i] + at_once, "right")) - 1)
                some = words.slice(begins[i], begins[j] - begins[i]).dictionary_encode()
                own = np.repeat(np.arange(i, j), np.diff(begins[i : j + 1]))
                lengths = np.diff(of_text[of_key[i] : of_key[j] + 1])
                first, rank = _text_ranks(np.repeat(np.arange(len(lengths)), lengths), some.indices.to_numpy().astype(np.int64), own, window, rounds, damping)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own[first])), some.dictionary.take(some.indices.take(pa.array(first))), pa.array(rank)], names=[key, "token", "rank"])
                i = j

    return x.groupBy(key).agg(F.collect_list("x").alias("x")).mapInArrow(run, f"`{key}` {kind}, token string, rank double")


def character_difference(pairs: DataFrame, key: str, found: str, right: str) -> DataFrame:
    """(key, missing, extra, recall, precision, f1): multisets of characters without spaces, row by row: each different
    character is counted on both sides by what its removal shortens."""
    a, b = F.regexp_replace(found, r"\s", ""), F.regexp_replace(right, r"\s", "")
    p = pairs.select(key, a.alias("a"), b.alias("b"))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
    chars = F.array_distinct(F.filter(F.split(F.concat("a", "b"), ""), lambda x: x != ""))
    both = F.aggregate(chars, F.lit(0), lambda s, x: s + F.least(count(F.col("a"), x), count(F.col("b"), x)))
    p = p.withColumn("both", both).withColumn("na", F.length("a")).withColumn("nb", F.length("b"))
    recall, precision = F.when(F.col("nb") > 0, F.col("both") / F.col("nb")), F.when(F.col("na") > 0, F.col("both") / F.col("na"))
    return p.select(key, (F.col("nb") - F.col("both")).alias("missing"), (F.col("na") - F.col("both")).alias("extra"), recall.alias("recall"), precision.alias("precision"), F.when(F.col("na") + F.col("nb") > 0, f.lit(2) * F.col("both") / (F.col("na") + F.col("nb"))).alias("f1"))


def near_names(names: DataFrame, col: str = "name") -> DataFrame:
    """(a, b): pairs of different names with an edit distance of 1. Two such names share a form with one character taken
    out, or one is such a form of the other; only names that share a form are compared."""
    n = names.select(F.col(col).alias("a")).where("a is not null").distinct()
    forms = F.array_distinct(F.concat(F.array("a"), F.transform(F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), lambda i: F.concat(F.substring("a", F.lit(1), i - 1), F.substring("a", i + 1, F.length("a"))))))
    x = n.select("a", F.explode(forms).alias("form"))
    y = x.select(F.col("a").alias("b"), "form")
    return x.join(y, "form").where("a < b").select("a", "b").distinct().where(F.levenshtein("a", "b", 1) == 1)


def lexicon_hits(texts: DataFrame, lexicon: DataFrame, most: int = 4, max_terms: int = 200_000) -> DataFrame:
    """(key, term_id, pos, term) from texts (key, text) and lexicon (term_id, term): the terms that a text holds, longest
    first, without overlap, at most `most` a text (a top-k); pos from 0, case doesn't matter. The automaton is built once
    and sent to all tasks; a lexicon of more than max_terms terms is refused."""
    import ahocorasick

    terms = lexicon.where("term_id is not null and length(term) > 1").groupBy(F.lower("term").alias("term")).agg(F.min("term_id").alias("term_id")).limit(max_terms + 1).toArrow()
    if terms.num_rows > max_terms:
        raise ValueError("the lexicon has too many terms to be sent out")
    a = ahocorasick.Automaton()
    for term, i in zip(terms.column("term").to_pylist(), terms.column("term_id").to_pylist(), strict=True):
        a.add_word(term, (i, term))
    if len(a):
        a.make_automaton()
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps(a) if len(a) else None)
    schema = pa.schema([("key", pa.string()), ("term_id", pa.string()), ("pos", pa.int32()), ("term", pa.string())])

    def run(batches):
        auto = pickle.loads(sent.value) if sent.value else None
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = sorted(((end - len(w) + 1, i, w) for end, (i, w) in auto.iter(text)), key=lambda x: (-len(x[2]), x[0])) if auto else []
                taken: list[tuple[int, int]] = []
                for at, i, w in found:
                    if len(taken) < most and all(at >= z or at + len(w) <= s for s, z in taken):
                        taken.append((at, at + len(w)))
                        rows.append((key, i, at, w))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(schema)], schema=schema)

    return texts.where("text is not null").select("key", F.lower("text").alias("text")).mapInArrow(run, "key string, term_id string, pos int, term string")


def paper_items(papers: DataFrame) -> DataFrame:
    """(paper_id, item, number, section, stem, n_options, answer) from the lines (paper_id, line_no, line) of papers: a
    running count of section lines and of lines that begin with a number tells what each line belongs to. A line that
    begins with a letter and a mark is an option, one that begins with the word answer is the answer, others go on."""
    head = r"^([0-9]{1,3})\s*[.、．)]\s*(\S.*)$"
    p = papers.withColumn("is_head", F.col("line").rlike(head)).withColumn("is_section", ~F.col("is_head") & F.col("line").rlike(r"^[一二三四五六七八九十]+、.{1,22}$|^(?:Part|Teil|Partie|Parte) [A-Z0-9]+$"))
    by = Window.partitionBy("paper_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("item", F.sum(F.col("is_head").cast("int")).over(by)).withColumn("section", F.last(F.when(F.col("is_section"), F.col("line")), ignorenulls=True).over(by))
    option, answer = F.col("line").rlike(r"^[A-Ha-h]\s*[.、．)]"), F.col("line").rlike(r"^(?:答案|参考答案|Answer|Antwort|Réponse|Respuesta)\s*[:：]")
    g = p.where("item > 0 and not is_section").groupBy("paper_id", "item").agg(
        F.max(F.when(F.col("is_head"), F.regexp_extract("line", head, 1).cast("int"))).alias("number"), F.max(F.when(F.col("is_head"), F.col("section"))).alias("section"),
        F.max(F.when(F.col("is_head"), F.regexp_extract("line", head, 2))).alias("first"), F.count_if(option).alias("n_options"),
        F.max(F.when(answer, F.trim(F.regexp_extract("line", r"[:：]\s*(.*)$", 1)))).alias("answer"),
        F.sort_array(F.collect_list(F.when(~F.col("is_head") & ~option & ~answer, F.struct("line_no", "line")))).alias("more"),
    )
    return g.select("paper_id", F.col("item").cast("int").alias("item"), "number", "section", F.concat_ws(" ", F.array("first"), F.transform("more", lambda x: x["line"])).alias("stem"), "n_options", "answer")


def hash_vectors(texts: DataFrame, dims: int = 64) -> DataFrame:
    """(key, vec) from (key, text): runs of two and three characters, each counted at the first four bytes of its SHA-256
    modulo dims, to unit length. Row by row in Arrow batches; each different run is hashed once a batch."""
    schema = pa.schema([("key", pa.string()), ("vec", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            place: dict[str, int] = {}
            out = []
            for text in b.column(1).to_pylist():
                v = np.zeros(dims)
                for n in (2, 3):
                    for i in range(len(text) - n + 1):
                        g = text[i : i + n]
                        if (at := place.get(g)) is None:
                            at = place[g] = int.from_bytes(hashlib.sha256(g.encode()).digest()[:4], "big") % dims
                        v[at] += 1
                out.append((v / np.linalg.norm(v) if v.any() else v).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, schema.field(1).type)], schema=schema)

    return texts.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key string, vec array<double>")


def ranked(rows: DataFrame, by: str, bucket: Column, order: list, name: str) -> DataFrame:
    """rows with their place in the order within `by`. `bucket` is a whole number that rises with the order: rows are
    ranked per bucket, and the buckets' counts are summed, so no task holds all rows of a group."""
    r = rows.withColumn("_b", bucket)
    n = r.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order)) + F.col("_before")
    return r.join(n, [by, "_b"]).withColumn(name, place.cast("bigint")).drop("_b", "_before")


def visible(docs: DataFrame, user: str, role: str, consents: DataFrame | None = None) -> DataFrame:
    """The documents that a user may see, before anything is ranked: public and course ones, own ones, and consented ones
    of owners who granted it to this teacher. Without a table of consents none counts as granted."""
    if role == "admin":
        return docs
    mine = F.col("owner_user_id") == user
    open_to_all = F.col("visibility").isin("public", "course")
    base = docs.where(open_to_all | (F.col("visibility").isin("private", "consented") & mine))
    if role != "teacher" or consents is None:
        return base
    granted = consents.where((F.col("teacher_id") == user) & (F.col("state") == "granted")).select(F.col("student_id").alias("owner_user_id")).distinct()
    more = docs.where((F.col("visibility") == "consented") & (F.col("owner_user_id") != user)).join(granted, "owner_user_id", "left_semi")
    return base.unionByName(more.select(*base.columns))


def search(docs: DataFrame, queries: DataFrame, top: int = 20, dims: int = 64) -> DataFrame:
    """(query, id, text_rank, vector_rank, rrf) of the `top` documents for each stated query: documents (id, title, body,
    tags, updated_at). Title 2, body 1 and any tag 1.5 make the text score; hashed vectors make the other order; the ranks
    are fused by reciprocal rank. The queries are a stated set and are sent to all tasks; every document meets each."""
    k = F.broadcast(queries.select("query").distinct())  # a stated set, checked by the caller
    q = F.lower("query")
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    j = docs.join(k)
    score = F.when(has("title"), 2.0).otherwise(0.0) + F.when(has("body"), 1.0).otherwise(0.0) + F.when(F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.lower(x).contains(q)), 1.5).otherwise(0.0)
    words = j.select("query", "id", "updated_at", score.alias("score")).where("score > 0")
    # half points of score, then days, newest first
    bucket = -(F.col("score") * 2).cast("bigint") * 1_000_000 - F.coalesce(F.floor(F.unix_micros("updated_at") / F.lit(86_400_000_000)), F.lit(0))
    words = ranked(words, "query", bucket, [F.desc("updated_at"), "id"], "text_rank").select("query", "id", "text_rank")
    v = hash_vectors(docs.select(F.col("id").alias("key"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))).alias("text")), dims)
    qv = F.broadcast(hash_vectors(k.select(F.col("query").alias("key"), F.col("query").alias("text")), dims).select(F.col("key").alias("query"), F.col("vec").alias("qvec")))
    near = v.join(qv).select("query", F.col("key").alias("id"), F.round(t.cosine_distance(F.col("vec"), F.col("qvec")), 9).alias("dist"))
    near = ranked(near, "query", F.floor(F.col("dist") * 10_000).cast("bigint"), ["dist", "id"], "vector_rank").select("query", "id", "vector_rank")
    both = words.join(near, ["query", "id"], "full").withColumn("rrf", t.reciprocal_rank(F.col("text_rank"), F.col("vector_rank")))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("rrf", 12)), "id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= min(max(top, 1), 50))


def around(chunks: DataFrame, reach: int = 1) -> DataFrame:
    """(doc_id, idx, context): each chunk's text with those up to `reach` places before and after, joined by line ends; of
    rows with one (doc_id, idx) the greatest text counts. A chunk is sent to its neighbours' places, so a long document
    is spread over tasks."""
    c = chunks.where("doc_id is not null and idx is not null and text is not null").groupBy("doc_id", "idx").agg(F.max("text").alias("text"))
    sent = c.select("doc_id", F.col("idx").alias("src"), "text", F.explode(F.sequence(F.col("idx") - reach, F.col("idx") + reach)).alias("idx"))
    g = sent.groupBy("doc_id", "idx").agg(F.sort_array(F.collect_list(F.struct("src", "text"))).alias("x"))
    return g.join(c.select("doc_id", "idx"), ["doc_id", "idx"], "left_semi").select("doc_id", "idx", F.array_join(F.transform("x", lambda y: y["text"]), "\n").alias("context"))
