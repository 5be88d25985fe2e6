"""Reports, samples and merges over pages, documents, packs and exam items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.functions import text as t
from loomgraph.operators.hierarchy import hierarchy

PAGE_MARK = r"\n\n===== PAGE (\d+) =====\n"


def status_counts(docs: DataFrame, by: str, status: str, known: list[str]) -> DataFrame:
    """(by, one column per known status): counts, in one pass of partial sums."""
    return docs.groupBy(F.coalesce(by, F.lit("(none)")).alias(by)).agg(*[F.count_if(F.col(status) == s).alias(s) for s in known])


def sampled_pages(pages: DataFrame, n: int = 5) -> DataFrame:
    """(doc_path, page_no): the first, the last and evenly spaced pages between, n of a book, without a random choice; a
    book of n pages or fewer has all."""
    p = pages.where("doc_path is not null and page_no is not null").select("doc_path", "page_no").distinct()
    p = p.withColumn("i", F.row_number().over(Window.partitionBy("doc_path").orderBy("page_no")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc_path")))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("k") - 1) / F.lit(n - 1)))
    return p.where((F.col("k") <= n) | F.array_contains(at, F.col("i").cast("bigint"))).select("doc_path", "page_no")


def weak_pages(pages: DataFrame, floor: int = 20, share: float = 0.4, full: int = 60, least: int = 3) -> DataFrame:
    """(doc_path, page_no, chars, bar): pages with fewer characters than `share` of the median of the book's pages of
    `full` or more, and than `floor` at least; books with fewer than `least` such pages have none."""
    p = pages.where("doc_path is not null and page_no is not null").groupBy("doc_path", "page_no").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    m = p.where(F.col("chars") >= full).groupBy("doc_path").agg(F.percentile("chars", f.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    bar = F.greatest(f.lit(floor), f.lit(share) * F.col("m"))
    return p.join(m, "doc_path").select("doc_path", "page_no", "chars", bar.alias("bar")).where("chars < bar")


def page_probes(pages: DataFrame, docs: DataFrame, size: int = 18) -> DataFrame:
    """(doc_path, page_no, hit): how many of three probes of a page, at 20, 50 and 80 % of its text, stand in the joined
    text of its book. Pages shorter than a probe are left out. The joined text is cut into its pages first, so what is
    shuffled is a page each."""
    p = pages.where(F.length("text") >= size).groupBy("doc_path", "page_no").agg(F.min("text").alias("text"))
    d = joined_pages(docs).withColumnRenamed("text", "joined")
    at = lambda x: F.substring("text", F.floor((F.length("text") - size) * F.lit(x)).cast("int") + 1, F.lit(size))
    hit = sum((F.when(F.instr("joined", at(x)) > 0, 1).otherwise(0) for x in (0.2, 0.5, 0.8)), F.lit(0))
    return p.join(d, ["doc_path", "page_no"], "left").select("doc_path", "page_no", F.coalesce(hit, F.lit(0)).alias("hit"))


def joined_pages(docs: DataFrame) -> DataFrame:
    """(doc_path, page_no, text): the pages of joined texts, by their marks; of several the least."""
    d = docs.where("doc_path is not null and text is not null").select("doc_path", F.regexp_extract_all(F.concat(F.lit("\n\n"), F.ltrim("text")), F.lit(PAGE_MARK), F.lit(1)).alias("no"), F.split(F.concat(F.lit("\n\n"), F.ltrim("text")), PAGE_MARK).alias("x"))
    e = d.select("doc_path", F.explode(F.arrays_zip("no", F.slice("x", 2, 1_000_000).alias("text"))).alias("y"))
    return e.select("doc_path", F.col("y.no").cast("int").alias("page_no"), F.col("y.text").alias("text")).groupBy("doc_path", "page_no").agg(F.min("text").alias("text"))


def page_pairs(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_path, page_no, chars, joined_chars): each page beside the same page of the joined text, where there is one."""
    p = pages.where("doc_path is not null and page_no is not null").groupBy("doc_path", "page_no").agg(F.min("text").alias("text"))
    d = joined_pages(docs).withColumnRenamed("text", "joined")
    return p.join(d, ["doc_path", "page_no"], "left").select("doc_path", "page_no", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.length("joined").alias("joined_chars"))


def book_report(quality: DataFrame, worst: int = 10) -> DataFrame:
    """(doc_path, pages, mean_score, worst): counts, the mean score, and the pages of the lowest scores in order."""
    best = Window.partitionBy("doc_path").orderBy(F.round("score", 9), "page_no")
    w = quality.withColumn("i", F.row_number().over(best)).where(F.col("i") <= worst).groupBy("doc_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "page_no"))), lambda x: x["page_no"].cast("string")), ",").alias("worst"))
    return quality.groupBy("doc_path").agg(F.count(F.lit(1)).alias("pages"), F.avg("score").alias("mean_score")).join(w, "doc_path")


def owning_chapters(tokens_by_chapter: DataFrame) -> DataFrame:
    """(doc_path, token, chapter, n) from (doc_path, token, chapter): the chapter that a token stands in most often; of
    several the first."""
    c = tokens_by_chapter.groupBy("doc_path", "token", "chapter").agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("doc_path", "token").agg(F.max(F.struct("n", (-F.col("chapter")).alias("m"))).alias("x"))
    return best.select("doc_path", "token", (-F.col("x.m")).alias("chapter"), F.col("x.n").alias("n"))


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pack_id, triple): 'name -[type]-> name' of each different edge; an end without a name stands as its id."""
    n = nodes.where("kp_id is not null").groupBy("pack_id", "kp_id").agg(F.min("kp_name").alias("name"))
    e = edges.where("pack_id is not null and from_kp is not null and to_kp is not null and edge_type is not null").select("pack_id", "from_kp", "to_kp", F.lower(F.btrim("edge_type", F.lit(" \t\n\r　 "))).alias("kind")).distinct()
    for end in ("from", "to"):
        e = e.join(n.select("pack_id", F.col("kp_id").alias(f"{end}_kp"), F.col("name").alias(end)), ["pack_id", f"{end}_kp"], "left")
    return e.select("pack_id", F.concat(F.coalesce("from", "from_kp"), F.lit(" -["), "kind", F.lit("]-> "), F.coalesce("to", "to_kp")).alias("triple")).distinct()


def cotested(items: DataFrame) -> DataFrame:
    """(a, b, items): pairs of knowledge points that an exam item names together. The pairs come from the item's own short
    list, row by row."""
    x = items.where("item_id is not null and kps is not null").select("item_id", F.array_sort(F.array_distinct(F.filter("kps", lambda k: k.isNotNull()))).alias("k")).distinct()
    pairs = F.flatten(F.transform("k", lambda a, i: F.transform(F.slice("k", i + 2, F.greatest(F.size("k"), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return x.select("item_id", F.explode(pairs).alias("p")).select("item_id", "p.*").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("items"))


def merged_edges(first: DataFrame, then: DataFrame, most: int = 300) -> DataFrame:
    """(pack_id, from_kp, to_kp, weight, origin): the edges of both, those of `first` before those of `then`, each pair once,
    `most` of a pack (the feature is a top-k): by origin, then weight, then the ends."""
    u = first.withColumn("origin", F.lit(1)).unionByName(then.withColumn("origin", F.lit(2)))
    u = u.groupBy("pack_id", "from_kp", "to_kp").agg(F.min(F.struct("origin", (-F.col("weight")).alias("w"))).alias("x")).select("pack_id", "from_kp", "to_kp", (-F.col("x.w")).alias("weight"), F.col("x.origin").alias("origin"))
    w = Window.partitionBy("pack_id").orderBy("origin", F.desc("weight"), "from_kp", "to_kp")
    return u.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).drop("i")


def cycle_paths(parents: DataFrame, cycles: DataFrame) -> DataFrame:
    """(pack_id, cycle, path): each cycle from its first node back to it. The first node's link is cut, and the paths of
    the chain that is left are those of hierarchy()."""
    c = cycles.join(parents, ["pack_id", "kp_id"]).select("pack_id", "kp_id", "cycle", F.when(F.col("kp_id") != F.col("cycle"), F.col("parent")).alias("parent"))
    paths = hierarchy(c.select("pack_id", "kp_id", "parent"))
    last = paths.groupBy("pack_id", "root_kp").agg(F.max_by("path", "depth").alias("p"))
    return last.select("pack_id", F.col("root_kp").alias("cycle"), F.concat(F.array_join("p", ">"), F.lit(">"), "root_kp").alias("path"))


def intent_scores(utterances: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, intent, score, rank) of utterances (key, text) for a stated set of anchors (intent, phrase): an anchor that the
    text holds weighs 0.5 + 0.5 x its length, up to 8; the best, half of the others up to 1, and 0.15 x the share of the
    text that anchors cover make the score, within 0 to 1. The two best intents of each."""
    a = F.broadcast(anchors.select("intent", F.lower("phrase").alias("phrase")).distinct())  # a stated set
    u = utterances.where("key is not null and length(text) > 0").select("key", F.lower("text").alias("text")).distinct()
    j = u.join(a, F.col("text").contains(F.col("phrase")))
    weight = f.lit(0.5) + f.lit(0.5) * F.least(F.length("phrase") / f.lit(8), f.lit(1))
    g = j.groupBy("key", "intent").agg(F.max(weight).alias("best"), F.sum(weight).alias("all"), F.sum(F.length("phrase")).alias("covered"), F.max(F.length("text")).alias("n"))
    s = f.clamp(F.col("best") + f.lit(0.5) * F.least(F.col("all") - F.col("best"), f.lit(1)) + f.lit(0.15) * F.least(F.col("covered") / F.col("n"), f.lit(1)), 0, 1)
    g = g.select("key", "intent", f.half_even(s).alias("score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "intent"))).where("rank <= 2")


def claims(c: Column) -> Column:
    """Whether a text names a percentage or a number of points (not of minutes)."""
    return c.rlike(r"[0-9]+(\.[0-9]+)?\s*(%|个百分点)|[0-9]+(\.[0-9]+)?\s*分([^钟]|$)")


def first_hit(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, first, longest): of a stated set of patterns (pattern) the one that stands first in the text (key, text) and
    the longest that stands in it."""
    p = F.broadcast(patterns.select(F.lower("pattern").alias("p")).distinct())  # a stated set
    j = texts.select("key", t.plain_width(F.col("text")).alias("x")).distinct().join(p, F.col("x").contains(F.col("p")))
    g = j.groupBy("key").agg(F.min(F.struct(F.instr("x", F.col("p")).alias("at"), (-F.length("p")).alias("l"), "p")).alias("f"), F.min(F.struct((-F.length("p")).alias("l"), "p")).alias("m"))
    return g.select("key", F.col("f.p").alias("first"), F.col("m.p").alias("longest"))


def changes(versions: DataFrame, key: str, at: str, cols: list[str]) -> DataFrame:
    """(key, at, changed): whether a version differs from the one before, by the digest of its columns; the first does."""
    v = versions.where(F.col(key).isNotNull()).withColumn("_h", F.sha2(F.to_json(F.struct(*cols)), 256)).groupBy(key, at).agg(F.max("_h").alias("_h"))
    before = F.lag("_h").over(Window.partitionBy(key).orderBy(at))
    return v.select(key, at, (before.isNull() | (before != F.col("_h"))).alias("changed"))


def best_questions(candidates: DataFrame) -> DataFrame:
    """(student_id, question_id, priority) from (student_id, question_id, difficulty, score, impact, age): the question with
    the highest priority of each student; of several the first."""
    p = candidates.withColumn("priority", F.round(f.question_priority(F.col("difficulty"), F.col("score"), F.col("impact"), F.col("age")), 9))
    b = p.groupBy("student_id").agg(F.min(F.struct((-F.col("priority")).alias("m"), "question_id")).alias("x"))
    return b.select("student_id", F.col("x.question_id").alias("question_id"), (-F.col("x.m")).alias("priority"))


def rotated(bank: DataFrame, by: str, order: str, cursor: int, n: int) -> DataFrame:
    """n rows of each group from the cursor on, going round."""
    w = Window.partitionBy(by)
    r = bank.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_k", F.count(F.lit(1)).over(w))
    return r.where(F.pmod(F.col("_i") - cursor, F.col("_k")) < n).drop("_i", "_k")
