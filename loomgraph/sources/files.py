"""Readers and writers: graph packs, question banks, JSON lines, recognised words, documents, parts of uploads."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "id string, name string, course string, description string"
EDGES = "from string, to string, edgeType string, weight double, source string"
PACK = "nodes array<struct<kp_id:string,title:string,course:string,difficulty:int,kind:string,why:string,ord:int>>, edges array<struct<from_kp:string,to_kp:string,edge_type:string,weight:double,why:string>>"
QUESTION = "map<string, array<struct<kp:string,type:string,difficulty:int,estMin:int,stem:string,options:array<string>,correctIndex:int,why:string>>>"
#: Bounds of an archive: entries, and bytes after unpacking.
ENTRIES, UNPACKED = 5_000, 200_000_000
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp", "txt", "md", "csv", "tsv", "json", "docx", "pptx", "epub", "html", "htm")


def pack_files(spark: SparkSession, nodes: str, edges: str, pack_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a pack in two JSON files of arrays, in the columns of knowledge_nodes and knowledge_edges."""
    n = spark.read.schema(NODES).option("multiLine", True).json(nodes)
    e = spark.read.schema(EDGES).option("multiLine", True).json(edges)
    return (
        n.select(F.lit(pack_id).alias("pack_id"), F.col("id").alias("kp_id"), F.col("name").alias("kp_name"), "course", "description"),
        e.select(F.lit(pack_id).alias("pack_id"), F.col("from").alias("from_kp"), F.col("to").alias("to_kp"), F.col("edgeType").alias("edge_type"), "weight", "source"),
    )


def pack_file(spark: SparkSession, path: str, pack_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a pack in one JSON file, whose fields have other names."""
    p = spark.read.schema(PACK).option("multiLine", True).json(path)
    n = p.select(F.explode("nodes").alias("x")).select(F.lit(pack_id).alias("pack_id"), "x.kp_id", F.col("x.title").alias("kp_name"), "x.course", F.col("x.why").alias("description"), "x.difficulty", "x.kind", "x.ord")
    e = p.select(F.explode("edges").alias("x")).select(F.lit(pack_id).alias("pack_id"), "x.from_kp", "x.to_kp", "x.edge_type", "x.weight", F.col("x.why").alias("source"))
    return n, e


def export_json(df: DataFrame, path: str) -> None:
    """df as JSON lines, nulls left out."""
    df.write.mode("overwrite").json(path)


def question_bank(texts: DataFrame, col: str = "value") -> DataFrame:
    """(bank, no, kp, type, difficulty, est_min, stem, options, correct_index, why) from JSON objects bank -> questions;
    missing fields have their defaults; a text that can't be read gives no row."""
    m = texts.select(F.explode(F.from_json(col, QUESTION)).alias("bank", "qs")).select("bank", F.posexplode("qs").alias("no", "q"))
    d = lambda c, x: F.coalesce(F.col(f"q.{c}"), F.lit(x))
    return m.select("bank", "no", d("kp", "").alias("kp"), d("type", "choice").alias("type"), d("difficulty", 3).alias("difficulty"), d("estMin", 5).alias("est_min"), d("stem", "").alias("stem"), F.coalesce("q.options", F.array().cast("array<string>")).alias("options"), d("correctIndex", 0).alias("correct_index"), d("why", "").alias("why"))


def json_lines(spark: SparkSession, path: str, schema: str, key: list[str], last: bool = True) -> DataFrame:
    """The rows of JSON lines, cut at line feeds only; a line that can't be read is left out; of the rows of a key the last
    in its file counts (of several files, that of the last path)."""
    t = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    r = t.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"), "_path", "_block", "_at").where("x is not null and x._bad is null")
    r = r.select("x.*", "_path", "_block", "_at").drop("_bad")
    if not last:
        return r.drop("_path", "_block", "_at")
    by = Window.partitionBy(*key).orderBy(F.desc("_path"), F.desc("_block"), F.desc("_at"))
    return r.withColumn("_i", F.row_number().over(by)).where("_i = 1").drop("_i", "_path", "_block", "_at")


def recognised_words(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """(page, block, par, line, word, x, y, w, h, conf, text) from tab-separated words of a recogniser: rows of fewer than
    twelve columns, words under the least confidence, and single characters that are no digits are left out."""
    c = F.split("value", "\t")
    r = spark.read.option("lineSep", "\n").text(path).where(F.size(c) >= 12)
    names = ["level", "page", "block", "par", "line", "word", "x", "y", "w", "h"]
    r = r.select(*[F.try_element_at(c, F.lit(i + 1)).try_cast("int").alias(n) for i, n in enumerate(names)], c[10].try_cast("double").alias("conf"), F.btrim(c[11]).alias("text"))
    return r.where((F.col("conf") >= least) & (F.length("text") > 0) & ((F.length("text") > 1) | F.col("text").rlike("[0-9]"))).drop("level")


def word_lines(words: DataFrame, tolerance: int = 12) -> DataFrame:
    """(page, line_no, text): words whose heights follow each other within the tolerance make a line, left to right. A lag
    flags the jumps of a page and their running sum numbers the lines."""
    by = Window.partitionBy("page").orderBy("y", "x", "text")
    new = F.coalesce((F.col("y") - F.lag("y").over(by) > tolerance).cast("int"), F.lit(0))
    r = words.withColumn("new", new).withColumn("line_no", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return r.groupBy("page", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("text"))


def _xml(s: str) -> str:
    s = re.sub(r"<(?:w|a):p\b[^>]*/>|</(?:w|a):p>|<(?:w|a):br\b[^>]*/>", "\n", s).replace("<w:tab/>", "\t")
    return _spaced(html.unescape(re.sub(r"<[^>]+>", "", s)))


def _spaced(s: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", s))).strip()


def _html(s: str) -> str:
    s = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "", s)
    s = re.sub(r"(?i)</(?:p|div|li|tr|h[1-6]|blockquote|section|article|figcaption)\s*>|<br\s*/?>", "\n", s)
    return _spaced(html.unescape(re.sub(r"<[^>]+>", "", s)))


def _number(name: str) -> int:
    m = re.search(r"\d+", name.rsplit("/", 1)[-1])
    return int(m.group()) if m else 0


def _entries(raw: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) > ENTRIES or sum(i.file_size for i in infos) > UNPACKED:
            raise ValueError("the archive is too large")
        return {i.filename: z.read(i) for i in infos if not i.is_dir()}


def _docx(e: dict[str, bytes]) -> str:
    out = []
    for body in re.findall(r"(?s)<w:p\b[^>]*>(.*?)</w:p>", e["word/document.xml"].decode("utf-8", "replace")):
        style = re.search(r'<w:pStyle\s+w:val="([^"]+)"', body)
        level = re.fullmatch(r"(?i)(?:heading|标题)?\s*([1-3])", style.group(1)) if style else None
        depth = int(level.group(1)) if level else int(bool(style and re.match(r"(?i)heading|标题", style.group(1))))
        if text := _xml(body):
            out.append("#" * depth + " " * (depth > 0) + text)
    text = "\n".join(out)
    if sum(c.isalnum() for c in text) < 200:
        more = [_xml(v.decode("utf-8", "replace")) for k, v in sorted(e.items()) if re.fullmatch(r"word/(?:header|footer|footnotes|endnotes)\d*\.xml", k)]
        text = "\n".join([text, *filter(None, more)]).strip("\n")
    return text


def _pptx(e: dict[str, bytes]) -> str:
    part = lambda where: sorted((k for k in e if re.fullmatch(where, k)), key=_number)
    out = [f"[slide {i}]\n{_xml(e[k].decode('utf-8', 'replace'))}" for i, k in enumerate(part(r"ppt/slides/slide\d+\.xml"), 1)]
    notes = [(i, _xml(e[k].decode("utf-8", "replace"))) for i, k in enumerate(part(r"ppt/notesSlides/notesSlide\d+\.xml"), 1)]
    return "\n".join([*out, *[f"[notes {i}]\n{x}" for i, x in notes if x]])


def _epub(e: dict[str, bytes]) -> str:
    opf = re.search(r'full-path\s*=\s*"([^"]+)"', e["META-INF/container.xml"].decode("utf-8", "replace")).group(1).lstrip("/")
    xml, base = e[opf].decode("utf-8", "replace"), opf.rpartition("/")[0]
    attr = lambda tag, name: (m := re.search(rf'\b{name}\s*=\s*"([^"]+)"', tag)) and m.group(1)
    href = {attr(x, "id"): html.unescape(attr(x, "href") or "") for x in re.findall(r"<item\b[^>]*>", xml)}
    spine = [href[i] for x in re.findall(r"<itemref\b[^>]*>", xml) if (i := attr(x, "idref")) in href] or list(href.values())
    found = (e.get(f"{base}/{h}".lstrip("/")) or e.get(h) for h in spine[:600])
    return "\n\n".join(filter(None, (_html(x.decode("utf-8", "replace")) for x in found if x)))


def _legacy(raw: bytes) -> str:
    """Runs of readable UTF-16 text; a run of mostly consecutive code points is a table of the font and is left out."""
    runs = re.findall(r"[\w\s.,;:!?()，。；：？！、“”‘’《》（）-]{4,}", raw.decode("utf-16-le", "ignore"))
    steps = lambda x: sum(ord(b) - ord(a) == 1 for a, b in zip(x, x[1:], strict=False)) / max(1, len(x) - 1)
    return "\n".join(x.strip() for x in runs if x.strip() and steps(x) < 0.6)


def text_of(name: str, raw: bytes) -> tuple[str, str | None]:
    """(text, error) of a file by its extension."""
    kind = name.rsplit(".", 1)[-1].lower()
    try:
        if kind in ("docx", "pptx", "epub"):
            return {"docx": _docx, "pptx": _pptx, "epub": _epub}[kind](_entries(raw)), None
        if kind in ("html", "htm"):
            return _html(raw.decode("utf-8", "replace")), None
        if kind in ("doc", "ppt"):
            return _legacy(raw), None
        if kind in ("txt", "md", "csv", "tsv", "json"):
            return raw.decode("utf-8-sig", "replace"), None
        return "", f"no reader for .{kind}"
    except (KeyError, ValueError, AttributeError, zipfile.BadZipFile) as x:
        return "", f"{type(x).__name__}: {x}"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, bytes, text, error): the texts of the files under a path, each read by its extension in the executors;
    a file that can't be read has an error and an empty text."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for p, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # an upload's name may have its id of 32 digits before it
                name = re.sub(r"^[0-9a-f]{32}_", "", p.rsplit("/", 1)[-1])
                rows.append((p, name, n, *text_of(name, raw)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("n"), "content")
    return f.mapInArrow(run, "path string, name string, bytes bigint, text string, error string")


def allowed(files: DataFrame, col: str = "name") -> DataFrame:
    """Files whose extension may be uploaded."""
    return files.where(F.lower(F.regexp_extract(col, r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS))


def joined_parts(parts: DataFrame) -> DataFrame:
    """(upload_id, text, n_parts): the parts (upload_id, idx, part) of uploads in order; of one place the greatest counts."""
    p = parts.where("upload_id is not null and idx is not null and part is not null").groupBy("upload_id", "idx").agg(F.max("part").alias("part"))
    return p.groupBy("upload_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "part"))), lambda x: x["part"]), "").alias("text"), F.count(F.lit(1)).alias("n_parts"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The rows of both, of each key that of the greatest version; new rows win over old ones of the same version. Nothing
    is deleted."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = Window.partitionBy(*key).orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_i", F.row_number().over(by)).where("_i = 1").drop("_i", "_new")


def not_cached(pages: DataFrame, cache: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, key) of the pages whose key, the SHA-1 of these columns, isn't in cache (key)."""
    keyed = pages.withColumn("key", F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])))
    return keyed.join(cache.select("key"), "key", "left_anti")
