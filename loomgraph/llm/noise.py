"""Noise of scanned pages: lines that belong to the page, words broken at line ends, and misread characters."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import skipgram
from loomgraph.llm.canonical import transducer
from loomgraph.runtime import stash

# Glyph edits, what was recognised and what may have stood there; in numbers, the digits behind letters.
EDITS = {
    "!": "i", "|": "l", "0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "c": "e", "e": "c", "f": "t", "t": "f", "o": "a", "a": "o",
    "b": "h", "h": "b", "i": "l", "l": "i", "ri": "n", "n": "ri", "ii": "u", "u": "ii", "cl": "d", "d": "cl", "rn": "m", "m": "rn", "vv": "w", "w": "vv", "nn": "m",
}
DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "!": "1", "Z": "2", "S": "5", "B": "8"}
# Ideographs of nearly the same shape.
SHAPES = (
    "习刁 见兄贝 生牛 年牛 午牛 本木 矩炬 证征 元兀无 科料 对双权 组纽 约钓 误吴 已己巳 计汁 额颔 有冇 是昰 明朋 余佘 常赏 偿赏 划刘 列刘 函凾 账帐 借惜 完宪 均圴 末未 单単 "
    "人入 日曰 土士 大太 天夫 千干 于干 例列 土士 王玉 目日 白自 问间 向问 折拆 拔拨 待侍 复夏 晴睛 析折 材村 技枝 检捡 便使 侯候 贷货 治冶 沙抄 第笫 数敉 学字 田由 由甲 申甲 刀力 几儿 开井 设没 说悦 线钱 结给 请清 情清 错借 练炼 题提 量里 了子 不下 么公 用月 主王 正止 同问 因困 回口 图囹 项顶 预项 值植 率卒 度席 记纪 导异 积枳 分兮 合台 会公 法怯 样徉 总恙 析拆 程桯 存在"
)
TWINS: dict[str, set[str]] = {}
for _g in SHAPES.split():
    for _c in _g:
        TWINS.setdefault(_c, set()).update(set(_g) - {_c})

HAN = "㐀-鿿"
UNSPACED = re.compile(f"[{HAN}，。；：？！、“《（”》）…]")
UNSPACED_OR_DIGIT = re.compile(f"[{HAN}，。；：？！、“《（”》）…0-9]")
IS_HAN = re.compile(f"[{HAN}]")
#: A word or a part of one, with marks that stand for letters inside it.
PART = re.compile(r"(?<![\w!|])(?:[!|](?=[a-z]))?[0-9A-Za-zÀ-ɏ]+(?:[!|]+[A-Za-zÀ-ɏ]+)*")
NUMBER = re.compile(r"(?<![A-Za-z0-9_/.,!|=?-])(?=[A-Za-z.,!|]*[0-9])(?=[0-9.,]*[OoIlZSB|!])[0-9OoIlZSB][0-9OoIlZSB|!]*(?:[.,][0-9OoIlZSB|]+)*(?![A-Za-z_/=])")
#: A letter or mark beside digits, without which no number is misread.
DIGIT_LIKE = re.compile(r"[0-9.,][OoIlZSB|!]|[OoIlZSB|!][0-9.,]")
PLAIN = re.compile(r"(?<![\w.,/-])[0-9]+(?:[.,][0-9]+)*(?![\w/])")
CELL = re.compile(r"[A-Z][0-9]")
MARKS = "-¬"
INDENT = "　"
SPACES, DIGIT_RUN = re.compile(r"\s+"), re.compile(r"\d(?:\s*\d)*")
#: How little a far more frequent word may fit among the words around before the link to it is dropped, and how much
#: better a frequent word must fit than the frequent word that stands there (sums of logs).
UNFIT, FITTER = -4.0, 12.0
#: Pages of a stretch of a book that one task reads, and of the stretches beside it that it sees.
STRETCH, BESIDE = 64, 3
#: Rows of what was learnt that are sent to all tasks; if there are more, each stretch gets those that concern it.
SENT = 400_000
LEFT = re.compile(r"([^\W_][^\W_!|]*(?:[!|]+[^\W_]+)*)\s*[-¬]$")
PAGE_BREAK = re.compile(r"(?:^|\n\n)===== PAGE (\d+) =====\n")
BEFORE = re.compile(r"([^\W\d_]+|\W)\s*$")
GAP = re.compile(r"\s{2,}")
ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
COUNTED = re.compile(r"(?:[-—–·\[(|]\s*([0-9]{1,4})\s*[-—–·\])|]|第\s*([0-9]{1,4})\s*[页頁]|(?:page|seite|p\.|s\.)\s*([0-9]{1,4})(?:\s*(?:of|von|/)\s*[0-9]{1,4})?|([0-9]{1,4})\s*/\s*[0-9]{1,4})", re.I)
#: What may be a misread number of a page.
FOLDED = re.compile(r"(?<!\w)[0-9OoIlZSB]{2,4}(?!\w)")
CHAPTER = re.compile(r"第\s*([0-9OoIlZSB]+)\s*章(?=\s|$)|([A-Za-z0-9!|]{5,7}[A-Za-z!|])\s*([0-9OoIlZSB]+)(?=\s*:|\s+[A-ZÄÖÜ]|$)")
TITLE = re.compile(r"《[^》]+》第\s*[0-9]+\s*[册卷]|(?:[A-ZÄÖÜ][\w!|]*[ -]){2,}[0-9]{1,2}")
DIGIT_OF = str.maketrans(DIGITS)
SKELETON = str.maketrans("0156!|l9", "olsbiiig")


def skeleton(line: str) -> str:
    """A line without spaces, marks, case and the most frequent misreadings."""
    return re.sub(r"[\W_]", "", line.lower().translate(SKELETON))


def lines_of(text: str) -> list[str]:
    """The lines in canonical form, without white space around them; a soft hyphen at an end is kept as a hyphen."""
    apply = transducer().apply
    out = []
    for raw in text.split("\n"):
        raw = raw.rstrip()
        out.append(apply(raw[:-1] + "-" if raw.endswith("­") else raw).strip())
    return out


def shaped(text: str) -> str:
    """The lines of lines_of in one text; a line that was indented by an ideographic space keeps it, unless it is blank."""
    return "\n".join(INDENT * (x != "" and raw.startswith(INDENT)) + x for raw, x in zip(text.split("\n"), lines_of(text), strict=True))


def shown_of(text: str) -> list[str]:
    """The lines of a page in its canonical form without their indents; blank ones, also such of indents only, are left out."""
    return [x for y in text.split("\n") if (x := y.lstrip(INDENT))]


@functools.lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is white space, and a digit."""
    every = [chr(o) for o in range(0x110000)]
    return np.array([c.isspace() for c in every]), np.array([c.isdigit() for c in every])


def stream(lines: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The characters of the lines without spaces, a run of digits as one 0; where each stands in the lines joined by line
    ends; and where each line starts there."""
    space, digit = _classes()
    code = np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(~space[code])
    d = digit[code[at]]
    keep = ~(d & np.concatenate([[False], d[:-1]])) if len(at) else np.empty(0, bool)
    at = at[keep]
    starts = np.cumsum([0, *(len(x) + 1 for x in lines)])[:-1]
    return np.where(d[keep], ord("0"), code[at]).astype(np.uint32).tobytes().decode("utf-32-le"), at, starts


def threes(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The runs of three characters around an ideograph, as `stream` has them, with their numbers."""
    flat = "\x00\x00".join(SPACES.sub("", DIGIT_RUN.sub("0", x)) for x in texts)
    code = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(code) < 3:
        return [], np.empty(0, np.int64)
    han = (code >= 0x3400) & (code <= 0x9FFF)
    keep = (han[:-2] | han[1:-1] | han[2:]) & (code[:-2] > 0) & (code[1:-1] > 0) & (code[2:] > 0)
    key, n = np.unique(((code[:-2] << 42) | (code[1:-1] << 21) | code[2:])[keep], return_counts=True)
    return [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in key.tolist()], n


def observe(text: str, counts: dict[str, Counter]) -> None:
    """Adds a page in its canonical form to the counts: words, hyphenated pairs, words cut at line ends, what precedes
    numbers and names of cells, and short lines at the edges and inside of pages."""
    shown = shown_of(text)
    for i, x in enumerate(shown):
        if len(x) <= 60:
            counts["edge" if i < 2 or i >= len(shown) - 2 else "inside"][skeleton(x)] += 1
    broken, left = False, None
    for x in shown:
        ends = x[-1] in MARKS
        found = list(PART.finditer(x))
        if left and (r := PART.match(x)):
            counts["break"][f"{left}\t{r.group().lower()}"] += 1
        left = m.group(1).lower() if ends and (m := LEFT.search(x)) else None
        for i, m in enumerate(found):
            if (i == 0 and broken and m.start() == 0) or (ends and m.end() == len(x) - 1):
                continue
            if not m.group().isdigit():
                counts["word"][m.group().lower()] += 1
            if i and x[found[i - 1].end() : m.start()] == "-":
                counts["hyphen"][f"{found[i - 1].group()}-{m.group()}".lower()] += 1
        for kind, pattern in (("number", PLAIN), ("cell", CELL)):
            for m in pattern.finditer(x):
                if b := BEFORE.search(x, 0, m.start()):
                    counts[kind][b.group(1)[-8:]] += 1
        broken = ends


KINDS = ("word", "hyphen", "break", "number", "cell", "edge", "inside")


def edits(low: str) -> list[tuple[str, int, int, int]]:
    """(other word, from, to, number of edits): what `low` may be a misreading of, and which of its characters then are.
    A word with digits or strokes among its letters can have two."""
    odd = any(c.isdigit() or c in "!|" for c in low)
    if len(low) < 3 or low.isdigit():
        return []
    out: dict[str, tuple[int, int, int]] = {}
    starts = [(low, 0, 0)]
    for step in range(2 if odd else 1):
        following = []
        for s, a, z in starts:
            for i in range(len(s)):
                for k in (1, 2):
                    if i + k > len(s) or (to := EDITS.get(s[i : i + k])) is None:
                        continue
                    t = s[:i] + to + s[i + k :]
                    span = (i, i + k) if s is low else (min(a, i), max(z, i + k))
                    if t.isalpha():
                        out.setdefault(t, (*span, step + 1))
                    elif odd:
                        following.append((t, *span))
        starts = following
    return [(t, *x) for t, x in out.items()]


@dataclass
class Known:
    """What was learnt, as far as it concerns the pages at hand."""

    #: Words that may be misread: right word, from, to, whether the counts alone tell so, log of the ratio of the counts.
    link: dict[str, list[tuple[str, int, int, bool, float]]] = field(default_factory=dict)
    #: Pairs left, rest of words that are broken at a line's end.
    cut: set[str] = field(default_factory=set)
    three: dict[str, int] = field(default_factory=dict)
    #: What precedes numbers and hardly ever names of cells.
    plain: set[str] = field(default_factory=set)
    #: Skeletons of lines that stand only at the edges of pages, and of lines that stand mostly inside.
    title: set[str] = field(default_factory=set)
    inner: set[str] = field(default_factory=set)
    twins: dict[str, set[str]] = field(default_factory=dict)
    vectors: skipgram.Vectors | None = None

    def add(self, kind: str, key: str, value: str, a: int, z: int, sure: bool, n: float) -> None:
        if kind == "link":
            self.link.setdefault(key, []).append((value, a, z, sure, n))
        elif kind == "three":
            self.three[key] = int(n)
        else:
            getattr(self, kind).add(key)

    def corrected(self, word: str, around: tuple[list[str], list[str]] | None = None) -> tuple[str, int, int] | None:
        """(right word, from, to of the misread characters) if word is a misreading of a far more frequent one that fits
        among the words around it, or of another frequent one that fits there much better."""
        low = word.lower()
        best = None
        for right, a, z, sure, ratio in self.link.get(low, ()):
            e = 0.0
            if around and self.vectors:
                near = around[0] + around[1]
                e = self.vectors.fit(right, near) - (0.0 if sure else self.vectors.fit(low, near))
            if (e > UNFIT if sure else e + ratio > FITTER) and (best is None or (sure, e) > best[0]):
                best = (sure, e), (right, a, z)
        return best[1] if best else None

    def wrong_number(self, before: str, number: str) -> bool:
        if not CELL.fullmatch(number):
            return True
        b = BEFORE.search(before)
        return (b.group(1)[-8:] if b else "") in self.plain


def _counted(texts: DataFrame, f, ddl: str, schema: pa.Schema) -> DataFrame:
    """f(texts, held) adds to the counters by kind; each task adds up and sends its counts."""

    def run(batches):
        held: dict[str, Counter] = {}

        def flush():
            rows = [(k, key, n) for k, c in held.items() for key, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else None

        for b in batches:
            f(b.column(0).to_pylist(), held)
            if sum(map(len, held.values())) > 250_000 and (out := flush()) is not None:
                yield out
        if (out := flush()) is not None:
            yield out

    return texts.mapInArrow(run, ddl).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _observe_all(texts: list[str], held: dict[str, Counter]) -> None:
    for k in KINDS:
        held.setdefault(k, Counter())
    for t in texts:
        observe(t, held)
        held.setdefault("token", Counter()).update(skipgram.tokens(t))
    keys, n = threes(texts)
    held.setdefault("three", Counter()).update(dict(zip(keys, n.tolist(), strict=True)))


def twins(three: DataFrame) -> dict[str, set[str]]:
    """For each ideograph those it may be a misreading of: the fixed SHAPES, and pairs learnt from the texts.

    A run of three that is far rarer than the most frequent run with the same neighbours speaks for such a pair. A pair
    is taken if it has three different such neighbourhoods, if they hold most occurrences of the rarer ideograph, and if
    that is far rarer altogether. Each run speaks for one pair at most, so their number follows the runs."""
    c = three.select(F.substring("key", 1, 1).alias("l"), F.substring("key", 2, 1).alias("c"), F.substring("key", 3, 1).alias("r"), "n")
    most = c.groupBy("l", "r").agg(F.max(F.struct("n", "c")).alias("m")).where("m.n >= 8")
    total = c.groupBy("c").agg(F.sum("n").alias("total"))
    rare = c.join(most, ["l", "r"]).where("n * 15 <= m.n and c <> m.c").select("c", F.col("m.c").alias("right"), "n")
    pairs = rare.groupBy("c", "right").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("k")).where("frames >= 3")
    pairs = pairs.join(total, "c").join(total.select(F.col("c").alias("right"), F.col("total").alias("all")), "right").where("2 * k > total and total * 20 <= all")
    out = {c: set(ts) for c, ts in TWINS.items()}
    for r in pairs.select("c", "right").collect():
        out.setdefault(r["c"], set()).add(r["right"])
    return out


def _links(words: DataFrame, joined: DataFrame) -> DataFrame:
    """The words that glyph edits lead from to a more frequent one, with the edits; `joined` are broken words put together,
    which need not be words of their own."""
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("value", pa.string()), ("a", pa.int32()), ("z", pa.int32()), ("steps", pa.int32())])

    def run(batches):
        for b in batches:
            rows = [(w, n, *e) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in edits(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    all_words = words.unionByName(joined.join(words.select("key"), "key", "left_anti").select("key", F.lit(0).cast("bigint").alias("n")))
    c = all_words.mapInArrow(run, "key string, n bigint, value string, a int, z int, steps int")
    c = c.join(words.select(F.col("key").alias("value"), F.col("n").alias("m")), "value")
    odd = F.col("key").rlike("[0-9!|]")
    sure = F.when(odd, F.col("m") >= F.greatest(F.lit(2), 2 * F.col("n"))).otherwise(F.col("m") >= F.greatest(F.lit(8), 15 * (F.col("n") - 1)))
    c = c.withColumn("sure", sure).where("sure or (m >= 20 and n >= 5)")
    best = Window.partitionBy("key").orderBy(F.desc("sure"), "steps", F.desc("m"), "value")
    c = c.withColumn("rank", F.row_number().over(best)).where(~F.col("sure") | (F.col("rank") == 1))
    return c.select(F.lit("link").alias("kind"), "key", "value", "a", "z", "sure", (F.log("m") - F.log(F.greatest("n", F.lit(1)))).alias("n"))


def _over_pages(pages: DataFrame) -> DataFrame:
    """(key): left and rest of the words that may be broken over the end of a page, whatever furniture is between."""
    schema = pa.schema([("doc_path", pa.string()), ("page_no", pa.int32()), ("left", pa.string()), ("rest", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for path, no, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shown = shown_of(text)
                rows += [(path, no, m.group(1).lower(), None) for x in shown[-4:] if x[-1] in MARKS and (m := LEFT.search(x))]
                firsts = {r.group().lower() for r in map(PART.match, shown[:4]) if r}
                rows += [(path, no - k, None, w) for w in sorted(firsts) for k in range(1, BESIDE + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    ends = pages.select("doc_path", "page_no", "text").mapInArrow(run, "doc_path string, page_no int, left string, rest string")
    left, rest = ends.where("left is not null").drop("rest"), ends.where("rest is not null").drop("left")
    return left.join(rest, ["doc_path", "page_no"]).select(F.concat("left", F.lit("\t"), "rest").alias("key"))


def learn(pages: DataFrame) -> tuple[DataFrame, dict[str, set[str]], skipgram.Vectors]:
    """(what was learnt as rows of Known.add, pairs of ideographs, vectors) from the canonical texts of `pages`.

    Pages that were stored again, in whatever form, are read once. All counts and decisions are made on aggregated
    tables; only decisions that say something (a word that may be misread, a pair that is broken, ...) are kept.
    """
    texts = stash(pages.groupBy("h").agg(F.min("text").alias("text")).select("text"), "texts")
    schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("n", pa.int64())])
    c = stash(_counted(texts, _observe_all, "kind string, key string, n bigint", schema), "glyphs")
    of = lambda kind: c.where(F.col("kind") == kind).select("key", "n")
    pairs = twins(of("three"))
    vectors = skipgram.train(texts, of("token"))
    words = of("word")
    part = F.split("key", "\t")
    breaks = of("break").select("key").unionByName(_over_pages(pages)).distinct().select("key", part[0].alias("left"), part[1].alias("rest")).withColumn("joined", F.concat("left", "rest")).withColumn("dashed", F.concat("left", F.lit("-"), "rest"))
    links = stash(_links(words, breaks.select(F.col("joined").alias("key")).distinct()), "links")
    named = lambda df, key, n: df.select(F.col("key").alias(key), F.col("n").alias(n))
    sure = links.where("sure").select(F.col("key").alias("joined"), F.col("value").alias("to"))
    b = breaks.join(named(words, "joined", "nj"), "joined", "left").join(named(of("hyphen"), "dashed", "nh"), "dashed", "left")
    b = b.join(sure, "joined", "left").join(named(words, "left", "nl"), "left", "left").join(named(words, "rest", "nr"), "rest", "left")
    known_word = F.coalesce("nj", F.when(F.col("nh").isNull() & F.col("to").isNotNull(), F.lit(1)), F.lit(0))
    told = (known_word > 0) | F.col("nh").isNotNull()
    alone = ~F.col("rest").isin("und", "oder", "bzw", "and", "or") & (F.least(F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))) < 5)
    cut = b.where(F.when(told, known_word > F.coalesce("nh", F.lit(0))).otherwise(alone)).select("key")
    glyphs = "".join(sorted({*pairs, *(t for ts in pairs.values() for t in ts)}))
    plain = named(of("number"), "key", "n").join(named(of("cell"), "key", "m"), "key", "left").where("n >= 10 * greatest(1, coalesce(m, 0))")
    edge = named(of("edge"), "key", "n").join(named(of("inside"), "key", "m"), "key", "full").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    own = (F.length("key") > 3) & ~F.col("key").rlike("^[0-9]*$")
    rows = links
    for kind, df in (
        ("cut", cut), ("plain", plain), ("title", edge.where(own & (F.col("n") >= 5) & (F.col("m") == 0))), ("inner", edge.where(own & (F.col("n") + F.col("m") >= 2) & (F.col("n") <= 2 * F.col("m")))),
        ("three", of("three").where((F.col("n") >= 2) & F.col("key").rlike(f"[{glyphs}]"))),
    ):
        n = F.col("n").cast("double") if kind == "three" else F.lit(0.0)
        rows = rows.unionByName(df.select(F.lit(kind).alias("kind"), "key", F.lit("").alias("value"), F.lit(0).alias("a"), F.lit(0).alias("z"), F.lit(False).alias("sure"), n.alias("n")))
    return stash(rows, "known"), pairs, vectors


def page_number(part: str) -> tuple[int, bool] | None:
    """(number, whether its marks or words tell that it is a page number)."""
    if len(part) > 24:
        return None
    part = FOLDED.sub(lambda m: m.group() if ROMAN.fullmatch(m.group().lower()) else m.group().translate(DIGIT_OF), part)
    if re.fullmatch(r"[-—–·\[(|]\s*[0-9OoIlZSB]{1,4}\s*[-—–·\])|]", part):
        part = part[0] + part[1:-1].translate(DIGIT_OF) + part[-1]
    if m := COUNTED.fullmatch(part):
        return int(next(g for g in m.groups() if g)), True
    if re.fullmatch(r"[0-9]{1,4}", part):
        return int(part), False
    if part and len(part) < 9 and ROMAN.fullmatch(part.lower()) and part in (part.lower(), part.upper()):
        value = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in part.lower()]
        return sum(-v if any(w > v for w in value[i + 1 :]) else v for i, v in enumerate(value)), True
    return None


def chapter(part: str) -> int | None:
    m = CHAPTER.match(part)
    if not m or (m.group(2) and max(SequenceMatcher(None, m.group(2).lower(), w).ratio() for w in ("chapter", "kapitel", "section", "chapitre")) < 0.75):
        return None
    n = (m.group(1) or m.group(3)).translate(DIGIT_OF)
    return int(n)


def furniture(book: list[tuple[int, list[str]]], model: Known) -> set[tuple[int, int]]:
    """(page, line) by index of the running headers, footers and page numbers of a book's pages in order."""
    edges: Counter = Counter()
    offsets: Counter = Counter()
    shown = [[i for i, x in enumerate(lines) if x] for _, lines in book]
    for (no, lines), at in zip(book, shown, strict=True):
        known, values = set(), set()
        for i in {*at[:3], *at[-3:]}:
            for part in GAP.split(lines[i]):
                if p := page_number(part):
                    values.add(p[0] - no)
                elif chapter(part) is None:
                    known.add(skeleton(part))
        edges.update(known), offsets.update(values)
    inside = Counter(skeleton(lines[i]) for (_, lines), at in zip(book, shown, strict=True) for i in at[3:-3])
    # the numbers of a book run with its pages; a page left out or blank shifts them
    steady = {o + k for o, n in offsets.items() if n >= min(2, len(book)) for k in (-2, -1, 0, 1, 2)} if len(book) > 1 else {0}
    titles = {s for s, n in edges.items() if len(s) > 3 and not s.isdigit() and n >= 2 and n > 2 * inside[s] and s not in model.inner}

    def running(part: str) -> bool:
        s = skeleton(part)
        if s in titles or (s in model.title and chapter(part) is None) or TITLE.fullmatch(part):
            return True
        return len(s) > 5 and not part.endswith(tuple(".?!。？！,，")) and any(abs(len(s) - len(t)) < 3 and SequenceMatcher(None, s, t).ratio() >= 0.85 for t in titles)

    out: set[tuple[int, int]] = set()
    opened: set[int] = set()
    for n, ((no, lines), at) in enumerate(zip(book, shown, strict=True)):
        named = [(i, c) for i in at if len(lines[i]) < 80 and (c := chapter(GAP.split(lines[i])[0])) is not None]

        def repeated(i: int, part: str, top: bool, named=named, lines=lines) -> bool:
            c = chapter(part)
            if c is None or len(part) >= 80 or part.endswith(tuple(".。?？,，")):
                return False
            if c in opened or (top and any(d == c and j > i for j, d in named)):
                return True
            return top and i + 1 < len(lines) and bool(lines[i + 1])

        for order, top in ((at[:3], True), (at[::-1][:3], False)):
            for i in order:
                if (n, i) in out:
                    break
                x = lines[i]
                # a gap may have shrunk to one space
                cuts = [GAP.split(x), *([x[: m.start()], x[m.end() :]] for m in re.finditer(" ", x if len(x) < 60 else ""))]
                for k, parts in enumerate(cuts):
                    sure = [bool(p := page_number(part)) and (p[1] or p[0] - no in steady) for part in parts]
                    # beside a shrunken gap stands a number
                    if (k == 0 or any(sure)) and all(s or running(p) or repeated(i, p, top) or (any(sure) and chapter(p) is not None) for s, p in zip(sure, parts, strict=True)):
                        out.add((n, i))
                        break
                else:
                    break
        opened.update(c for i, c in named if (n, i) not in out)
    return out


@dataclass
class Line:
    page: int
    no: int
    text: str
    kinds: set[str] = field(default_factory=set)
    #: (from, to, instead)
    repairs: list[tuple[int, int, str]] = field(default_factory=list)


def like(word: str, right: str) -> str:
    return right.upper() if word.isupper() and len(word) > 1 else right[:1].upper() + right[1:] if word[:1].isupper() else right


def read(book: list[tuple[int, list[str]]], model: Known, among: set[int] | None = None) -> list[Line]:
    """The lines of pages in order with their kinds and repairs; words are looked at on the pages `among` only."""
    away = furniture(book, model)
    all_lines = [Line(no, i + 1, x, {"furniture"} if (n, i) in away else set()) for n, (no, lines) in enumerate(book) for i, x in enumerate(lines)]
    own = [x for x in all_lines if x.text and not x.kinds]
    joined: dict[int, int] = {}

    def around(a: int, i: int, j: int) -> tuple[list[str], list[str]]:
        left = (own[a - 1].text + " " if a else "") + own[a].text[:i]
        right = own[a].text[j:] + (" " + own[a + 1].text if a + 1 < len(own) else "")
        return skipgram.tokens(left[-60:])[-skipgram.WINDOW :], skipgram.tokens(right[:60])[: skipgram.WINDOW]

    for a, line in enumerate(own):
        if among is not None and line.page not in among and not (a + 1 < len(own) and own[a + 1].page in among):
            continue
        after = own[a + 1] if a + 1 < len(own) else None
        x = line.text
        done = joined.get(a, 0)
        m = LEFT.search(x) if x[-1] in MARKS else None
        r = PART.match(after.text) if after and m else None
        if m and r and not r.group().isdigit() and not m.group(1).isdigit() and (x[-1] == "¬" or f"{m.group(1).lower()}\t{r.group().lower()}" in model.cut):
            line.kinds.add("broken_word")
            joined[a + 1] = r.end()
            left = m.group(1)
            if m.start(1) >= done and (c := model.corrected(left + r.group())):
                right, i, j = c
                cut = len(left)
                if i < cut:
                    line.kinds.add("misread")
                if j > cut:
                    after.kinds.add("misread")
                # the right word stands at the end of the first line, as far as it goes there
                line.repairs.append((m.start(1), m.end(1), like(left, right)))
                after.repairs.append((0, r.end(), ""))
        elif m and not after and x[-1] == "¬":
            line.kinds.add("broken_word")
        for p in PART.finditer(x):
            w = p.group()
            if w.lower() not in model.link or p.start() < done or ("broken_word" in line.kinds and p.end() == m.end(1)):
                continue
            if any(p.start() < u.end() and u.start() < p.end() for u in re.finditer(r"\S+://\S+", x)):
                continue
            if NUMBER.match(x, p.start()) is None and (c := model.corrected(w, around(a, p.start(), p.end()))):
                line.kinds.add("misread")
                line.repairs.append((p.start(), p.end(), like(w, c[0])))
        for p in NUMBER.finditer(x) if DIGIT_LIKE.search(x) else ():
            w = p.group().rstrip("!")
            if any(c in DIGITS for c in w) and model.wrong_number(x[: p.start()], w):
                line.kinds.add("misread")
                line.repairs.append((p.start(), p.start() + len(w), w.translate(DIGIT_OF)))
    three = model.three
    if not three:
        return all_lines
    s, at, starts = stream([x.text for x in own])
    for site in re.finditer(f"[{''.join(model.twins)}]", s) if model.twins else ():
        i, c = site.start(), site.group()
        ks = [k for k in (i - 2, i - 1, i) if 0 <= k and k + 3 <= len(s)]
        best, instead, mine = 4.0, "", None
        for t in sorted(model.twins[c]):
            others = [three.get(s[k:i] + t + s[i + 1 : k + 3], 0) for k in ks]
            if max(others, default=0) < 3:
                continue
            mine = mine or [max(0, three.get(s[k : k + 3], 0) - 1) for k in ks]
            gain = sum(math.log((o + 0.5) / (n + 0.5)) for o, n in zip(others, mine, strict=True))
            if gain > best:
                best, instead = gain, t
        if instead:
            n = int(np.searchsorted(starts, at[i], "right")) - 1
            j = int(at[i] - starts[n])
            own[n].kinds.add("misread")
            own[n].repairs.append((j, j + 1, instead))
    return all_lines


def repaired(line: Line) -> str:
    x = line.text
    for a, z, to in sorted(line.repairs, reverse=True):
        x = x[:a] + to + x[z:]
    return x


@dataclass
class Piece:
    """A paragraph as far as it stands on the pages `own`: whether it goes on from before, and what joins it then."""

    page: int
    text: str
    goes_on: bool
    mark: str


def paragraphs(book: list[tuple[int, list[str]]], indented: set[tuple[int, int]], model: Known, own: set[int]) -> list[Piece]:
    """The paragraphs of pages in order, as far as they stand on the pages `own`: a blank line, a chapter's heading, an
    indented line or a line well short of the page's width that ends a sentence ends one; a row of figures or a lone word
    (Example) is one. Page breaks don't."""
    out: list[Piece] = []
    current, glued, width, page, inside, opened = "", False, {}, None, False, False
    lines = read(book, model)
    for x in lines:
        if "furniture" not in x.kinds:
            width[x.page] = max(width.get(x.page, 0), len(x.text))

    for x in lines:
        if "furniture" in x.kinds:
            continue
        if not x.text:
            # a blank line beside furniture belongs to the page
            if x.page == page and not glued:
                current, opened = "", False
            continue
        rows = not any(c.isalpha() for c in x.text)
        lone = chapter(x.text) is not None or (rows and PLAIN.fullmatch(x.text) is not None)
        if (x.page, x.no) in indented or lone:
            current, opened = "", False
        page = x.page
        text = repaired(x)
        if not current:
            text, mark = text.lstrip(), ""
        elif glued or current[-1] in MARKS or (UNSPACED.match(current[-1]) and UNSPACED_OR_DIGIT.match(text)) or (current[-1].isdigit() and IS_HAN.match(text)) or (IS_HAN.search(current) and UNSPACED.match(current[-1]) and text[:1] in ",.;:?!()"):
            mark = ""
        else:
            mark = " "
        first = not current
        glued = "broken_word" in x.kinds
        if glued:
            text = text.rstrip()[:-1].rstrip()
        inside = x.page in own
        if inside and (first or not opened):
            out.append(Piece(x.page, text, not first, mark))
            opened = True
        elif inside:
            out[-1].text += mark + text
        current += mark + text
        if not glued and (lone or (first and len(x.text) < 0.3 * width[x.page] and x.text.isalpha()) or (len(x.text) < 0.7 * width[x.page] and x.text[-1] in ".?!。？！…”\"")):
            current, opened = "", False
    return out


def _shaped(pages: DataFrame) -> DataFrame:
    """(doc_path, page_no, text, h): the canonical texts, and what tells stored copies of a page. Rows without a book, a
    number or a text are left out; repeated rows count once."""
    arrow = pa.schema([("doc_path", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("h", pa.binary())])

    def run(batches):
        for b in batches:
            texts = [shaped(t) for t in b.column(2).to_pylist()]
            h = [hashlib.blake2b(skeleton(t).encode(), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(h, pa.binary())], schema=arrow)

    rows = pages.select("doc_path", F.col("page_no").cast("int").alias("page_no"), "text").where("doc_path is not null and page_no is not null and text is not null").distinct()
    return stash(rows.mapInArrow(run, "doc_path string, page_no int, text string, h binary"), "shaped")


def wanted(texts: list[str], twins: dict[str, set[str]]) -> set[tuple[str, str]]:
    """The keys of what was learnt that these pages may ask for."""
    out: set[tuple[str, str]] = set()
    pages = [shown_of(t) for t in texts]
    lines = [x for p in pages for x in p]
    for x in lines:
        out.update(("link", p.group().lower()) for p in PART.finditer(x))
        out.update(("plain", b.group(1)[-8:]) for m in CELL.finditer(x) if (b := BEFORE.search(x, 0, m.start())))
    # furniture is looked for in the first and last lines
    for x in (x for p in pages for x in (*p[:3], *p[-3:])):
        parts = [x, *GAP.split(x), *(y for m in re.finditer(" ", x if len(x) < 60 else "") for y in (x[: m.start()], x[m.end() :]))]
        out.update((kind, skeleton(y)) for y in parts for kind in ("title", "inner"))
    # the next line of the text may stand beyond furniture
    for i, x in enumerate(lines):
        if x[-1] in MARKS and (m := LEFT.search(x)):
            for after in lines[i + 1 : i + 8]:
                if r := PART.match(after):
                    out.update((("cut", f"{m.group(1).lower()}\t{r.group().lower()}"), ("link", (m.group(1) + r.group()).lower())))
    s = stream(lines)[0]
    for i, c in enumerate(s):
        for t in {c, *twins[c]} if c in twins else ():
            out.update(("three", s[k:i] + t + s[i + 1 : k + 3]) for k in (i - 2, i - 1, i) if k >= 0)
    return out


def _by_stretch(books: DataFrame, f, arrow: pa.Schema, ddl: str, sent: int = SENT) -> DataFrame:
    """f over stretches of STRETCH pages of each book: f(pages in order as (page_no, lines), indented lines, own pages,
    Known). A stretch also holds the BESIDE pages on either side, so a book of any length is spread over tasks. What was
    learnt goes out whole if it has at most `sent` rows, else each stretch is joined with the rows that it may ask for."""
    known, pairs, vectors = learn(books)
    common = books.sparkSession.sparkContext.broadcast((pairs, vectors))
    page = F.col("page_no")
    near = F.array_distinct(F.array(*[F.floor((page + k) / F.lit(STRETCH)).cast("int") for k in (0, -BESIDE, BESIDE)]))
    at = books.select("doc_path", "page_no", "text", F.explode(near).alias("stretch"))

    def work(t: pa.Table, rows) -> pa.Table:
        stretch, path = t.column("stretch")[0].as_py(), t.column("doc_path")[0].as_py()
        pages = sorted({(n, x) for n, x in zip(t.column("page_no").to_pylist(), t.column("text").to_pylist(), strict=True)})
        own = {n for n, _ in pages if n // STRETCH == stretch}
        model = rows if isinstance(rows, Known) else known_of(rows, *common.value)
        book = [(n, [y.lstrip(INDENT) for y in x.split("\n")]) for n, x in pages]
        indented = {(n, i + 1) for n, x in pages for i, y in enumerate(x.split("\n")) if y.startswith(INDENT)}
        out = f(book, indented, own, model) if own else []
        cols = [pa.array([path] * len(out), pa.string()), pa.array([stretch] * len(out), pa.int32()), *[pa.array([r[i] for r in out], x.type) for i, x in enumerate(list(arrow)[2:])]]
        return pa.table(cols, schema=arrow)

    if known.limit(sent + 1).count() <= sent:
        rows = books.sparkSession.sparkContext.broadcast(known.toArrow().to_pylist())

        def whole(t):
            return work(t, _everywhere(rows, common))

        return at.groupBy("doc_path", "stretch").applyInArrow(whole, ddl)

    keys = pa.schema([("doc_path", pa.string()), ("stretch", pa.int32()), ("kind", pa.string()), ("key", pa.string())])

    def ask(t):
        rows = sorted(wanted([x for _, x in sorted(zip(t.column("page_no").to_pylist(), t.column("text").to_pylist(), strict=True))], common.value[0]))
        n = len(rows)
        return pa.table([pa.array([t.column("doc_path")[0].as_py()] * n, pa.string()), pa.array([t.column("stretch")[0].as_py()] * n, pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], schema=keys)

    by = at.groupBy("doc_path", "stretch")
    told = by.applyInArrow(ask, "doc_path string, stretch int, kind string, key string").join(known, ["kind", "key"])

    def joined(t, k):
        return work(t, k.to_pylist()) if t.num_rows else arrow.empty_table()

    return by.cogroup(told.groupBy("doc_path", "stretch")).applyInArrow(joined, ddl)


def known_of(rows: list[dict], twins: dict[str, set[str]], vectors: skipgram.Vectors) -> Known:
    out = Known(twins=twins, vectors=vectors)
    for r in rows:
        out.add(r["kind"], r["key"], r["value"], r["a"], r["z"], r["sure"], r["n"])
    return out


@functools.lru_cache(maxsize=1)
def _held(_: int, rows, common) -> Known:
    return known_of(rows.value, *common.value)


def _everywhere(rows, common) -> Known:
    """What was learnt, once in each worker."""
    return _held(rows._jbroadcast.id() if getattr(rows, "_jbroadcast", None) else id(rows), rows, common)


def found(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """(doc_path, page_no, line_no, line_kind) of the lines that are furniture, broken or misread.

    Rows without a book, a page number or a text are left out; repeated rows and pages stored again count once for what is
    learnt, and each gets its lines; an empty table gives no row; other columns are ignored."""
    arrow = pa.schema([("doc_path", pa.string()), ("stretch", pa.int32()), ("page_no", pa.int32()), ("line_no", pa.int32()), ("line_kind", pa.string())])

    def kinds(book, indented, own, model):
        return sorted({(x.page, x.no, k) for x in read(book, model, own) if x.page in own for k in x.kinds})

    rows = _by_stretch(_shaped(pages), kinds, arrow, "doc_path string, stretch int, page_no int, line_no int, line_kind string", sent)
    return rows.drop("stretch")


def _doc_pages(docs: DataFrame) -> DataFrame:
    arrow = pa.schema([("doc_path", pa.string()), ("page_no", pa.int32()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cut = PAGE_BREAK.split(text)
                # what stands before the first mark is a page 0
                rows += [(path, int(n), t) for n, t in zip(["0", *cut[1::2]], cut[::2], strict=True) if t.strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(arrow)], schema=arrow)

    return docs.select("doc_path", "text").where("doc_path is not null and text is not null").mapInArrow(run, "doc_path string, page_no int, text string")


def book_paragraphs(pages: DataFrame, docs: DataFrame, sent: int = SENT) -> DataFrame:
    """(source, doc_path, page_no, para_no, text): the readable paragraphs of each book, from its pages and from its
    joined text; page_no is the page a paragraph begins on, para_no its number there.

    Pages and joined texts are read as books of their own, and learnt from together. A paragraph that runs over the end
    of a stretch of pages is put together from its parts: only the first and last part of a stretch, so whatever the size
    of a book, a task holds two rows of each of its stretches. Special cases are as in `found`."""
    arrow = pa.schema([("doc_path", pa.string()), ("stretch", pa.int32()), ("page_no", pa.int32()), ("no", pa.int32()), ("goes_on", pa.bool_()), ("last", pa.bool_()), ("mark", pa.string()), ("text", pa.string())])
    cols = ["doc_path", "page_no", "text"]
    # the two sources keep apart by a letter before the path
    both = pages.select(F.concat(F.lit("p"), "doc_path").alias("doc_path"), F.col("page_no").cast("int").alias("page_no"), "text").unionByName(_doc_pages(docs).select(F.concat(F.lit("d"), "doc_path").alias("doc_path"), *cols[1:]))

    def texts(book, indented, own, model):
        pieces = paragraphs(book, indented, model, own)
        no: Counter = Counter()
        rows = []
        for i, p in enumerate(pieces):
            no[p.page] += not p.goes_on
            rows.append((p.page, no[p.page], p.goes_on, i == len(pieces) - 1, p.mark, p.text))
        return rows

    p = _by_stretch(_shaped(both), texts, arrow, "doc_path string, stretch int, page_no int, no int, goes_on boolean, last boolean, mark string, text string", sent)
    p = stash(p, "pieces")
    edge = p.where("goes_on or last")
    order = Window.partitionBy("doc_path").orderBy("stretch", "page_no", "no")
    chain = edge.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("stretch", "page_no", "no", "mark", "text")))
    whole = chain.groupBy("doc_path", "chain").agg(parts.alias("x")).select("doc_path", F.col("x")[0]["page_no"].alias("page_no"), F.col("x")[0]["no"].alias("no"), F.aggregate("x", F.lit(""), lambda acc, y: F.concat(acc, y["mark"], y["text"])).alias("text"))
    out = p.where("not goes_on and not last").select("doc_path", "page_no", "no", "text").unionByName(whole)
    source = F.when(F.substring("doc_path", 1, 1) == "p", "page").otherwise("doc")
    return out.select(source.alias("source"), F.expr("substring(doc_path, 2)").alias("doc_path"), "page_no", F.col("no").alias("para_no"), "text")
