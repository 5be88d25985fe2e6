"""Texts that look the same in one consistent form."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.attempts import latest_by_key

# Letters of other scripts that have the shape of a Latin letter, each above or below its twin.
# The pairs are those of the public list confusables.txt (Unicode Technical Standard 39) whose shapes are the same.
CYRILLIC = "АВЕКМНОРСТУХЅІЈԌԚԜаеорсухѕіјһԁԛԝӀӏѴѵҮү"
CYRILLIC_AS = "ABEKMHOPCTYXSIJGQWaeopcyxsijhdqwIlVvYy"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳν"
GREEK_AS = "ABEZHIKMNOPTYXCocjv"
ARMENIAN = "ՕՍՏԼոսօհցզ"
ARMENIAN_AS = "OUSLnuohgq"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTAJEWMHYGZWVSLCPKB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
# Radicals of U+2E80 to U+2EFF without a decomposition, with the ideograph of the same shape.
RADICALS = "⺁⺅⺉⺋⺒⺓⺔⺖⺗⺘⺙⺠⺡⺢⺣⺤⺦⺨⺫⺭⺰⺹⺼⺾⻁⻂⻃⻄⻅⻈⻉⻋⻌⻏⻐⻓⻔⻖⻙⻚⻛⻜⻞⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻫⻬⻭⻮⻯⻰⻲"
RADICALS_AS = "厂亻刂㔾巳幺彑忄㣺扌攵民氵氺灬爫丬犭罒礻纟耂月艹虎衤覀西见讠贝车辶阝钅长门阝韦页风飞食飠饣马骨鬼鱼鸟卤麦黄斉齐歯齿竜龙亀"
#: Format characters that have a shape: signs that span the digits or letters after them.
SHAPED = frozenset(map(chr, (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440))))
HYPHENS = "‐‑‒⁃﹣－"
LINE_ENDS = "\r\n", "\r", "\x0b", "\x0c", "\x85", " ", " "


def _invisible(c: str) -> bool:
    o = ord(c)
    if c in "\t\n\r\x0b\x0c\x85" or c in SHAPED:
        return False
    return unicodedata.category(c) in ("Cf", "Cc") or o == 0x34F or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def _widths(o: int) -> bool:
    """Code points whose compatibility form looks the same: full- and half-width forms, radicals, Latin ligatures, and
    Roman numerals."""
    return 0xFF01 <= o <= 0xFFEE or 0x2F00 <= o <= 0x2FD5 or o in (0x2E9F, 0x2EF3) or 0xFB00 <= o <= 0xFB04 or o == 0xFB06 or 0x2160 <= o <= 0x217F


def _letters() -> dict[str, str]:
    """The shape of single code points: what each stands for, if that is another."""
    to = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU + RADICALS, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LISU_AS + RADICALS_AS, strict=True))
    to |= dict.fromkeys(HYPHENS, "-") | {c: "\n" for c in LINE_ENDS if len(c) == 1} | {"\t": " ", "ʼ": "’", "µ": "μ"}
    for o in range(0x80, 0x10000):
        c = chr(o)
        if unicodedata.category(c) == "Zs":
            to[c] = " "
        elif _widths(o) and c not in to and (plain := unicodedata.normalize("NFKC", c)) != c:
            to[c] = "".join(to.get(x, x) for x in plain)
    return to


class Transducer:
    """A longest-match mapping of grapheme clusters: a character with the marks and invisible characters after it.

    It is compiled beforehand. Single characters make a table for `str.translate`. Of clusters of several, those that
    Unicode composes (letters with their accents, kana with sound marks, Hangul letters) and their variants of another
    width, script or order make a second table; the rest is worked out by the same rule when it first occurs. A cluster
    is looked up whole, the longest match, and takes precedence over its characters. The rule is closed: what a cluster
    becomes is mapped again until nothing changes, so a form maps to itself.
    """

    def __init__(self) -> None:
        self.letters = _letters()
        # beyond these planes lie ideographs, which are kept, and what isn't assigned
        every = [chr(o) for o in (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200))]
        invisible = [c for c in every if _invisible(c)]
        self.gone = dict.fromkeys(map(ord, invisible))
        span = lambda cs: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _runs(sorted(map(ord, cs))))
        # half-width sound marks, and the vowels and finals of conjoining Hangul, belong to the character before them
        marks = [c for c in every if unicodedata.category(c) in ("Mn", "Me", "Mc") and not _invisible(c)]
        marks += map(chr, (0xFF9E, 0xFF9F, *range(0x1160, 0x1200), *range(0xD7B0, 0xD7FC), *range(0xFFC2, 0xFFDD)))
        tail = span([*marks, *invisible])
        # pictures that a joiner makes one, and flags of tags, are kept as they are but for the choice of their style
        picture = "[\u2190-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff]"
        self.picture = re.compile(f"(?:{picture}[\ufe0f\U0001f3fb-\U0001f3ff]*\u200d)+{picture}[\ufe0f\U0001f3fb-\U0001f3ff]*|\U0001f3f4[\U000e0020-\U000e007f]+")
        self.tails = re.compile(f"[{tail}]+")
        self.known: dict[str, str] = {}
        self.single: dict[int, str] = dict.fromkeys(map(ord, invisible), "")
        for c in every:
            o = ord(c)
            if (0x20 <= o < 0x7F) or 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or o in self.single:
                continue
            if (to := self._step(c)) != c:
                self.single[o] = to
        # a single character's form may be several that are mapped again
        for o, to in self.single.items():
            self.single[o] = self._closed(to)
        self._compose(every)
        self.check()

    def _compose(self, every: list[str]) -> None:
        """The clusters that compose, in all their spellings by look-alike letters and widths."""
        same: dict[str, list[str]] = {}
        for c, to in self.letters.items():
            same.setdefault(to, []).append(c)
        for c in every:
            apart = unicodedata.normalize("NFD", c)
            if len(apart) < 2 or 0xAC00 <= ord(c) < 0xD7A4 or unicodedata.normalize("NFC", c) != c:
                continue
            base, rest = apart[0], apart[1:]
            for b in (base, *same.get(base, ()), *same.get(self.letters.get(base, ""), ())):
                for s in {b + rest, unicodedata.normalize("NFC", b + rest)}:
                    if len(s) > 1:
                        self.known[s] = self._closed(self._step(s))

    def _step(self, s: str) -> str:
        s = unicodedata.normalize("NFD", s.translate(self.gone))
        s = "".join(self.letters.get(c, c) for c in s)
        # a mapped letter may have a decomposition of its own, as half-width sound marks have
        return unicodedata.normalize("NFC", s)

    def _closed(self, s: str) -> str:
        for _ in range(8):
            if (to := self._once(s, self._step)) == s:
                return s
            s = to
        raise ValueError(f"no end to {s!r}")

    def _once(self, s: str, cluster) -> str:
        """One pass: pictures as they are, clusters by `cluster`, the characters between them by the table."""
        if "\r" in s:
            s = s.replace("\r\n", "\n")
        if "\u200d" not in s and "\U0001f3f4" not in s:
            return self._between(s, cluster)
        out, at = [], 0
        for m in self.picture.finditer(s):
            out += [self._between(s[at : m.start()], cluster), m.group().replace("\ufe0f", "")]
            at = m.end()
        return "".join([*out, self._between(s[at:], cluster)])

    def _between(self, s: str, cluster) -> str:
        out, at = [], 0
        for m in self.tails.finditer(s):
            a = m.start()
            if a > at and s[a - 1] not in "\r\n":
                out += [s[at : a - 1].translate(self.single), cluster(s[a - 1 : m.end()])]
            else:
                out += [s[at:a].translate(self.single), unicodedata.normalize("NFC", m.group().translate(self.single))]
            at = m.end()
        out.append(s[at:].translate(self.single))
        return "".join(out)

    def check(self, seed: int = 1, clusters: int = 5_000) -> None:
        """No two rules may disagree: a form must map to itself, so the order of rules can't matter. All compiled rules
        are tried, and a number of made-up clusters of several marks."""
        rng = random.Random(seed)
        bases, tails = [*self.letters, *"aeo가ㄱカは"], ["\u0301", "\u0308", "\u0323", "\u05b0", "\u064b", "\u3099", "\uff9e", "\uff9f", "\u0345", "\u1161", "\u11a8", "\u200d", "\uffc2"]
        made = ["".join([rng.choice(bases), *rng.choices(tails, k=rng.randint(1, 3))]) for _ in range(clusters)]
        for s in [*map(chr, self.single), *self.known, *made]:
            if self.apply(to := self.apply(s)) != to:
                raise ValueError(f"{s!r} becomes {to!r}, and that {self.apply(to)!r}")
        for s, to in self.letters.items():
            if any(c in self.letters for c in to):
                raise ValueError(f"{s!r} becomes {to!r}, which is mapped itself")

    def apply(self, text: str) -> str:
        if text.isascii() and not any(c in text for c in "\r\t\x0b\x0c"):
            return text if text.isprintable() else text.translate(self.gone)
        return self._once(text, self._of)

    def _of(self, s: str) -> str:
        if (to := self.known.get(s)) is None:
            to = self._closed(self._step(s))
            if len(s) < 8 and len(self.known) < 100_000:
                self.known[s] = to
        return to


def _runs(codes: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for o in codes:
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return [(a, b) for a, b in out]


@functools.lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def canonical(rows: DataFrame, with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(item_kind, key, form[, canonical_text], *keep) from (item_kind, key, text, *keep), where keep are
    bigint columns: form is a 128-bit digest of the
    canonical text, null for null, empty and blank texts, whose canonical text is null, '' or blank.

    Row by row, without a shuffle. The canonical text of a canonical text is itself.
    """
    fields = [("item_kind", pa.string()), ("key", pa.string()), ("form", pa.binary())] + [("canonical_text", pa.string())] * with_text
    schema = pa.schema([*fields, *[(c, pa.int64()) for c in keep]])

    def run(batches):
        apply = transducer().apply
        for b in batches:
            texts = [None if t is None else apply(t) for t in b.column(2).to_pylist()]
            forms = [hashlib.blake2b(t.encode(), digest_size=16).digest() if t and not t.isspace() else None for t in texts]
            cols = [b.column(0), b.column(1), pa.array(forms, pa.binary())] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[3:]], schema=schema)

    ddl = "item_kind string, key string, form binary" + ", canonical_text string" * with_text + "".join(f", {c} bigint" for c in keep)
    return rows.select("item_kind", "key", "text", *keep).mapInArrow(run, ddl)


def record_forms(items: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(item_kind, key, form) of exam items, documents (the row with the latest updated_at) and pages: each record once.
    Records whose text is blank, or whose key is null, are left out. Digests are shuffled, not texts."""
    exam = canonical(items.select(F.lit("exam").alias("item_kind"), F.col("item_id").alias("key"), F.col("stem").alias("text")), False)
    page = canonical(pages.select(F.lit("page").alias("item_kind"), F.concat("doc_path", F.lit("#"), F.col("page_no").cast("string")).alias("key"), "text"), False)
    versions = canonical(docs.select(F.lit("document").alias("item_kind"), F.col("id").alias("key"), F.col("body").alias("text"), F.unix_micros("updated_at").alias("version")), False, ("version",))
    latest = latest_by_key(versions, "key", ["version", "form"], ["key", "version", "form"]).select(F.lit("document").alias("item_kind"), "key", "form")
    return exam.unionByName(page).unionByName(latest).where("key is not null and form is not null").distinct()


def look_alike_classes(forms: DataFrame) -> DataFrame:
    """(item_kind, key, class_key, n_records): the records of one kind that look the same have the class_key of the first
    of them in byte order. The class's size and name are aggregated before the join, so a class of a third of all records
    is never in one task."""
    c = forms.groupBy("item_kind", "form").agg(F.min("key").alias("class_key"), F.count(F.lit(1)).alias("n_records"))
    return forms.join(c, ["item_kind", "form"]).select("item_kind", "key", "class_key", "n_records")


def found(items: DataFrame, docs: DataFrame, pages: DataFrame, block: int = 1024) -> DataFrame:
    """The pairs of records that look the same. Only classes of two or more go into the join; a large class is cut into
    blocks of about `block` records by hash, and each record meets the blocks one by one, so no task holds a class."""
    f = record_forms(items, docs, pages)
    many = f.groupBy("item_kind", "form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item_kind", "form", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    f = f.join(many, ["item_kind", "form"])
    a = f.select("item_kind", "form", F.col("key").alias("key_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = f.select("item_kind", "form", F.col("key").alias("key_b"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    return a.join(b, ["item_kind", "form", "block"]).where("key_a < key_b").select("item_kind", "key_a", "key_b")
