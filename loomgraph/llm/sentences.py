"""Sentences of texts in many scripts, with abbreviations, collocations and sentence starters learnt from the texts."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import spread
from loomgraph.runtime import stash

# Frequent words and marks that tell languages of the Latin script apart, words with a space on either side.
COMMON = {
    "en": " the , of , and , to , is , in , that , with , for , not ".split(","),
    "de": " der , die , das , und , ist , ein , wird , nicht , auf , mit ,ß,ä,ü,„".split(","),
    "fr": " le , les , des , est , une , dans , pour , du , et , au , d’, l’,ê,è,ç,à, :".split(","),
    "es": " el , los , las , de , que , una , por , y , del ,ñ,í,ó,á,ú,¿,¡".split(","),
}
BLANK = re.compile("(?:\r\n|[\n\r\u2028\u2029])[^\\S\r\n\u2028\u2029]*[\n\r\u2028\u2029]\\s*")
#: The mark of a heading or a list item at the start of a block.
ITEM = re.compile(r"﻿?(?:#{1,6}\s|[-*•‣●○▪◦+]\s|\(\d{1,3}\)\s|（\d{1,3}）|\d{1,3}[.)]\s|[a-zA-Z]\)\s|[①-⑳])")
CLOSERS = "\"'”’“»›」』）)\\]】》〉"
#: Marks with the closing quotes and brackets after them; a period before a small letter or within a number is none.
END = re.compile(rf"(?:[.．](?![a-z])(?!(?<=[0-9].)[0-9])|[!?…！？。｡؟।॥])+(?:[{CLOSERS}]+|\s[»›]+)*")
#: After such a character the sentence goes on.
STAY = ",;:，、；：)）]…"
QUOTES = frozenset("\"'”’“»›」』》〉")
OPENERS = "([{（【《〈「『\"'“”„«‹‘’¿¡—–- \t\r\n  　"
#: A letter of a word; the vowel signs of Devanagari, Arabic and Thai belong to it.
L = r"(?:[^\W\d_]|[\u0900-\u0963\u0971-\u097f\u064b-\u065f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e])"
WORD = re.compile(f"{L}+")


def _token(letter: str) -> re.Pattern:
    """Letters, with periods inside."""
    return re.compile(rf"{letter}+(?:\.{letter}+)*")


def _period(letter: str) -> re.Pattern:
    """The word or number before a period, and what comes next."""
    return re.compile(rf"(?<![\w.])({letter}+(?:\.{letter}+)*|\d+)\.(?=\s+([\"“„«‘(¿¡]*)({letter}+\.?|[^\s»”)]))")


#: Groups with such vowel signs; the plain letters of the others are found faster.
MARKED = ("hi", "ar", "th")
PLAIN_L = r"[^\W\d_]"
TOKEN, PERIOD = {True: _token(L), False: _token(PLAIN_L)}, {True: _period(L), False: _period(PLAIN_L)}
#: What the end of a word may hold, and how far back a word is looked at; no abbreviation is longer.
TAIL, LONGEST = re.compile(rf"{L}|[\w.]"), 128
NEXT = re.compile(r"\s*")
THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎”\"')])[^\S\r\n]*(?:\r?\n)?[^\S\r\n]+(?=[ก-๎“\"])|(?<=[ก-ฺเ-๎])\r?\n(?=[ก-๎“\"])")
#: Blocks of letters that decide how a text is read, in order of the test, with a weight: Japanese has more ideographs
#: than kana.
SCRIPTS = [("th", 0xE00, 0xE80, 1), ("ko", 0xAC00, 0xD7C0, 1), ("ja", 0x3040, 0x3100, 6), ("zh", 0x4E00, 0xA000, 1), ("hi", 0x900, 0x980, 1), ("ar", 0x600, 0x700, 1), ("ru", 0x400, 0x500, 1)]
UNSPACED = {"zh": 2, "ja": 2, "th": 4}
#: Where words have no capitals and sentences a mark of their own: a period's affinity alone makes an abbreviation.
UNCASED = ("hi",)
#: A key is kept if it is at least this share of its kind's count, so a language has at most 1 / SHARE keys of a kind,
#: whatever the size of the corpus.
SHARE = 2e-6
KINDS = ("word", "period", "goes on", "pair", "number", "start", "unsure")


def group_of(text: str) -> str:
    """The language as far as it matters here: by script, and for the Latin script by frequent words. The table's lang
    column may be missing or wrong and isn't used."""
    best = ""
    if not text.isascii():
        # letters by blocks of 64 code points
        n = np.bincount(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16) >> 6, minlength=1024)
        most = n[1:9].sum() / 4
        for name, low, high, times in SCRIPTS:
            if (m := n[low >> 6 : high >> 6].sum() * times) > most:
                best, most = name, m
    if best:
        return best
    flat = " " + text.lower().replace("\n", " ") + " "
    return max(COMMON, key=lambda k: (sum(flat.count(w) for w in COMMON[k]), k == "en"))


def blocks(text: str):
    """(start, end) of the stretches between blank lines, without white space around them."""
    at, last = NEXT.match(text).end(), len(text.rstrip())
    for m in BLANK.finditer(text, at, last):
        e = m.start()
        while text[e - 1].isspace():
            e -= 1
        yield at, e
        at = m.end()
    if at < last:
        yield at, last


def head(text: str, at: int, e: int, width: int) -> str:
    """The first characters of a unit of a script without spaces; digits count as one character 0."""
    h = text[at : min(e, at + width)]
    return "0" if h[:1].isdigit() else h


ASCII_TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+(?:\.[A-Za-zÀ-ɏ]+)*")
SURE_WORD = re.compile(r"[!?؟]\s+([^\W\d_]+)")
SURE_HEAD = re.compile(rf"[。！？]\s*([^\s{CLOSERS}…。！？，；、][^\s])")
UNSURE_HEAD = re.compile(r"…\s*([^\s…][^\s])")
THAI_HEAD = re.compile(rf"(?:{THAI_GAP.pattern})(?=(\S{{4}}))")


def observe(text: str, group: str, counts: dict[str, Counter]) -> None:
    """Adds what a text tells to the counts by kind: words, words before a period and what follows there, sure sentence
    starts, and heads after marks that may or may not end a sentence."""
    width = UNSPACED.get(group)
    # words of the group's own script; where no space parts them, only Latin words are counted, before periods too
    own = group not in UNSPACED
    marked = group in MARKED
    counts["word"].update((TOKEN[marked] if own else ASCII_TOKEN).findall(text))
    period, goes, pair = counts["period"], counts["goes on"], counts["pair"]
    for w, quote, nxt in PERIOD[marked].findall(text):
        if w[0].isdigit():
            if nxt[0].isupper() and not quote:
                counts["number"][nxt.rstrip(".")] += 1
            continue
        if not own and not ASCII_TOKEN.fullmatch(w):
            continue
        w = w.lower()
        period[w] += 1
        if not nxt[0].isalpha() or nxt[0].islower() or (nxt[-1] == "." and len(nxt) == 2):
            goes[w] += 1
        else:
            pair[f"{w}\t{nxt.rstrip('.')}"] += 1
    start = counts["start"]
    for s, e in blocks(text):
        if ITEM.match(text, s):
            continue
        if width:
            start[head(text, s, e, width)] += 1
        elif m := WORD.search(text, s, e):
            start[m.group()] += 1
    if group == "th":
        counts["unsure"].update(THAI_HEAD.findall(text))
    elif width:
        start.update("0" if h[0].isdigit() else h for h in SURE_HEAD.findall(text))
        counts["unsure"].update("0" if h[0].isdigit() else h for h in UNSURE_HEAD.findall(text))
    else:
        start.update(SURE_WORD.findall(text))


@dataclass
class Model:
    """What was learnt of one group."""

    abbreviations: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    ordinals: set[str] = field(default_factory=set)
    collocations: set[str] = field(default_factory=set)
    continuations: set[str] = field(default_factory=set)


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x <= 0, F.lit(0.0)).otherwise(x * F.log(F.greatest(y, F.lit(1e-300))))


def log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Twice the log of the ratio of the likelihoods of k in n under k / n and under p."""
    q = k / n
    return 2 * (_xlogy(k, q) + _xlogy(n - k, 1 - q) - _xlogy(k, p) - _xlogy(n - k, 1 - p))


def learn(docs: DataFrame) -> dict[str, Model]:
    """The models of all groups, from all texts.

    Each task adds up its counts and sends them as rows (group, kind, key, n), at most once per key and quarter of a
    million keys; all scores are worked out on the aggregated table. What comes to the driver are the words that pass:
    abbreviations, starters, collocations, ordinals' nouns, continuations; each must hold a share of SHARE of its kind's
    count, which bounds their number whatever the size of the corpus.

    An abbreviation is a word whose affinity to the period (log-likelihood ratio, discounted by the word's length and by
    its occurrences without a period, raised by periods inside) is at least 0.3, and after whose period the sentence
    goes on (a small letter, a digit, a single letter, or a capital that never starts a sentence) in at least 15 % of
    cases. A starter begins sentences at sure places in at least 5 % of its capitalised occurrences and more often than
    chance. A collocation is a word with its period and the word after it that stand together far more often than the
    second starts sentences (log-likelihood ratio); it overrules that the second is a starter. An ordinal's noun follows numbers with a period far more often than it starts a sentence. A continuation is
    a head that follows unsure marks far more often than it starts a sentence.
    """
    schema = pa.schema([("g", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, dict[str, Counter]] = {}

        def flush():
            rows = [(g, k, key, n) for g, kinds in held.items() for k, c in kinds.items() for key, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else None

        for b in batches:
            for t in b.column(0).to_pylist():
                g = group_of(t)
                observe(t, g, held.setdefault(g, {k: Counter() for k in KINDS}))
            if sum(len(c) for kinds in held.values() for c in kinds.values()) > 250_000 and (out := flush()) is not None:
                yield out
        if (out := flush()) is not None:
            yield out

    texts = docs.select("text").where(F.length(F.btrim("text")) > 0)
    c = stash(texts.mapInArrow(run, "g string, kind string, key string, n bigint").groupBy("g", "kind", "key").agg(F.sum("n").cast("double").alias("n")), "counts")
    of = lambda kind: c.where(F.col("kind") == kind).select("g", "key", "n")
    word, start = of("word"), of("start")
    totals = c.groupBy("g").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0.0)).alias(k) for k in ("word", "period", "pair", "start", "unsure", "number")])
    totals = F.broadcast(totals)  # a row per group
    enough = lambda n, of_all: n >= SHARE * of_all
    # starters: against all occurrences of the word as it is written
    s = start.withColumnRenamed("n", "k").join(word, ["g", "key"], "left").join(totals.select("g", F.col("start").alias("ks"), F.col("word").alias("ws")), "g")
    n = F.greatest(F.coalesce("n", F.lit(0.0)), F.col("k"))
    p = F.col("ks") / F.greatest("ws", "ks")
    strong = (F.col("k") / n >= 0.05) & (F.col("k") / n >= p) & (log_likelihood(F.col("k"), n, p) >= 7.88)
    s = s.where(enough(F.col("k"), F.col("ks")))
    starters = stash(s.where(strong | (F.col("n").isNull() & (F.col("k") >= 2))).select("g", "key"), "starters")
    # abbreviations: the period's affinity, and that the sentence goes on
    low = word.groupBy("g", F.lower("key").alias("key")).agg(F.sum("n").alias("all"))
    pairs = of("pair").select("g", F.split("key", "\t")[0].alias("key"), F.split("key", "\t")[1].alias("next"), "n")
    # in these languages too few starts are sure to tell that a word never starts a sentence
    cased = ~F.col("g").isin("ko", "hi", "th")
    odd = pairs.where(cased).join(starters.withColumnRenamed("key", "next"), ["g", "next"], "left_anti").groupBy("g", "key").agg(F.sum("n").alias("odd"))
    a = of("period").withColumnRenamed("n", "k").join(low, ["g", "key"]).join(of("goes on").withColumnRenamed("n", "on"), ["g", "key"], "left").join(odd, ["g", "key"], "left")
    a = a.join(totals.select("g", F.col("period").alias("ps"), F.col("word").alias("ws")), "g")
    every = F.greatest("all", "k")
    dots = F.length("key") - F.length(F.replace("key", F.lit("."), F.lit("")))
    size = F.length("key") - dots
    score = log_likelihood(F.col("k"), every, F.least(F.col("ps") / F.col("ws"), F.lit(0.99))) * F.exp(-size.cast("double")) * (dots + 1) * F.pow(size.cast("double"), -(every - F.col("k")))
    goes = (F.coalesce("on", F.lit(0.0)) + F.coalesce("odd", F.lit(0.0))) / F.col("k")
    rare = F.col("k") / every > F.col("ps") / F.col("ws")
    goes = F.when(F.col("g").isin(*UNCASED), F.lit(1.0)).otherwise(goes)
    a = a.where(enough(F.col("k"), F.col("ps")))
    abbreviations = a.where(rare & (((score >= 0.3) & (goes >= 0.15)) | ((goes >= 0.4) & (F.col("k") >= 3) & (F.col("k") / every >= 0.5)))).select("g", "key")
    # collocations: how often `next` follows the word and its period, against how often it starts a sentence
    after = pairs.groupBy("g", "key").agg(F.sum("n").alias("m"))
    both = pairs.where(cased & (F.col("n") >= 3)).join(after, ["g", "key"]).join(start.select("g", F.col("key").alias("next"), F.col("n").alias("starts")), ["g", "next"], "left")
    both = both.join(totals.select("g", F.col("start").alias("ks"), F.col("pair").alias("all")), "g").where(enough(F.col("n"), F.col("all")))
    p2 = F.greatest(F.coalesce("starts", F.lit(0.0)), F.lit(0.5)) / F.greatest("ks", F.lit(1.0))
    collocations = both.where((F.col("n") / F.col("m") >= 5 * p2) & (log_likelihood(F.col("n"), F.col("m"), F.least(p2, F.lit(0.99))) >= 10.83))
    collocations = collocations.select("g", F.concat("key", F.lit("\t"), "next").alias("key"))
    against = lambda kind: (
        of(kind).withColumnRenamed("n", "k").join(start, ["g", "key"], "left").join(totals.select("g", F.col(kind).alias("us"), F.col("start").alias("ks")), "g")
        .withColumn("n", F.coalesce("n", F.lit(0.0))).withColumn("p", (F.col("k") + F.col("n")) / (F.col("us") + F.col("ks")))
        .where(enough(F.col("k"), F.col("us")))
        .where((F.col("ks") > 0) & (F.col("n") / F.col("ks") < 0.1 * F.col("k") / F.col("us")))
        .where(log_likelihood(F.col("k"), F.col("us"), F.col("p")) + log_likelihood(F.col("n"), F.col("ks"), F.col("p")) >= 10.83).select("g", "key")
    )
    found = None
    for kind, df in (("abbreviations", abbreviations), ("starters", starters), ("collocations", collocations), ("ordinals", against("number")), ("continuations", against("unsure"))):
        df = df.select("g", F.lit(kind).alias("kind"), "key")
        found = df if found is None else found.unionByName(df)
    models: dict[str, Model] = {}
    for r in found.collect():
        getattr(models.setdefault(r["g"], Model()), r["kind"]).add(r["key"])
    return models


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "”』」）》】"


def ends(text: str, m: re.Match, e: int, group: str, model: Model) -> bool:
    """Whether the mark m, before the end e of its block, ends a sentence."""
    mark = m.group()
    at = NEXT.match(text, m.end(), e).end()
    if at >= e:
        return True
    space, c = at > m.end(), text[at]
    core = mark.rstrip(CLOSERS.replace("\\", "") + "   \n\r\t»›")
    closed = mark[len(core) :]
    last = core[-1]
    if c in STAY or (c in ".．" and not space):
        return False
    before = text[m.start() - 1] if m.start() else " "
    quoted = bool(QUOTES.intersection(closed))
    # the first letter or digit of what follows, past opening marks
    i = at
    while i < e and text[i] in OPENERS:
        i += 1
    first = text[i] if i < e else " "
    if c in "—–-" and first.islower():
        return False
    unspaced = group in UNSPACED and group != "th"
    if core[0] == "…" or (len(core) > 1 and not core.strip(".…")):
        if first.islower() and (first.isascii() or group not in UNSPACED):
            return False
        if unspaced:
            return head(text, at, e, UNSPACED[group]) not in model.continuations
        return space and (first.isupper() or not before.isspace())
    if last in "。｡！？" or (last in ".．" and (_cjk(before) or (unspaced and before.isdigit() and not (c.isascii() and c.isalnum())) or last == "．")):
        if last in ".．" and before.isdigit() and c.isdigit() and not space:
            return False
        if quoted and group == "ja":
            return not "ぁ" <= c <= "ゟ"
        if quoted and last in "！？!?" and not space:
            return not (_cjk(c) or c.isalnum())
        if last in ".．" and not unspaced and first.islower():
            return False
        return True
    if last in "।॥":
        return True
    if last in "!?؟":
        if quoted and group in ("ar", "hi", "ko", "th", "zh", "ja"):
            return False
        if first.islower():
            return False
        return space or first.isupper() or _cjk(c)
    # a single period
    if group == "th" or first.islower():
        return False
    j = m.start()
    while j > 0 and m.start() - j < LONGEST and not text[j - 1].isspace():
        j -= 1
    word = text[j : m.start()].lstrip(OPENERS)
    if not space:
        if unspaced and _cjk(c):
            return not (word.isascii() and word.isalpha()) or word.lower() not in model.abbreviations
        n = WORD.match(text, i)
        bare = word.rstrip(CLOSERS)
        plain = not re.search(r"[^\W\d_]\.[^\W\d_]", bare) or bare.lower() in model.abbreviations
        return bool(n) and first.isupper() and not before.isupper() and len(word) > 1 and plain and "/" not in word and n.group() in model.starters
    n = WORD.match(text, i)
    starts = bool(n) and n.group() in model.starters
    if closed and not word.lower() in model.abbreviations:
        return True
    if not word:
        return True
    if word[-1].isdigit():
        return starts or not (n and n.group() in model.ordinals)
    if unspaced:
        word = re.split(r"[^A-Za-zÀ-ɏ.]", word)[-1] or word
    low = word.lower()
    k = len(low)
    while k and TAIL.match(low, k - 1):
        k -= 1
    tail = low[k:].lstrip(".")
    if len(tail) == 1 and tail.isalpha():
        return False
    if group in UNCASED and sum(x.isalpha() for x in tail) == 1:
        # one letter with its vowel sign may be a word of its own; after an abbreviation it is an initial
        title = re.search(rf"({L}+)\.\s+$", text[max(0, j - 40) : j])
        if title and title.group(1) in model.abbreviations:
            return False
    if "." in tail.strip(".") and tail.replace(".", "").isalpha() or low in model.abbreviations or tail in model.abbreviations:
        return starts and f"{low}\t{n.group()}" not in model.collocations and not (n.end() < e and text[n.end()] == "." and len(n.group()) == 1)
    return True


def split(text: str, group: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence."""
    out = []
    for s, e in blocks(text):
        if ITEM.match(text, s):
            out.append((s, e))
            continue
        if group == "th":
            gaps = [(m.start(), m.end()) for m in THAI_GAP.finditer(text, s, e) if head(text, m.end(), e, 4) not in model.continuations and text[m.end()] not in "“\""]
            marks = [(m.end(), NEXT.match(text, m.end(), e).end()) for m in END.finditer(text, s, e) if ends(text, m, e, group, model)]
            for end, following in sorted({*gaps, *marks}):
                if end > s:
                    out.append((s, end))
                    s = following
        else:
            for m in END.finditer(text, s, e):
                if ends(text, m, e, group, model):
                    end = m.end()
                    out.append((s, end))
                    s = end if end < e and not text[end].isspace() else NEXT.match(text, end, e).end()
        if s < e:
            out.append((s, e))
    return out


def sentences(docs: DataFrame, with_text: bool = False, models: dict[str, Model] | None = None) -> DataFrame:
    """(doc_id, sentence_no, start_pos, end_pos[, sentence]) of each document, from 0.

    A blank line ends a sentence; a heading or list item is one unit with its mark; closing quotes and brackets belong to
    their sentence. Statistics are learnt from all texts, then each text is cut on its own: the only shuffle is that of
    the counts. Null, empty and blank texts have no sentence; repeated texts count under each doc_id; a null doc_id stays
    null; an empty table gives no row; other columns are ignored.
    """
    rows = spread(docs.select("doc_id", "text").where("text is not null"), "doc_id")
    known = docs.sparkSession.sparkContext.broadcast(learn(rows) if models is None else models)
    schema = pa.schema([("doc_id", pa.int64()), ("sentence_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())] + [("sentence", pa.string())] * with_text)

    def run(batches):
        none = Model()
        for b in batches:
            ids, no, a, z, said = [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = group_of(text)
                for i, (s, e) in enumerate(split(text, g, known.value.get(g, none))):
                    ids.append(key), no.append(i), a.append(s), z.append(e)
                    if with_text:
                        said.append(text[s:e])
            cols = [ids, no, a, z] + [said] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, sentence_no int, start_pos int, end_pos int" + ", sentence string" * with_text)


def found(docs: DataFrame) -> DataFrame:
    return sentences(docs).select("doc_id", "start_pos", "end_pos")
