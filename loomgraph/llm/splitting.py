"""Oversized texts in pieces under a limit, cut at content-defined landmarks that snap to natural boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import spread
from loomgraph.operators.attempts import latest_by_key

#: Characters of the rolling hash's window, and its multiplier.
ROLL, BASE = 16, np.uint64(0x9E3779B97F4A7C15)
#: Natural boundaries, the stronger first: a cut lies after the match. Blank lines; line ends; sentence ends; clause ends
#: and white space; the places between two characters of a script without spaces.
LEVELS = [
    ("paragraph", regex.compile(r"\n[^\S\n]*(?:\r?\n\s*)+|\r\n\s*\r\n\s*")),
    ("line", regex.compile(r"\r\n|[\n\r  ]")),
    ("sentence", regex.compile(r"(?:[.!?…؟।]+[\"'”’»)\]]*(?=\s))\s*|[。！？｡]+[”’」』）》]*")),
    ("word", regex.compile(r"[,;:،，、；：]\s*|\s+")),
    ("character", regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])(?=[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}])(?!\p{M})")),
]
#: A cut before such a character would tear a grapheme.
JOINED = regex.compile(r"[\p{M}‍️\U0001F3FB-\U0001F3FF]|(?<=‍).|(?<=\r)\n", regex.DOTALL)


def landmarks(text: str, every: int) -> np.ndarray:
    """Places where the hash of the ROLL characters before is 0 modulo `every`: they depend on these characters alone, so
    an edit moves no landmark further than a window away."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) <= ROLL:
        return np.empty(0, np.int64)
    h = np.zeros(len(codes) - ROLL + 1, np.uint64)
    for j in range(ROLL):
        h = h * BASE + codes[j : j + len(h)] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(32)) % np.uint64(every) == 0) + ROLL


def _nearest(a: np.ndarray, low: int, high: int, goal: int) -> int:
    """The entry of the sorted array a within [low, high] that is nearest to goal (the smaller of two), or -1."""
    i, j = np.searchsorted(a, low), np.searchsorted(a, high, "right")
    if i == j:
        return -1
    k = i + int(np.searchsorted(a[i:j], goal))
    near = [x for x in (k - 1, k) if i <= x < j]
    return int(min((a[x] for x in near), key=lambda x: (abs(int(x) - goal), x)))


def cuts(text: str, limit: int, overlap: int, least: int) -> list[tuple[int, int, str]]:
    """The pieces (start, end, kind of boundary at the end) of a text.

    A text within the limit is one piece. Else each cut is the natural boundary nearest to the first landmark that lies
    at least `least` characters after the last cut, as far as the limit allows; the strongest kind that has one there
    is taken. Every piece but the first starts `overlap` characters before the last cut.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    marks = landmarks(text, max(2, (limit - overlap - least) // 2))
    levels: list[np.ndarray | None] = [None] * len(LEVELS)
    out, last, start = [], 0, 0
    while n - start > limit:
        low, high = last + least, start + limit
        i = int(np.searchsorted(marks, low))
        goal = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        at, kind = -1, "none"
        for k, (name, pattern) in enumerate(LEVELS):
            if levels[k] is None:
                levels[k] = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
            if (at := _nearest(levels[k], low, high, goal)) >= 0:
                kind = name
                break
        if at < 0:
            at = goal
            while at > low and JOINED.match(text, at):
                at -= 1
            if at == low and JOINED.match(text, at):
                at = goal
        out.append((start, at, kind))
        last, start = at, at - overlap
    return [*out, (start, n, "end")]


def split_items(items: DataFrame, limit: int, overlap: int, least: int | None = None, with_text: bool = True) -> DataFrame:
    """(item_kind, item_id, piece_no, n_pieces, start_pos, end_pos, boundary[, text]) from (item_kind, item_id, body).

    Each row is cut on its own, so there is no shuffle. A null or empty body is one empty piece; a body within the limit
    is one piece; a very long body costs time in proportion to its length; repeated rows give repeated pieces.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    least = limit // 4 if least is None else least
    if not overlap < least <= limit - overlap:
        raise ValueError("least must be more than the overlap, and leave room for it")
    fields = [("item_kind", pa.string()), ("item_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("boundary", pa.string())]
    fields += [("text", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in fields]
            for kind, key, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = body or ""
                pieces = cuts(body, limit, overlap, least)
                for i, (s, e, how) in enumerate(pieces):
                    for c, v in zip(cols, (kind, key, i, len(pieces), s, e, how, body[s:e]), strict=False):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "item_kind string, item_id string, piece_no int, n_pieces int, start_pos int, end_pos int, boundary string" + ", text string" * with_text
    return items.select("item_kind", "item_id", "body").mapInArrow(run, ddl)


def document_items(docs: DataFrame) -> DataFrame:
    """Of each kb_documents.id the row with the latest updated_at."""
    latest = latest_by_key(docs, "id", ["updated_at", "body"], ["id", "updated_at", "body"])
    return latest.select(F.lit("document").alias("item_kind"), F.col("id").alias("item_id"), "body")


def chunk_items(chunks: DataFrame) -> DataFrame:
    """Each chunk_id once; of rows that differ the longest text, then the greatest, counts."""
    rows = chunks.select("chunk_id", F.length("text").alias("n"), "text")
    return latest_by_key(rows, "chunk_id", ["n", "text"], ["chunk_id", "n", "text"]).select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("text").alias("body"))


def pieces(docs: DataFrame, chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """Bodies over 1,600 characters with an overlap of 160, and stored chunks over 200 with one of 20."""
    d = split_items(document_items(docs), 1600, 160, with_text=with_text)
    return d.unionByName(split_items(chunk_items(chunks), 200, 20, with_text=with_text))


def found(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return pieces(docs, chunks, with_text=False).where("n_pieces > 1 and piece_no = 0 and item_id is not null").select("item_kind", "item_id")
