"""Encoding of texts with a public byte-level BPE, as a reduction over a tree of pieces."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomgraph.llm.common import spread

VOCABULARY = os.environ.get("LOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf of the tree: few, so that nearly every text is put together by joins.
LEAF = 80
#: Characters of the first window on either side of a join.
WINDOW = 8

#: Between such two characters the pattern splits whatever stands around them: before white space, where a run of
#: letters ends, and where a run of digits ends. (A run of other characters may end in an apostrophe that belongs to
#: what follows, and a space belongs to what follows; these are no safe places.)
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


@functools.lru_cache(maxsize=4)
def _encoding(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    sizes = [0] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str = VOCABULARY):
    """(encoder, bytes of each token) of a vocabulary's file."""
    return _encoding(vocabulary(path))


def _sent(docs: DataFrame, path: str):
    """The vocabulary's file (under 1 MB) for all executors: only the driver needs to have it."""
    return docs.sparkSession.sparkContext.broadcast(vocabulary(path))


def join(encode, sizes: list[int], text: str, s: int, m: int, e: int, a: list[int], b: list[int], window: int = WINDOW) -> list[int]:
    """The ids of text[s:e] from those of text[s:m] and of text[m:e].

    If the seam itself is a safe place, the ids stand one after the other. Else a window on either side grows until it
    holds a safe place. The tokens before the left one and after the right one can't depend on what is between, as the
    pattern splits there in any surroundings; what is between is encoded again. A side without any safe place is encoded
    again as a whole. `sizes` are the tokens' bytes, which tell how many tokens of a side lie within its window.
    """
    if SAFE.match(text, m):
        return a + b
    w = window
    while not (f := SAFE.search(text, max(s + 1, m - w), m)) and m - w > s:
        w *= 2
    p, w, q = f.start() if f else s, window, -1
    while q < 0:
        for f in SAFE.finditer(text, m + 1, min(e, m + w)):
            q = f.start()
        if m + w >= e:
            break
        w *= 2
    q = e if q < 0 else q
    i, left = len(a), len(text[p:m].encode())
    while left > 0:
        i -= 1
        left -= sizes[a[i]]
    j, left = 0, len(text[m:q].encode())
    while left > 0:
        left -= sizes[b[j]]
        j += 1
    return a[:i] + encode(text[p:q]) + b[j:]


def encode_tree(encode, sizes: list[int], text: str, leaf: int = LEAF) -> list[int]:
    """The ids of a text: halves are encoded on their own, down to leaves, and joined up the tree."""

    def ids(s: int, e: int) -> list[int]:
        if e - s <= leaf:
            return encode(text[s:e])
        m = (s + e) // 2
        return join(encode, sizes, text, s, m, e, ids(s, m), ids(m, e))

    return ids(0, len(text))


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids; decoding is concatenation, so any cut of a text's ids decodes to a cut of its bytes."""
    return encoder(path)[0].decode(ids)


def token_ids(docs: DataFrame, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids). An empty or null text has no ids; strings that look like special tokens are ordinary text; repeated
    rows give repeated rows; a null doc_id stays null; an empty table gives no row; other columns are ignored. Only
    the document's own text is needed, so there is no shuffle but to spread a few large files."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    known = _sent(docs, path)

    def run(batches):
        encoding, sizes = _encoding(known.value)
        encode = encoding.encode_ordinary
        for b in batches:
            lists = [encode_tree(encode, sizes, t, leaf) if t else [] for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=out)

    return spread(docs.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens) of the documents whose text isn't empty."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    known = _sent(docs, path)

    def run(batches):
        encoding, sizes = _encoding(known.value)
        encode = encoding.encode_ordinary
        for b in batches:
            counts = [len(encode_tree(encode, sizes, t, leaf)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(counts, pa.int64())], schema=out)

    some = docs.select("doc_id", "text").where("text is not null and text <> ''")
    return spread(some, "doc_id").mapInArrow(run, "doc_id bigint, n_tokens bigint")
