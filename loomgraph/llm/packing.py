"""Items of varying length in containers of a fixed capacity, by minimum bin slack."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.tokens import VOCABULARY, token_counts
from loomgraph.runtime import stash

CAPACITY = 2048
#: Rows of one length that one task ranks.
RANKED = 100_000


def best_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as large as possible but not over room.

    A bitset holds the sums that can be reached: bit s is set if some choice sums to s. Lengths come in descending order,
    each in groups of 1, 2, 4, ... of its count; walking the groups backwards gives the counts of one choice.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    full = 1 << room
    for size in sorted(counts, reverse=True):
        left, group = min(counts[size], room // size), 1
        while left > 0:
            take = min(group, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            group *= 2
            if reach & full:
                break
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[size] = chosen.get(size, 0) + take
            at -= size * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings of a container (how many items of each length) and how often each is used; all items are used up.

    The longest length left is set into a container and the rest is filled as closely as the lengths left allow. The
    filling is used until one of its lengths runs out, so there are at most as many fillings as lengths: the work depends
    on the capacity, not on the number of items.
    """
    left, fillings = {s: n for s, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        take = best_subset({s: n for s, n in rest.items() if n and s <= capacity - longest}, capacity - longest) if longest < capacity else {}
        take[longest] = take.get(longest, 0) + 1
        times = min(left[s] // k for s, k in take.items())
        for s, k in take.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        fillings.append((take, times))
    return fillings


def _slots(fillings: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """The plan by (length, rank): arrays sorted by key = length and first rank; with the items per container, the first
    container, and the offset of the first item of the length in its container."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for take, times in fillings:
        offset = 0
        for size in sorted(take, reverse=True):
            first = used.get(size, 0)
            rows.append((size, first, take[size], base, offset))
            used[size] = first + take[size] * times
            offset += take[size] * size
        base += times
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3], a[:, 4]


def pack(items: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, container, offset) from items (doc_id, n_tokens).

    An item longer than the capacity is split: whole containers of its own and a rest that is packed like any item; no
    other item is split. The lengths' histogram, at most `capacity` rows, is all that comes to the driver; it makes the
    plan, a list of fillings with their counts. Then each item needs only its rank among the items of its length: rank
    and length give the container and the place in it. Ranks are taken in parts by the hash of the id, so a length that
    most items share is ranked by as many tasks as it needs.

    Items of length 0 or null are left out; repeated rows are items of their own; an empty table gives no row.
    """
    spark = items.sparkSession
    pieces = items.where("n_tokens > 0").select(
        "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")), lambda i: F.least(F.col("n_tokens") - i * capacity, F.lit(capacity)))).alias("piece_no", "size")
    )
    pieces = stash(pieces.select("doc_id", "piece_no", F.col("size").cast("int").alias("size")), "pieces")
    counts = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    parts = max(1, -(-sum(counts.values()) // ranked))
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity)))
    at = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    before = (
        at.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    )
    place = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "piece_no")) - 1 + F.col("before")
    ranks = at.join(before, ["size", "part"]).select("doc_id", "piece_no", "size", place.cast("bigint").alias("rank"))
    out = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int32()), ("container", pa.int64()), ("offset", pa.int32())])

    def run(batches):
        size, first, each, base, offset = slots.value
        # one number that orders by length, then rank
        key = size * (1 << 44) + first
        for b in batches:
            s, r = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
            i = np.searchsorted(key, s * (1 << 44) + r, side="right") - 1
            k = r - first[i]
            cols = [b.column(0).cast(pa.int64()), b.column(1), b.column(1).to_numpy().astype(np.int64) * capacity, s.astype(np.int32), base[i] + k // each[i], (offset[i] + k % each[i] * s).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(cols, out, strict=True)], schema=out)

    return ranks.mapInArrow(run, "doc_id bigint, piece_no int, first_token bigint, n_tokens int, container bigint, offset int")


def containers(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    return pack(token_counts(docs, path), capacity)
