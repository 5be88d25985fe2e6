"""Skip-gram vectors of words, trained in shards on counted pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import shuffle_width, stash

#: Words with vectors: the most frequent ones, seen LEAST times or more. Rarer words are judged by the vectors of the words around them,
#: so the bound limits no text and no word that is corrected, only what it is corrected to.
VOCABULARY, LEAST = 32_768, 5
WIDTH, WINDOW, NEGATIVES, ROUNDS = 32, 4, 5, 4
#: Words, and single ideographs.
TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[㐀-鿿]")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


@dataclass
class Vectors:
    """x of a word times y of a neighbour is about their pointwise mutual information less the log of NEGATIVES."""

    index: dict[str, int]
    x: np.ndarray
    y: np.ndarray

    def fit(self, word: str, around: list[str]) -> float:
        """How much likelier the words around are beside this word than anywhere, as a sum of logs; 0 without a vector."""
        i = self.index.get(word, -1)
        at = [j for c in around if (j := self.index.get(c, -1)) >= 0]
        if i < 0 or not at:
            return 0.0
        return float(np.clip(self.y[at] @ self.x[i] + np.log(NEGATIVES), -3.0, 3.0).sum())


def pairs_of(texts: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, n): how often two words of the vocabulary stand within WINDOW words of each other in a text; key is
    smaller * VOCABULARY + greater."""
    ids: list[int] = []
    for t in texts:
        ids += [index.get(w, -1) for w in tokens(t)]
        ids += [-1] * WINDOW
    a = np.array(ids, np.int64)
    keys = []
    for k in range(1, WINDOW + 1):
        i, j = a[:-k], a[k:]
        both = (i >= 0) & (j >= 0)
        keys.append(np.minimum(i, j)[both] * VOCABULARY + np.maximum(i, j)[both])
    return np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)


def _step(x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, draw: np.ndarray, rate: float) -> None:
    """One step on pairs (i, j) of weight w; the negatives are drawn for the whole batch."""
    xi, yj, yn = x[i], y[j], y[draw]
    pos = w * (1 - _sigmoid((xi * yj).sum(1)))
    neg = -(w * NEGATIVES / len(draw))[:, None] * _sigmoid(xi @ yn.T)
    _move(x, gx, i, pos[:, None] * yj + neg @ yn, rate)
    _move(y, gy, np.concatenate([j, draw]), np.concatenate([pos[:, None] * xi, neg.T @ xi]), rate)


def _move(table: np.ndarray, past: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """Adds the gradients to their rows, each row at a rate that falls with what it has moved so far."""
    order = np.argsort(at, kind="stable")
    rows, starts = np.unique(at[order], return_index=True)
    total = np.add.reduceat(grad[order], starts, axis=0)
    past[rows] += (total**2).mean(1)
    table[rows] += rate * total / np.sqrt(past[rows] + 1e-8)[:, None]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def train(texts: DataFrame, words: DataFrame, rounds: int = ROUNDS, seed: int = 11) -> Vectors:
    """The vectors of the most frequent of `words` (key, n), from `texts` (text).

    All pairs within the window are counted first, in the tasks and then by pair, so that training reads each different
    pair once a round, with its count to the power 0.75 as weight, however long the texts are. The pairs are cut into
    shards by their first word. In a round every shard starts from the common vectors and steps through its pairs with
    negatives drawn by frequency; between rounds the shards' vectors are averaged. What reaches the driver and goes out
    again is 2 x VOCABULARY x WIDTH numbers at most.
    """
    spark = texts.sparkSession
    top = words.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(VOCABULARY).select("key", "n").toArrow()
    index = {w: i for i, w in enumerate(top.column("key").to_pylist())}
    size = len(index)
    rng = np.random.default_rng(seed)
    x, y = ((rng.random((2, size, WIDTH)) - 0.5) / 4).astype(np.float32)
    if size < 2:
        return Vectors(index, x, y)
    share = np.array(top.column("n").to_pylist(), float) ** 0.75
    share = np.cumsum(share / share.sum())
    known = spark.sparkContext.broadcast((index, share))

    def count(batches):
        for b in batches:
            key, n = pairs_of(b.column(0).to_pylist(), known.value[0])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = texts.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    i, j = F.floor(F.col("key") / VOCABULARY).cast("int"), (F.col("key") % VOCABULARY).cast("int")
    both = counted.select(F.explode(F.array(F.struct(i.alias("i"), j.alias("j"), "n"), F.struct(j.alias("i"), i.alias("j"), "n"))).alias("p")).select("p.*")
    pairs = stash(both.repartition(shuffle_width(spark), "i"), "pairs")
    out = pa.schema([("side", pa.int32()), ("id", pa.int32()), ("w", pa.float64()), *[(f"v{k}", pa.float64()) for k in range(WIDTH)]])
    ddl = "side int, id int, w double, " + ", ".join(f"v{k} double" for k in range(WIDTH))

    for r in range(rounds):
        now = spark.sparkContext.broadcast((x, y))

        def shard(batches, now=now, r=r):
            a, b = (m.astype(np.float64) for m in now.value)
            ga, gb = np.zeros(len(a)), np.zeros(len(b))
            seen = np.zeros((2, len(a)))
            draws = np.random.default_rng(seed + r)
            for t in batches:
                i, j, n = (c.to_numpy() for c in t.columns)
                w = n.astype(np.float64) ** 0.75
                for at in np.array_split(draws.permutation(len(i)), max(1, len(i) // 512)):
                    _step(a, b, ga, gb, i[at], j[at], w[at], np.searchsorted(known.value[1], draws.random(256)).clip(0, len(a) - 1), 0.15)
                np.add.at(seen[0], i, w), np.add.at(seen[1], j, w)
            for side, m in enumerate((a, b)):
                rows = np.flatnonzero(seen[side])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), side, np.int32)), pa.array(rows.astype(np.int32)), pa.array(seen[side][rows]), *[pa.array(m[rows, k]) for k in range(WIDTH)]], schema=out)

        parts = pairs.mapInArrow(shard, ddl).groupBy("side", "id").agg(*[(F.sum(F.col("w") * F.col(f"v{k}")) / F.sum("w")).alias(f"v{k}") for k in range(WIDTH)])
        t = parts.toArrow()
        side, rows = t.column("side").to_numpy(), t.column("id").to_numpy()
        m = np.stack([t.column(f"v{k}").to_numpy() for k in range(WIDTH)], 1).astype(np.float32)
        x, y = x.copy(), y.copy()
        x[rows[side == 0]], y[rows[side == 1]] = m[side == 0], m[side == 1]
        now.unpersist()
    return Vectors(index, x, y)
