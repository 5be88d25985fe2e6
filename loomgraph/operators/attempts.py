"""Attempts: one row per attempt_id, and knowledge points in the spelling of the reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import WHITE_SPACE, bounded_broadcast


def folded(c: Column) -> Column:
    """A key without regard to case and surrounding white space."""
    return F.lower(F.btrim(c, F.lit(WHITE_SPACE)))


def known_types(types: DataFrame, type_col: str = "kp_id") -> DataFrame:
    """(type_key, type_id) of the reference list: one row per folded key; of several spellings the first in byte order."""
    return (
        types.select(F.col(type_col).alias("type_id"))
        .where(F.col("type_id").isNotNull())
        .groupBy(folded(F.col("type_id")).alias("type_key"))
        .agg(F.min("type_id").alias("type_id"))
    )


def latest_by_key(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Of the rows of one key only the one that is greatest in `order` (nulls lowest), then in `keep`.

    A maximum over a struct, so each map task sends one row per key: a key that holds a third of all rows is reduced
    before the shuffle. Rows with a null key match nothing and all stay. The key comes back, as a string, if it is in `keep`.
    """
    unique = F.when(F.col(key).isNull(), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    rest = [c for c in keep if c not in order and c != key]
    return (
        rows.select(F.col(key).cast("string").alias("_key"), unique.alias("_own"), F.struct(*[F.col(c) for c in [*order, *rest]]).alias("_row"))
        .groupBy(F.coalesce("_key", "_own").alias("_id"))
        .agg(F.max("_row").alias("_row"))
        .select(*[F.when(~F.col("_id").startswith("\x00"), F.col("_id")).alias(key)] * (key in keep), *[F.col(f"_row.{c}").alias(c) for c in keep if c != key])
    )


def with_known_type(attempts: DataFrame, types: DataFrame, max_types: int = 100_000) -> DataFrame:
    """attempts with type_id: kp_id as written in the reference list, null if it isn't known there."""
    t = bounded_broadcast(known_types(types), max_types)
    return attempts.withColumn("type_key", folded(F.col("kp_id"))).join(t, "type_key", "left").drop("type_key")
