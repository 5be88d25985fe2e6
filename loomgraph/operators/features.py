"""One row per entity with counts, correct counts and recency for each of hundreds of event types."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.attempts import latest_by_key, with_known_type
from loomgraph.runtime import bounded_broadcast, shuffle_width, stash_path

CELL = "array<struct<type_id:string,n_attempts:bigint,n_correct:bigint,last_at:timestamp>>"


def typed_blocks(types: DataFrame, block_size: int) -> DataFrame:
    """(type_id, block): types in byte order, cut into blocks of block_size. The window runs over the reference list of
    types, which doesn't grow with the events."""
    from pyspark.sql import Window

    ids = types.select(F.col("kp_id").alias("type_id")).where("type_id is not null").distinct()
    return ids.select("type_id", F.floor((F.row_number().over(Window.orderBy("type_id")) - 1) / block_size).cast("int").alias("block"))


def entity_features(attempts: DataFrame, types: DataFrame, block_size: int = 64, max_types: int = 100_000) -> DataFrame:
    """The complete entity table: (student_id, n_attempts, n_correct, last_at, f000, f001, ...).

    Column fNNN is the block NNN of event types: an array, ordered by type_id, with a cell (type_id, n_attempts,
    n_correct, last_at) for every type of that block that the student has tried; types without an attempt have no cell
    and count 0. Blocks, not single columns, so that the plan stays as wide as the number of blocks; `feature` picks a
    single count out of them.

    Each attempt_id counts once (its latest created_at). The cells are summed before the shuffle, so a student with a
    third of all rows costs one row per type and task. They are written once, bucketed by student; every block is aggregated and joined on those buckets without another shuffle.

    Results in special cases: rows without a student are left out; students with only unknown or null types stay, with
    empty blocks; a null `correct` counts as an attempt that isn't correct; a null occurred_at leaves last_at untouched;
    rows with a null attempt_id count each; an empty table gives no row. Columns that aren't named here are ignored.
    """
    spark = attempts.sparkSession
    rows = with_known_type(attempts.select("attempt_id", "student_id", "kp_id", "correct", "occurred_at", "created_at"), types, max_types)
    latest = latest_by_key(rows, "attempt_id", ["created_at", "occurred_at"], ["created_at", "occurred_at", "student_id", "type_id", "correct"])
    cells = (
        latest.where("student_id is not null")
        .groupBy("student_id", "type_id")
        .agg(F.count(F.lit(1)).alias("n_attempts"), F.sum(F.when(F.col("correct"), 1).otherwise(0)).cast("bigint").alias("n_correct"), F.max("occurred_at").alias("last_at"))
    )
    blocks = typed_blocks(types, block_size)
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    width = shuffle_width(spark)
    name = f"loom_cells_{uuid.uuid4().hex}"
    (
        cells.join(bounded_broadcast(blocks, max_types), "type_id", "left")
        .withColumn("block", F.coalesce("block", F.lit(-1)))
        .repartition(width, "student_id")
        .write.bucketBy(width, "student_id").sortBy("student_id", "block")
        .option("path", stash_path(spark, "cells")).format("parquet").saveAsTable(name)
    )
    # a plan that was made keeps the files and their buckets; the name in the catalog isn't needed any more
    cells = spark.table(name)
    cells.columns
    spark.sql(f"DROP TABLE {name}")
    wide = cells.groupBy("student_id").agg(F.sum("n_attempts").alias("n_attempts"), F.sum("n_correct").alias("n_correct"), F.max("last_at").alias("last_at"))
    for b in range(n_blocks):
        part = (
            cells.where(F.col("block") == b)
            .groupBy("student_id")
            .agg(F.sort_array(F.collect_list(F.struct("type_id", "n_attempts", "n_correct", "last_at"))).alias(f"f{b:03d}"))
        )
        wide = wide.join(part, "student_id", "left")
    empty = F.array().cast(CELL)
    return wide.select("student_id", "n_attempts", "n_correct", "last_at", *[F.coalesce(F.col(f"f{b:03d}"), empty).alias(f"f{b:03d}") for b in range(n_blocks)])


def dense_features(wide: DataFrame, types: DataFrame, block_size: int = 64, max_types: int = 100_000) -> DataFrame:
    """The entity table with fixed places: for block NNN the arrays nNNN (attempts), cNNN (correct ones), both 0 where there
    is none, and tNNN (last time, null where there is none), in the order of the block's type_id. The reference list, which
    doesn't grow with the events, is read by the driver; one of more than max_types types is refused."""
    rows = typed_blocks(types, block_size).orderBy("type_id").limit(max_types + 1).collect()
    if len(rows) > max_types:
        raise ValueError("too many event types")
    out = ["student_id", "n_attempts", "n_correct", "last_at"]

    blocks = block_columns(wide)
    # one map a block, read by three columns, so that it is made once a row
    cells = wide.select(*out, *[F.map_from_entries(F.transform(c, lambda x: F.struct(x["type_id"], x))).alias(c) for c in blocks])

    def placed(block: str, field: str, empty: Column) -> Column:
        ids = F.array(*[F.lit(r["type_id"]) for r in rows if r["block"] == int(block[1:])]).cast("array<string>")
        return F.transform(ids, lambda i: F.coalesce(F.try_element_at(F.col(block), i)[field], empty))

    for c in blocks:
        for letter, field, empty in (("n", "n_attempts", F.lit(0).cast("bigint")), ("c", "n_correct", F.lit(0).cast("bigint")), ("t", "last_at", F.lit(None).cast("timestamp"))):
            out.append(placed(c, field, empty).alias(letter + c[1:]))
    return cells.select(*out)


def block_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if len(c) >= 4 and c[0] == "f" and c[1:].isdigit()]


def feature(wide: DataFrame, type_id: str, what: str = "n_attempts") -> Column:
    """One feature as a column: n_attempts or n_correct (0 if there is none), or last_at (null if there is none)."""
    found = F.filter(F.concat(*[F.col(c) for c in block_columns(wide)]), lambda x: x["type_id"] == type_id)
    value = F.try_element_at(found, F.lit(1))[what]
    return value if what == "last_at" else F.coalesce(value, F.lit(0))


def feature_cells(wide: DataFrame) -> DataFrame:
    """The wide table read back as one row per student and type with at least one attempt."""
    cell = F.explode(F.concat(*[F.col(c) for c in block_columns(wide)]))
    return wide.select("student_id", cell.alias("c")).select("student_id", "c.*")


def yyyymmdd(ts: Column) -> Column:
    """The UTC day of a timestamp as an int, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def found(attempts: DataFrame, types: DataFrame) -> DataFrame:
    return feature_cells(entity_features(attempts, types)).select("student_id", F.col("type_id").alias("kp_id"), "n_attempts", "n_correct", yyyymmdd(F.col("last_at")).alias("last_day"))
