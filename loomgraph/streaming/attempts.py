"""Attempts as a stream: daily counts with late data, sliding and session windows, and moving values per student and point."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomgraph.runtime import stash_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The attempts under a path as a stream; a single Parquet file counts as a folder of one."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def usable(attempts: DataFrame, late: str = "60 days") -> DataFrame:
    """Attempts with an id, a student, a grade and a time; an attempt that is sent again within `late` counts once. The
    state of that is bounded by the watermark."""
    a = attempts.where("attempt_id is not null and student_id is not null and correct is not null and occurred_at is not null")
    return a.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["attempt_id"])


def daily(attempts: DataFrame, late: str = "60 days") -> DataFrame:
    """(student_id, day_us, n, right): tumbling windows of a UTC day; later rows than `late` are dropped."""
    w = attempts.withWatermark("occurred_at", late).groupBy("student_id", F.window("occurred_at", "1 day").alias("w"))
    a = w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("right"))
    return a.select("student_id", F.unix_micros("w.start").alias("day_us"), "n", "right")


def sliding(attempts: DataFrame, size: str = "7 days", step: str = "1 day", late: str = "60 days") -> DataFrame:
    """(kp_id, start_us, n): sliding windows per knowledge point."""
    w = attempts.where("kp_id is not null").withWatermark("occurred_at", late).groupBy("kp_id", F.window("occurred_at", size, step).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("kp_id", F.unix_micros("w.start").alias("start_us"), "n")


def sessions(attempts: DataFrame, gap: str = "30 minutes", late: str = "60 days") -> DataFrame:
    """(student_id, start_us, end_us, n): session windows; a session ends `gap` after its last attempt, end_us is that
    attempt's time."""
    w = attempts.withWatermark("occurred_at", late).groupBy("student_id", F.session_window("occurred_at", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("occurred_at").alias("last")).select("student_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("end_us"), "n")


MOVING = "student_id string, kp_id string, acc double, sev double, streak bigint, n bigint"
#: The state of a part: the values of all its keys, in columns.
HELD = "student_id array<string>, kp_id array<string>, acc array<double>, sev array<double>, streak array<bigint>, n array<bigint>"


def moving(attempts: DataFrame, parts: int = 4096) -> DataFrame:
    """(student_id, kp_id, acc, sev, streak, n) after each micro-batch, in update mode: nine parts before and one part new,
    a severity that falls by a tenth and rises by a twentieth, and the right answers at the end. Within a micro-batch
    attempts count in the order of their times; a later batch goes on from the state, which is six values a key.

    Most keys have a row or two, and each call of Python costs as much as a thousand of them, so the keys are hashed to
    `parts` groups with one state each; a student with many attempts is spread by knowledge point. A checkpoint holds for
    one number of parts."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {}
        if state.exists:
            students, points, *values = state.get
            held = dict(zip(zip(students, points, strict=True), zip(*values, strict=True), strict=True))
        rows = pd.concat(list(frames)).sort_values(["occurred_at", "attempt_id"])
        new = {}
        for *key, right in zip(rows["student_id"].tolist(), rows["kp_id"].tolist(), rows["correct"].astype(bool).tolist(), strict=True):
            k = tuple(key)
            acc, sev, streak, n = new.get(k) or held.get(k) or (0.0, 0.0, 0, 0)
            if n:
                acc = (9 * acc + right) / 10
                sev = min(1.0, sev * (0.9 if right else 1.05))
            else:
                acc, sev = (0.8, 0.2) if right else (0.4, 0.5)
            new[k] = acc, sev, (streak + 1 if right else 0), n + 1
        columns = lambda of: [list(c) for c in zip(*(k + v for k, v in of.items()), strict=True)]
        state.update(tuple(columns(held | new)))
        yield pd.DataFrame(dict(zip(("student_id", "kp_id", "acc", "sev", "streak", "n"), columns(new), strict=True)))

    a = attempts.where("kp_id is not null").select("student_id", "kp_id", "attempt_id", "occurred_at", "correct")
    a = a.withColumn("part", F.pmod(F.xxhash64("student_id", "kp_id"), F.lit(parts)))
    return a.groupBy("part").applyInPandasWithState(step, MOVING, HELD, "update", "NoTimeout")


def drain(stream: DataFrame, key: list[str], order: str | None = None, mode: str = "append") -> DataFrame:
    """What a stream gives for the data that is there now, from files: every micro-batch is written under its number, so a
    batch that is tried again replaces itself. In update mode the last row of a key counts, the one with the greatest
    `order`. In complete mode the last batch counts."""
    spark = stream.sparkSession
    out, at = stash_path(spark, "stream"), stash_path(spark, "offsets")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.queryName(f"drain-{uuid.uuid4().hex}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", at).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(out)
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # a single row
    names = [f.name for f in rows.schema if f.name not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max(F.struct(F.col(order or "batch").alias("_o"), F.col("batch").alias("_b"), *names)).alias("x"))
    return last.select(*key, *[f"x.{c}" for c in names])
