"""Sessions: each user's events split where the user was inactive for longer than a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.attempts import latest_by_key

GAP_US = 1_800_000_000


def sessionize(events: DataFrame, user: str = "student_id", at: str = "occurred_at", gap_us: int = GAP_US, slice_us: int = 86_400_000_000) -> DataFrame:
    """(user, session_no, start_us, end_us, duration_us, n_events): a session ends where the user's next event comes more
    than gap_us later; session_no counts from 1 within the user.

    A lag flags the gaps and a running sum of the flags numbers the runs. Both windows run per user and time slice, so a
    user with a third of all events is spread over as many tasks as there are slices. Events of one instant are counted
    before the shuffle. Only the first and last run of a slice can go on in a neighbouring slice; a second window per
    user joins these, at most two rows per slice, whatever the number of events. Runs inside a slice are whole.

    Results in special cases: events without a user or a time are left out; repeated rows count each (remove them
    before); an event exactly gap_us after the last belongs to its session; an empty table gives no row; other columns
    are ignored.
    """
    t = F.unix_micros(F.col(at))
    ticks = (
        events.select(F.col(user).alias("u"), t.alias("t")).where("u is not null and t is not null")
        .groupBy("u", F.floor(F.col("t") / F.lit(slice_us)).alias("s"), "t").agg(F.count(F.lit(1)).alias("n"))
        .repartition("u", "s")
    )
    by = Window.partitionBy("u", "s").orderBy("t")
    flagged = ticks.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(by) > gap_us).cast("int"), F.lit(0)))
    runs = (
        flagged.withColumn("r", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("u", "s", "r").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.sum("n").alias("n"))
    )
    runs = runs.withColumn("last", F.max("r").over(Window.partitionBy("u", "s")))
    edge = (F.col("r") == 0) | (F.col("r") == F.col("last"))
    tagged = runs.select("u", "a", "b", "n", edge.alias("edge"))
    chain = Window.partitionBy("u").orderBy("a")
    joined = (
        tagged.where("edge")
        # the run before may lie inside the slice: then it ended more than a gap ago, as did every earlier edge run
        .withColumn("new", F.coalesce((F.col("a") - F.lag("b").over(chain) > gap_us).cast("int"), F.lit(1)))
        .withColumn("k", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("u", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    )
    whole = tagged.where("not edge").select("u", "a", "b", "n").unionByName(joined.select("u", "a", "b", "n"))
    return whole.select(F.col("u").alias(user), F.col("a").alias("start_us"), F.col("b").alias("end_us"), (F.col("b") - F.col("a")).alias("duration_us"), F.col("n").alias("n_events"))


def numbered(sessions: DataFrame, user: str = "student_id") -> DataFrame:
    """sessions with session_no. Sessions of a user are ranked in slices of a day, whose counts are summed first, so no
    task holds all of a user's sessions."""
    day = F.floor(F.col("start_us") / F.lit(86_400_000_000))
    s = sessions.withColumn("_d", day)
    before = (
        s.groupBy(user, "_d").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(user).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    no = F.row_number().over(Window.partitionBy(user, "_d").orderBy("start_us")) + F.col("_before")
    return s.join(before, [user, "_d"]).withColumn("session_no", no.cast("bigint")).drop("_d", "_before")


def attempt_sessions(attempts: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    latest = latest_by_key(attempts, "attempt_id", ["created_at", "occurred_at"], ["created_at", "occurred_at", "student_id"])
    return sessionize(latest, gap_us=gap_us)


def found(attempts: DataFrame) -> DataFrame:
    return attempt_sessions(attempts).select("student_id", "start_us", "end_us", F.col("n_events").alias("n_attempts"))
