"""Attempts to mastery, weak prerequisite links, hotspots, and checks of imported rows. All students at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.operators.attempts import folded, latest_by_key, with_known_type
from loomgraph.runtime import bounded_broadcast

DAY_US = 86_400_000_000


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)).cast("double") / f.lit(DAY_US)


def graded_attempts(attempts: DataFrame, kps: DataFrame) -> DataFrame:
    """(attempt_id, student_id, kp_id, y, self_conf, latency_ms, hints_used, occurred_at, difficulty): each attempt_id once
    (its latest created_at), with a student, a known knowledge point as it is written in the reference list, a grade
    (y: 1.0 or 0.0) and a time. Other rows are left out; an empty table gives no row; other columns are ignored."""
    cols = ["attempt_id", "student_id", "kp_id", "correct", "self_conf", "latency_ms", "hints_used", "occurred_at", "created_at"]
    rows = with_known_type(attempts.select(*cols), kps)
    order = ["created_at", "occurred_at", "student_id", "correct", "self_conf", "latency_ms", "hints_used"]
    latest = latest_by_key(rows, "attempt_id", order, ["attempt_id", *order, "type_id"])
    hard = bounded_broadcast(kps.where("kp_id is not null").groupBy(F.col("kp_id").alias("type_id")).agg(F.min("difficulty").alias("difficulty")), 100_000)
    a = latest.where("student_id is not null and type_id is not null and correct is not null and occurred_at is not null").join(hard, "type_id", "left")
    return a.select("attempt_id", "student_id", F.col("type_id").alias("kp_id"), F.when(F.col("correct"), 1.0).otherwise(0.0).alias("y"), "self_conf", "latency_ms", "hints_used", "occurred_at", "difficulty")


def mastery_inputs(graded: DataFrame) -> DataFrame:
    """(student_id, kp_id, n, recent_acc, sev, self_conf, freq, last_at): one pass of partial sums, so a student with a
    third of all attempts costs one row per knowledge point and task."""
    return graded.groupBy("student_id", "kp_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("recent_acc"), F.avg(f.lit(1) - F.col("y")).alias("sev"),
        F.avg(F.col("self_conf").cast("double")).alias("self_conf"), F.sum(f.lit(1) - F.col("y")).cast("bigint").alias("freq"), F.max("occurred_at").alias("last_at"),
    )


def mastery_v1(inputs: DataFrame) -> DataFrame:
    """(student_id, kp_id, n, last_at, recent_acc, freq, score, band); a missing confidence counts as 3."""
    score = f.score_v1(F.col("recent_acc"), F.col("sev"), F.coalesce("self_conf", f.lit(3)))
    return inputs.withColumn("score", score).select("student_id", "kp_id", "n", "last_at", "recent_acc", "freq", "score", f.band(F.col("score")).alias("band"))


def trailing_run(rows: DataFrame, keys: list[str], order: list[str], good: Column, name: str) -> DataFrame:
    """(keys, name): how many rows in a row, up to the last, are good. By the place of the last row that isn't: two
    aggregates and no window, so a key with a third of all rows is reduced before the shuffle."""
    at = F.struct(*order)
    last_bad = rows.where(~good).groupBy(*keys).agg(F.max(at).alias("_bad"))
    if not keys:
        raise ValueError("needs keys")
    marked = rows.where(good).join(last_bad, keys, "left").where(F.col("_bad").isNull() | (at > F.col("_bad")))
    return rows.select(*keys).distinct().join(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def debt_graph(edges: DataFrame, kps: DataFrame, types: tuple[str, ...] = ("prerequisite", "transfer_gap")) -> DataFrame:
    """(from_kp, to_kp, weight, gap): the links between known knowledge points, over all packs; of several the greatest
    weight counts, and it is a gap if one of them is. An edge with an unknown, missing or equal end is dropped."""
    known = kps.select(F.col("kp_id").alias("k")).where("k is not null").distinct()
    e = edges.withColumn("t", folded(F.col("edge_type"))).where(F.col("t").isin(*types) & (F.col("from_kp") != F.col("to_kp")))
    e = e.join(known, e.from_kp == known.k, "left_semi").join(known, e.to_kp == known.k, "left_semi")
    return e.groupBy("from_kp", "to_kp").agg(F.max("weight").alias("weight"), F.max((F.col("t") == "transfer_gap").cast("int")).alias("gap"))


def debts(mastery: DataFrame, links: DataFrame, kps: DataFrame, max_links: int = 200_000) -> DataFrame:
    """(student_id, from_kp, to_kp, from_name, to_name, score_from, score_to, freq, weight, impact): the impact of every
    link whose two ends the student has a score of. freq is the mistakes at the child, or what its accuracy stands for.
    The links are sent to all tasks if they are few; the scores are shuffled by student and knowledge point only."""
    links = bounded_broadcast(links, max_links)
    to = mastery.select("student_id", F.col("kp_id").alias("to_kp"), F.col("score").alias("score_to"), "recent_acc", F.col("freq").alias("stored"))
    at = mastery.select("student_id", F.col("kp_id").alias("from_kp"), F.col("score").alias("score_from"))
    j = to.join(links, "to_kp").join(at, ["student_id", "from_kp"])
    derived = F.when((F.col("recent_acc") < 0.5) & (F.col("score_from") < 40), F.greatest(F.lit(1), F.bround((f.lit(0.5) - F.col("recent_acc")) * 12, 0).cast("int"))).otherwise(0)
    j = j.withColumn("freq", F.when(F.col("stored") > 0, F.col("stored")).otherwise(derived).cast("bigint"))
    j = j.withColumn("impact", f.impact_v1(F.col("score_from"), F.col("score_to"), F.col("freq"), f.lit(0), F.col("weight")))
    return named(j, kps, ["from_kp", "to_kp"]).select("student_id", "from_kp", "to_kp", "from_name", "to_name", "score_from", "score_to", "freq", "weight", "impact")


def named(rows: DataFrame, kps: DataFrame, cols: list[str], max_names: int = 200_000) -> DataFrame:
    """rows with x_name for each x_kp: the name of the knowledge point, or its id."""
    names = bounded_broadcast(kps.where("kp_id is not null").groupBy("kp_id").agg(F.min("kp_name").alias("_name")), max_names)
    for c in cols:
        n = names.select(F.col("kp_id").alias(c), F.col("_name").alias("_" + c))
        rows = rows.join(n, c, "left").withColumn(c.replace("_kp", "_name"), F.coalesce("_" + c, c)).drop("_" + c)
    return rows


def top_debts(scanned: DataFrame, n: int = 5) -> DataFrame:
    """The n links of each student with the greatest impact above 0 (n within 1 to 20); ties by the ends' ids."""
    n = min(max(n, 1), 20)
    w = Window.partitionBy("student_id").orderBy(F.desc("impact"), "from_kp", "to_kp")
    return scanned.where("impact > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hotspots(scanned: DataFrame, least_students: int = 3) -> DataFrame:
    """(from_kp, to_kp, students, avg_impact, sum_impact, suppressed) of the links with an impact: suppressed tells that
    more than five links are listed and the smallest stands for fewer than `least_students`."""
    h = scanned.where("impact > 0").groupBy("from_kp", "to_kp").agg(F.countDistinct("student_id").alias("students"), F.round(F.avg("impact"), 6).alias("avg_impact"), F.round(F.sum("impact"), 6).alias("sum_impact"))
    flag = h.agg(((F.count(F.lit(1)) > 5) & (F.min("students") < least_students)).alias("suppressed"))
    return h.join(F.broadcast(flag))  # a single row


def prerequisites(mastery: DataFrame, links: DataFrame, max_links: int = 200_000) -> DataFrame:
    """(student_id, kp_id, n_prereq, mean_prereq, min_prereq): the scores, 0 to 1, of the known prerequisites."""
    e = bounded_broadcast(links.select("from_kp", "to_kp"), max_links)
    p = mastery.select("student_id", F.col("kp_id").alias("from_kp"), (F.col("score") / 100).alias("s")).join(e, "from_kp")
    return p.groupBy("student_id", F.col("to_kp").alias("kp_id")).agg(F.count(F.lit(1)).alias("n_prereq"), F.avg("s").alias("mean_prereq"), F.min("s").alias("min_prereq"))


def import_issues(rows: DataFrame, kps: DataFrame, most: int = 400) -> DataFrame:
    """rows (batch_id, row_no, kp_id, recent_acc, sev, self_conf) with issues: an array of codes, empty for a good row.
    A batch of more than `most` rows has the issue OUT_OF_RANGE:rows on each. Missing numbers have no issue."""
    known = bounded_broadcast(kps.select(F.col("kp_id").alias("k"), F.lit(True).alias("known")).where("k is not null").distinct())
    j = rows.join(known, rows.kp_id == known.k, "left").drop("k")
    size = rows.groupBy(F.col("batch_id")).agg(F.count(F.lit(1)).alias("_size"))
    j = j.join(size, "batch_id")
    blank = F.col("kp_id").isNull() | (F.btrim("kp_id") == "")
    out = lambda c, low, high: (F.col(c) < low) | (F.col(c) > high)
    tests = [
        (blank, "MISSING_FIELD:kpId"), (~blank & F.col("known").isNull(), "UNKNOWN_KP:kpId"), (out("recent_acc", 0, 1), "OUT_OF_RANGE:recentAcc"), (out("sev", 0, 1), "OUT_OF_RANGE:sev"),
        (out("self_conf", 1, 5) | (F.abs(F.col("self_conf") - F.bround("self_conf", 0)) > 1e-9), "OUT_OF_RANGE:selfConf"), (F.col("_size") > most, "OUT_OF_RANGE:rows"),
    ]
    return j.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in tests]))).drop("known", "_size")


def import_report(checked: DataFrame) -> DataFrame:
    """(batch_id, accepted, rejected, all_rejected): a batch is refused only if all of its rows are."""
    bad = F.exists("issues", lambda x: x != "OUT_OF_RANGE:rows")
    r = checked.groupBy("batch_id").agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
    return r.withColumn("all_rejected", F.col("accepted") == 0)


def attempt_fold(graded: DataFrame) -> DataFrame:
    """(student_id, kp_id, acc, sev, streak, n): the moving values after each student's attempts at a point, in the order
    of (occurred_at, attempt_id). The moving average is a weighted sum with falling powers, so it needs each attempt's
    place only, no state: a0 * 0.9^(n-1) + 0.1 * sum(y_i * 0.9^(n-i)); the severity is a product of factors, cut at 1 as
    it goes, which its running maximum gives."""
    by = Window.partitionBy("student_id", "kp_id").orderBy("occurred_at", "attempt_id")
    whole = Window.partitionBy("student_id", "kp_id")
    r = graded.withColumn("i", F.row_number().over(by)).withColumn("n", F.count(F.lit(1)).over(whole))
    r = r.withColumn("step", F.when(F.col("i") == 1, f.lit(0)).otherwise(F.log(F.when(F.col("y") == 1, f.lit(0.9)).otherwise(f.lit(1.05)))))
    first = F.when(F.col("y") == 1, F.log(f.lit(0.2))).otherwise(F.log(f.lit(0.5)))
    r = r.withColumn("start", F.first(first).over(by)).withColumn("walk", F.col("start") + F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # reflected at log 1 = 0: the walk less the greatest excess so far
    r = r.withColumn("over", F.greatest(f.lit(0), F.max("walk").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    left = F.pow(f.lit(0.9), (F.col("n") - F.col("i")).cast("double"))
    share = F.when(F.col("i") == 1, F.when(F.col("y") == 1, f.lit(0.8)).otherwise(f.lit(0.4))).otherwise(f.lit(0.1) * F.col("y"))
    return r.groupBy("student_id", "kp_id").agg(
        F.sum(share * left).alias("acc"), F.max(F.when(F.col("i") == F.col("n"), F.exp(F.col("walk") - F.col("over")))).alias("sev"),
        (F.max("n") - F.coalesce(F.max(F.when(F.col("y") == 0, F.col("i"))), F.lit(0))).alias("streak"), F.max("n").alias("n"),
    )
