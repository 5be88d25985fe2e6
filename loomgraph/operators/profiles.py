"""Profiles of learners: calibration, behaviour, topics, trends, cohorts and timelines. All students at once.

Rows are graded attempts (learners.graded_attempts). A student may hold a third of all rows: sums are partial, and what
needs an order runs per student and day, with a second step over the days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import formulas as f

ORDER = ["occurred_at", "attempt_id"]


def day_of(ts: Column) -> Column:
    """Days since 1970 in UTC."""
    return F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")


def placed(rows: DataFrame, key: str = "student_id", order: list[str] = ORDER) -> DataFrame:
    """rows with place (from 1) and n within the key, and prev_y of the row before. A window ranks each day of a key; the
    days' counts and last rows, one row a day, are summed and shifted by a second window."""
    r = rows.withColumn("_d", day_of(F.col(order[0])))
    day = Window.partitionBy(key, "_d").orderBy(*order)
    days = r.groupBy(key, "_d").agg(F.count(F.lit(1)).alias("_k"), F.max_by("y", F.struct(*order)).alias("_last"))
    over = Window.partitionBy(key).orderBy("_d")
    days = days.select(
        key, "_d", F.coalesce(F.sum("_k").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(over).alias("_shift"), F.sum("_k").over(Window.partitionBy(key)).alias("n"),
    )
    r = r.withColumn("_i", F.row_number().over(day)).withColumn("_lag", F.lag("y").over(day)).join(days, [key, "_d"])
    return r.withColumn("place", F.col("_i") + F.col("_before")).withColumn("prev_y", F.coalesce("_lag", "_shift")).drop("_d", "_i", "_before", "_lag", "_shift")


def confidence(c: Column) -> Column:
    return f.clamp(c.cast("double") / 5, 0, 1)


def calibration_curve(rows: DataFrame) -> DataFrame:
    """(student_id, conf, n, mean_conf, accuracy, gap) by level of confidence, 1 to 5, to six places. Rows without a
    confidence are left out."""
    p = confidence(F.col("self_conf"))
    c = rows.where("self_conf is not null").groupBy("student_id", F.greatest(F.least("self_conf", F.lit(5)), F.lit(1)).cast("int").alias("conf"))
    c = c.agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("m"), F.avg("y").alias("a"))
    return c.select("student_id", "conf", "n", f.half_even(F.col("m")).alias("mean_conf"), f.half_even(F.col("a")).alias("accuracy"), f.half_even(F.col("m") - F.col("a")).alias("gap"))


def calibration(rows: DataFrame) -> DataFrame:
    """(student_id, brier, bias, ece)."""
    p = confidence(F.col("self_conf"))
    b = rows.where("self_conf is not null").groupBy("student_id").agg(F.avg((p - F.col("y")) * (p - F.col("y"))).alias("brier"), (F.avg(p) - F.avg("y")).alias("bias"))
    e = calibration_curve(rows).groupBy("student_id").agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))
    # a student without any confidence has the prior
    return rows.select("student_id").distinct().join(b, "student_id", "left").join(e, "student_id", "left").select("student_id", F.coalesce("brier", f.lit(0.25)).alias("brier"), F.coalesce("bias", f.lit(0)).alias("bias"), F.coalesce("ece", f.lit(0)).alias("ece"))


def behaviour(rows: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """One row per student: n, weighted accuracy, confidence and hint rate (weights halve every half_life days), medians
    of latency as it is and by difficulty, flips of right and wrong as they are and against chance, pace, persistence,
    share of repeats, and the wrong answers at the end. Missing latencies, hints and confidences count nowhere."""
    w = f.decayed(_age(F.col("occurred_at"), as_of), half_life)
    mean = lambda x: F.sum(F.when(x.isNotNull(), w * x)) / F.sum(F.when(x.isNotNull(), w))
    adjusted = F.col("latency_ms") / (f.lit(1) + f.lit(0.25) * (f.clamp(F.coalesce("difficulty", F.lit(1)), 1, 5) - 1))
    r = placed(rows)
    b = r.groupBy("student_id").agg(
        F.max("n").alias("n"), mean(F.col("y")).alias("accuracy"), mean(confidence(F.col("self_conf"))).alias("mean_conf"), mean(F.least("hints_used", F.lit(3)) / f.lit(3)).alias("hint_rate"),
        F.percentile("latency_ms", f.lit(0.5)).alias("median_latency"), F.percentile(adjusted, f.lit(0.5)).alias("median_adjusted"),
        F.count_if(F.col("prev_y") != F.col("y")).alias("flips"), (F.max("n") - F.coalesce(F.max(F.when(F.col("y") == 1, F.col("place"))), F.lit(0))).alias("streak_wrong"),
        F.avg(F.col("difficulty").cast("double")).alias("difficulty"),
    )
    # knowledge points of a student, counted after they are made unique
    b = b.join(rows.select("student_id", "kp_id").distinct().groupBy("student_id").agg(F.count(F.lit(1)).alias("kps")), "student_id")
    vol = F.when(F.col("n") > 1, F.col("flips") / (F.col("n") - 1)).otherwise(f.lit(0))
    chance = F.greatest(f.lit(2) * F.col("accuracy") * (f.lit(1) - F.col("accuracy")), f.lit(0.05))
    return b.select(
        "student_id", "n", "accuracy", "mean_conf", "hint_rate", "median_latency", vol.alias("volatility"), F.exp(-F.col("median_latency") / 20000).alias("pace"), (F.col("n") / F.col("kps")).alias("persistence"),
        F.when(F.col("n") > 1, vol / chance).otherwise(f.lit(0)).alias("excess_volatility"), F.when(F.col("n") > 1, (F.col("n") - F.col("kps")) / F.col("n")).otherwise(f.lit(0)).alias("repeat_rate"),
        F.exp(-F.col("median_adjusted") / 20000).alias("pace_adjusted"), "streak_wrong", "difficulty",
    )


def style(behaved: DataFrame, calibrated: DataFrame) -> DataFrame:
    """(student_id, accuracy_first, calibrated, steady, independent, deep), each within [0, 1]."""
    s = behaved.join(calibrated, "student_id")
    c = F.col
    one = lambda x: f.half_even(f.clamp(x, 0, 1))
    return s.select(
        "student_id", one(f.lit(0.55) * c("accuracy") + f.lit(0.45) * F.coalesce("pace_adjusted", f.lit(0.5))).alias("accuracy_first"), one(f.lit(1) - F.least(c("brier") / f.lit(0.5), f.lit(1))).alias("calibrated"),
        one(f.lit(1) - F.least("excess_volatility", f.lit(1))).alias("steady"), one(f.lit(1) - F.coalesce("hint_rate", f.lit(0))).alias("independent"),
        one(f.lit(0.5) * f.clamp(F.coalesce("difficulty", f.lit(2.5)) / 5, 0, 1) + f.lit(0.5) * F.least(c("repeat_rate") / f.lit(0.6), f.lit(1))).alias("deep"),
    )


def _age(at: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at)).cast("double") / f.lit(86_400_000_000)


def topics(rows: DataFrame, mastery: DataFrame, as_of: str, half_life: float = 14.0) -> DataFrame:
    """(student_id, kp_id, mastery, interest, difficulty, weight): the share of a student's decayed attempts, the mean
    difficulty of these, and gap x interest x nearness to the target difficulty. Mastery (0 to 1) is 0.5 if unknown."""
    w = f.decayed(_age(F.col("occurred_at"), as_of), half_life)
    k = rows.groupBy("student_id", "kp_id").agg(F.sum(w).alias("w"), F.sum(w * f.clamp(F.coalesce("difficulty", F.lit(1)), 1, 5)).alias("dw"))
    k = k.join(k.groupBy("student_id").agg(F.sum("w").alias("all")), "student_id").join(mastery.select("student_id", "kp_id", (F.col("score") / 100).alias("m")), ["student_id", "kp_id"], "left")
    interest, hard, m = F.col("w") / F.col("all"), f.clamp(F.col("dw") / F.col("w") / 5, 0, 1), f.clamp(F.coalesce("m", f.lit(0.5)), 0, 1)
    return k.select("student_id", "kp_id", m.alias("mastery"), interest.alias("interest"), hard.alias("difficulty"), f.topic_weight(m, interest, hard).alias("weight"))


def features(rows: DataFrame, total_kps: int, as_of: str, least: int = 10) -> DataFrame:
    """(student_id, n, accuracy, trend, avg_conf, avg_latency, hint_rate, coverage, days_since): accuracy and the trend (second
    half less first half) are null for fewer than `least` attempts."""
    r = placed(rows)
    first = F.col("place") <= F.floor(F.col("n") / 2)
    b = r.groupBy("student_id").agg(
        F.max("n").alias("n"), F.avg("y").alias("acc"), F.avg(F.when(~first, F.col("y"))).alias("late"), F.avg(F.when(first, F.col("y"))).alias("early"), F.avg(F.col("self_conf").cast("double")).alias("avg_conf"),
        F.avg(F.col("latency_ms").cast("double")).alias("avg_latency"), F.avg(F.when(F.col("hints_used") > 0, f.lit(1)).otherwise(f.lit(0))).alias("hint_rate"), F.max("occurred_at").alias("last_at"),
    )
    kps = rows.select("student_id", "kp_id").distinct().groupBy("student_id").agg(F.count(F.lit(1)).alias("kps"))
    enough = F.col("n") >= least
    return b.join(kps, "student_id").select(
        "student_id", "n", F.when(enough, F.col("acc")).alias("accuracy"), F.when(enough, F.col("late") - F.col("early")).alias("trend"), "avg_conf", "avg_latency", "hint_rate",
        (F.col("kps") / f.lit(max(1, total_kps))).alias("coverage"), F.floor(_age(F.col("last_at"), as_of)).cast("int").alias("days_since"),
    )


def timeline(rows: DataFrame) -> DataFrame:
    """(student_id, day, n, right, avg_conf): day as days since 1970."""
    return rows.groupBy("student_id", day_of(F.col("occurred_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("right"), F.avg(F.col("self_conf").cast("double")).alias("avg_conf"))


def velocity(days: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(student_id, smoothed, slope, trend) of the daily share of right answers, times 100: an exponential mean, which
    starts from the first day's value and applies it again, and the least-squares slope a day, 0 for a single day."""
    d = days.withColumn("score", f.lit(100) * F.col("right") / F.col("n"))
    by = Window.partitionBy("student_id").orderBy("day")
    d = d.withColumn("i", F.row_number().over(by)).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("student_id")))
    left = F.pow(f.lit(1 - alpha), (F.col("k") - F.col("i")).cast("double"))
    share = F.when(F.col("i") == 1, f.lit(alpha) * left + F.pow(f.lit(1 - alpha), F.col("k").cast("double"))).otherwise(f.lit(alpha) * left)
    v = d.groupBy("student_id").agg(F.sum(share * F.col("score")).alias("smoothed"), F.coalesce(F.regr_slope("score", F.col("day").cast("double")), f.lit(0)).alias("slope"))
    return v.withColumn("trend", F.when(F.col("slope") > 0.5, "up").when(F.col("slope") < -0.5, "down").otherwise("flat"))


def cohort_quantiles(scores: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, suppressed, p25, p50, p75) of (group, score), exact, linear between values; null under max(2, k)."""
    n = F.count("score")
    ok = n >= max(2, k)
    q = F.percentile("score", F.array(f.lit(0.25), f.lit(0.5), f.lit(0.75)))
    g = scores.groupBy(group).agg(n.alias("n"), (~ok).alias("suppressed"), F.when(ok, q).alias("q"))
    return g.select(group, "n", "suppressed", *[f.half_even(F.col("q")[i]).alias(p) for i, p in enumerate(("p25", "p50", "p75"))])


def exam_plan(debts: DataFrame, days: int = 5, minutes: int = 35) -> DataFrame:
    """(student_id, from_kp, to_kp, priority, minutes, gain): each link's share of the minutes until the exam by its impact
    x weight x urgency; gain is the student's sum of impacts, less if there are under 300 minutes."""
    urgency = 1.5 if days <= 3 else 1.2 if days <= 7 else 1.0
    total = min(max(minutes, 5), 120, 35) * max(days, 1)
    p = debts.withColumn("priority", f.half_even(F.col("impact") * f.clamp(F.col("weight"), 0, 2) * f.lit(urgency)))
    s = p.groupBy("student_id").agg(F.sum("priority").alias("all"), F.sum("impact").alias("impacts"))
    j = p.join(s, "student_id")
    share = F.when(F.col("all") > 0, F.col("priority") / F.col("all")).otherwise(f.lit(0))
    return j.select("student_id", "from_kp", "to_kp", "priority", F.floor(f.lit(total) * share).cast("int").alias("minutes"), f.half_even(F.col("impacts") * f.lit(min(1.0, total / 300))).alias("gain"))


def anonymous_tags(tags: DataFrame, k: int = 5, banned: tuple[str, ...] = ("sensitive", "crisis", "semantic")) -> DataFrame:
    """(tag, students, visible): tags of allowed domains; visible if at least k students have them."""
    t = tags.where(~F.col("domain").isin(*banned)).select("tag", "student_id").distinct()
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("students")).withColumn("visible", F.col("students") >= k)


def agreement(cases: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(cases, passed, max_delta, ok) of (expected, actual): a trial of a candidate formula."""
    delta = F.abs(F.col("expected") - F.col("actual"))
    a = cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if(delta <= tolerance).alias("passed"), F.round(F.coalesce(F.max(delta), f.lit(0)), 9).alias("max_delta"))
    return a.withColumn("ok", F.col("cases") == F.col("passed"))


def radar(feature_rows: DataFrame, mastery: DataFrame, debts: DataFrame) -> DataFrame:
    """(student_id, axis, value): percents within [0, 100], to two places."""
    m = mastery.groupBy("student_id").agg(F.avg("score").alias("score"))
    d = debts.groupBy("student_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("impact") > 0).alias("open"))
    j = feature_rows.join(m, "student_id").join(d, "student_id", "left")
    axes = {
        "mastery": F.col("score") / 100, "accuracy": F.col("acc"), "volume": F.least(F.col("n") / f.lit(40), f.lit(1)), "repaid": f.lit(1) - F.coalesce(F.col("open") / F.col("links"), f.lit(0)),
        "confidence": F.coalesce(F.col("avg_conf") / 5, f.lit(0)), "coverage": F.col("coverage"),
    }
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.round(f.clamp(v, 0, 1) * 100, 2).alias("value")) for a, v in axes.items()]))
    return j.select("student_id", both.alias("x")).select("student_id", "x.axis", "x.value")
