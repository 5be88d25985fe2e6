"""Queries of learners' profiles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import profiles as p
from loomgraph.queries.learning import AS_OF, GRADED, LINKS, _debts, _graded, _mastery, r6
from loomgraph.queries.registry import Registry
from loomgraph.runtime import table

R = Registry()
CONF = "least(1, greatest(0, self_conf::DOUBLE / 5))"
PLACED = f"""{GRADED}, pl AS (SELECT *, row_number() OVER w AS place, lag(y) OVER w AS prev_y, count(*) OVER (PARTITION BY student_id) AS n FROM a WINDOW w AS (PARTITION BY student_id ORDER BY occurred_at, attempt_id)),
  k AS (SELECT student_id, count(DISTINCT kp_id) AS kps FROM a GROUP BY 1)"""
CURVE = f"""curve AS (SELECT student_id, least(5, greatest(1, self_conf))::INT AS conf, count(*) AS n, round_even(avg({CONF}), 6) AS mean_conf, round_even(avg(y), 6) AS accuracy, round_even(avg({CONF}) - avg(y), 6) + 0.0 AS gap FROM a WHERE self_conf IS NOT NULL GROUP BY 1, 2)"""
CALIB = f"""{CURVE}, cal AS (SELECT s.student_id, coalesce(brier, 0.25) AS brier, coalesce(bias, 0) AS bias, coalesce(ece, 0) AS ece FROM (SELECT DISTINCT student_id FROM a) s
  LEFT JOIN (SELECT student_id, avg(({CONF} - y) * ({CONF} - y)) AS brier, avg({CONF}) - avg(y) AS bias FROM a WHERE self_conf IS NOT NULL GROUP BY 1) b ON b.student_id = s.student_id
  LEFT JOIN (SELECT student_id, sum(n * abs(gap)) / sum(n) AS ece FROM curve GROUP BY 1) e ON e.student_id = s.student_id)"""
AGE = f"((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us({{}})) / 86400000000.0::DOUBLE)"
W30 = f"exp(-ln(2) / 30 * greatest({AGE.format('occurred_at')}, 0))"
BEHAVIOUR = f"""{PLACED}, b AS (SELECT student_id, max(n) AS n, sum({W30} * y) / sum({W30}) AS accuracy, sum({W30} * {CONF}) FILTER (self_conf IS NOT NULL) / sum({W30}) FILTER (self_conf IS NOT NULL) AS mean_conf,
    sum({W30} * least(hints_used, 3) / 3) FILTER (hints_used IS NOT NULL) / sum({W30}) FILTER (hints_used IS NOT NULL) AS hint_rate, quantile_cont(latency_ms::DOUBLE, 0.5) AS med,
    quantile_cont(latency_ms / (1 + 0.25::DOUBLE * (least(5, greatest(1, coalesce(difficulty, 1))) - 1)), 0.5) AS meda, count(*) FILTER (prev_y <> y) AS flips, max(n) - coalesce(max(CASE WHEN y = 1 THEN place END), 0) AS streak_wrong,
    avg(difficulty::DOUBLE) AS difficulty FROM pl GROUP BY 1),
  bh AS (SELECT b.student_id, n, accuracy, mean_conf, hint_rate, med AS median_latency, CASE WHEN n > 1 THEN flips::DOUBLE / (n - 1) ELSE 0 END AS volatility, exp(-med / 20000) AS pace, n::DOUBLE / kps AS persistence,
    CASE WHEN n > 1 THEN flips::DOUBLE / (n - 1) / greatest(2 * accuracy * (1 - accuracy), 0.05) ELSE 0 END AS excess_volatility, CASE WHEN n > 1 THEN (n - kps)::DOUBLE / n ELSE 0 END AS repeat_rate, exp(-meda / 20000) AS pace_adjusted, streak_wrong, difficulty
    FROM b JOIN k ON k.student_id = b.student_id)"""
NUMBERS = ["accuracy", "mean_conf", "hint_rate", "median_latency", "volatility", "pace", "persistence", "excess_volatility", "repeat_rate", "pace_adjusted"]


def _rounded(names):
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


@R.add("calibration_curve", f"{GRADED}, {CURVE} SELECT * FROM curve")
def calibration_curve(spark, d):
    return p.calibration_curve(_graded(spark, d))


@R.add("calibration", f"{GRADED}, {CALIB} SELECT student_id, round(brier, 9) AS brier, round(bias, 9) AS bias, round(ece, 9) AS ece FROM cal")
def calibration(spark, d):
    return p.calibration(_graded(spark, d)).select("student_id", *[F.round(c, 9).alias(c) for c in ("brier", "bias", "ece")])


@R.add("behaviour", f"{BEHAVIOUR} SELECT student_id, n, {_rounded(NUMBERS)}, streak_wrong FROM bh")
def behaviour(spark, d):
    return p.behaviour(_graded(spark, d), AS_OF).select("student_id", "n", *[r6(F.col(c)).alias(c) for c in NUMBERS], F.col("streak_wrong").cast("bigint").alias("streak_wrong"))


@R.add(
    "style",
    f"""{BEHAVIOUR}, {CALIB} SELECT bh.student_id, round_even(least(1, 0.55 * accuracy + 0.45 * coalesce(pace_adjusted, 0.5)), 6) AS accuracy_first, round_even(1 - least(brier / 0.5, 1), 6) AS calibrated, round_even(1 - least(excess_volatility, 1), 6) AS steady,
    round_even(1 - coalesce(hint_rate, 0), 6) AS independent, round_even(0.5 * least(1, coalesce(difficulty, 2.5) / 5) + 0.5 * least(repeat_rate / 0.6, 1), 6) AS deep FROM bh JOIN cal ON cal.student_id = bh.student_id""",
)
def style(spark, d):
    a = _graded(spark, d)
    return p.style(p.behaviour(a, AS_OF), p.calibration(a))


@R.add(
    "topics",
    f"""{LINKS}, w AS (SELECT student_id, kp_id, sum(exp(-ln(2) / 14 * greatest({AGE.format('occurred_at')}, 0))) AS w, sum(exp(-ln(2) / 14 * greatest({AGE.format('occurred_at')}, 0)) * least(5, greatest(1, coalesce(difficulty, 1)))) AS dw FROM a GROUP BY 1, 2),
    t AS (SELECT w.student_id, w.kp_id, least(1, greatest(0, m.score / 100)) AS mastery, w / sum(w) OVER (PARTITION BY w.student_id) AS interest, least(1, dw / w / 5) AS difficulty FROM w JOIN m ON m.student_id = w.student_id AND m.kp_id = w.kp_id)
    SELECT student_id, kp_id, {_rounded(['mastery', 'interest', 'difficulty'])}, round((1 - mastery) * (0.4 + 0.6 * least(interest * 2, 1)) * (0.35 + 0.65 * (1 - least(1, abs(difficulty - 0.55) / 0.45))), 6) AS weight FROM t""",
)
def topics(spark, d):
    t = p.topics(_graded(spark, d), _mastery(spark, d), AS_OF)
    return t.select("student_id", "kp_id", *[r6(F.col(c)).alias(c) for c in ("mastery", "interest", "difficulty", "weight")])


FEATURES = f"""{PLACED}, ft AS (SELECT pl.student_id, max(n) AS n, avg(y) AS acc, avg(y) FILTER (place > n // 2) - avg(y) FILTER (place <= n // 2) AS trend, avg(self_conf::DOUBLE) AS avg_conf, avg(latency_ms::DOUBLE) AS avg_latency,
    avg(CASE WHEN hints_used > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hint_rate, max(kps) / 400.0::DOUBLE AS coverage, floor({AGE.format('max(occurred_at)')})::INT AS days_since FROM pl JOIN k ON k.student_id = pl.student_id GROUP BY 1)"""


@R.add("profile_features", f"""{FEATURES} SELECT student_id, n, round(CASE WHEN n >= 10 THEN acc END, 6) AS accuracy, round(CASE WHEN n >= 10 THEN trend END, 6) AS trend, {_rounded(['avg_conf', 'avg_latency', 'hint_rate', 'coverage'])}, days_since FROM ft""")
def profile_features(spark, d):
    t = p.features(_graded(spark, d), 400, AS_OF)
    return t.select("student_id", "n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "trend", "avg_conf", "avg_latency", "hint_rate", "coverage")], "days_since")


@R.add(
    "profile_radar",
    f"""{LINKS}, f AS (SELECT student_id, count(*) AS n, avg(y) AS acc, avg(self_conf::DOUBLE) AS conf, count(DISTINCT kp_id) / 400.0::DOUBLE AS coverage FROM a GROUP BY 1), ms AS (SELECT student_id, avg(score) AS score FROM m GROUP BY 1),
    dd AS (SELECT student_id, count(*) AS links, count(*) FILTER (impact > 0) AS op FROM d GROUP BY 1), rj AS (SELECT f.*, score, coalesce(op::DOUBLE / links, 0) AS open FROM f JOIN ms ON ms.student_id = f.student_id LEFT JOIN dd ON dd.student_id = f.student_id),
    u AS (SELECT student_id, unnest([{{'axis': 'mastery', 'v': score / 100}}, {{'axis': 'accuracy', 'v': acc}}, {{'axis': 'volume', 'v': least(n / 40.0::DOUBLE, 1)}}, {{'axis': 'repaid', 'v': 1 - open}}, {{'axis': 'confidence', 'v': coalesce(conf / 5, 0)}}, {{'axis': 'coverage', 'v': coverage}}]) AS x FROM rj)
    SELECT student_id, x.axis AS axis, round(least(1, greatest(0, x.v)) * 100, 2) AS value FROM u""",
)
def profile_radar(spark, d):
    a = _graded(spark, d)
    t = p.features(a, 400, AS_OF, least=1).withColumnRenamed("accuracy", "acc")
    return p.radar(t, _mastery(spark, d), _debts(spark, d))


@R.add("timeline", f"{GRADED} SELECT student_id, floor(epoch_us(occurred_at) / 86400000000.0::DOUBLE)::INT AS day, count(*) AS n, sum(y)::BIGINT AS \"right\", round(avg(self_conf::DOUBLE), 6) AS avg_conf FROM a GROUP BY 1, 2")
def timeline(spark, d):
    return p.timeline(_graded(spark, d)).withColumn("avg_conf", r6(F.col("avg_conf")))


@R.add(
    "velocity",
    f"""{GRADED}, t AS (SELECT student_id, floor(epoch_us(occurred_at) / 86400000000.0::DOUBLE)::INT AS day, 100.0::DOUBLE * sum(y) / count(*) AS score FROM a GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY day) AS i, count(*) OVER (PARTITION BY student_id) AS k FROM t),
    v AS (SELECT student_id, sum(score * (0.3 * pow(0.7, k - i) + CASE WHEN i = 1 THEN pow(0.7, k) ELSE 0 END)) AS smoothed, coalesce(CASE WHEN count(*) > 1 THEN regr_slope(score, day::DOUBLE) END, 0) AS slope FROM i GROUP BY 1)
    SELECT student_id, {_rounded(['smoothed', 'slope'])}, CASE WHEN slope > 0.5 THEN 'up' WHEN slope < -0.5 THEN 'down' ELSE 'flat' END AS trend FROM v""",
)
def velocity(spark, d):
    return p.velocity(p.timeline(_graded(spark, d))).select("student_id", r6(F.col("smoothed")).alias("smoothed"), r6(F.col("slope")).alias("slope"), "trend")


@R.add(
    "cohort_quantiles",
    f"""{LINKS}, c AS (SELECT kp_id, min(course) AS course FROM course_kps GROUP BY 1), s AS (SELECT student_id, course, avg(score) AS score FROM m JOIN c ON c.kp_id = m.kp_id GROUP BY 1, 2)
    SELECT course, count(score) AS n, count(score) < 5 AS suppressed, round_even(CASE WHEN count(score) >= 5 THEN quantile_cont(score, 0.25) END, 6) AS p25, round_even(CASE WHEN count(score) >= 5 THEN quantile_cont(score, 0.5) END, 6) AS p50, round_even(CASE WHEN count(score) >= 5 THEN quantile_cont(score, 0.75) END, 6) AS p75 FROM s GROUP BY 1""",
)
def cohort_quantiles(spark, d):
    c = table(spark, d, "course_kps").groupBy("kp_id").agg(F.min("course").alias("course"))
    s = _mastery(spark, d).join(c, "kp_id").groupBy("student_id", "course").agg(F.avg("score").alias("score"))
    return p.cohort_quantiles(s, "course")


@R.add(
    "exam_plan",
    f"""{LINKS}, o AS (SELECT *, round_even(impact * least(2, greatest(0, weight)) * 1.2::DOUBLE, 6) AS priority FROM d WHERE impact > 0), s AS (SELECT *, sum(priority) OVER (PARTITION BY student_id) AS al, sum(impact) OVER (PARTITION BY student_id) AS im FROM o)
    SELECT student_id, from_kp, to_kp, round(priority, 5) AS priority, floor(175.0::DOUBLE * CASE WHEN al > 0 THEN priority / al ELSE 0 END + 1e-9)::INT AS minutes, round(im * 175 / 300.0, 5) AS gain FROM s""",
)
def exam_plan(spark, d):
    e = p.exam_plan(_debts(spark, d).where("impact > 0"))
    return e.select("student_id", "from_kp", "to_kp", F.round("priority", 5).alias("priority"), "minutes", F.round("gain", 5).alias("gain"))


@R.add("anonymous_tags", "SELECT tag, count(DISTINCT owner_user_id) AS students, count(DISTINCT owner_user_id) >= 5 AS visible FROM (SELECT owner_user_id, unnest(tags) AS tag FROM kb_documents WHERE owner_user_id IS NOT NULL) WHERE tag IS NOT NULL GROUP BY 1")
def anonymous_tags(spark, d):
    t = table(spark, d, "kb_documents").select(F.col("owner_user_id").alias("student_id"), F.explode("tags").alias("tag"), F.lit("course").alias("domain")).where("student_id is not null and tag is not null")
    return p.anonymous_tags(t)


@R.add("formula_trial", f"{LINKS} SELECT count(*) AS cases, count(*) FILTER (abs(x - y) <= 5) AS passed, round(max(abs(x - y)), 6) AS max_delta, count(*) = count(*) FILTER (abs(x - y) <= 5) AS ok FROM (SELECT score AS x, 100 * recent_acc AS y FROM m)")
def formula_trial(spark, d):
    m = _mastery(spark, d).select(F.col("score").alias("expected"), (F.col("recent_acc") * 100).alias("actual"))
    return p.agreement(m, 5.0).withColumn("max_delta", r6(F.col("max_delta")))
