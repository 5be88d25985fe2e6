"""Queries of formulas, mastery, weak links, profiles and time series over attempts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import formulas as f
from loomgraph.operators import learners, profiles
from loomgraph.queries.pipeline import FOLD, LATEST
from loomgraph.queries.registry import Registry
from loomgraph.runtime import table

R = Registry()

#: The moment that ages count to.
AS_OF = "2025-06-01 00:00:00"
GRADED = f"""WITH kps AS (SELECT {FOLD.format("kp_id")} AS k, min(kp_id) AS kp_id FROM course_kps WHERE kp_id IS NOT NULL GROUP BY 1),
  hard AS (SELECT kp_id, min(difficulty) AS difficulty FROM course_kps WHERE kp_id IS NOT NULL GROUP BY 1),
  latest AS (SELECT * FROM attempts QUALIFY attempt_id IS NULL OR row_number() OVER (PARTITION BY attempt_id
    ORDER BY created_at DESC NULLS LAST, occurred_at DESC NULLS LAST, student_id DESC NULLS LAST, correct DESC NULLS LAST, self_conf DESC NULLS LAST, latency_ms DESC NULLS LAST, hints_used DESC NULLS LAST) = 1),
  a AS (SELECT attempt_id, student_id, kps.kp_id, CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, self_conf, latency_ms, hints_used, occurred_at, difficulty
    FROM latest l JOIN kps ON {FOLD.format("l.kp_id")} = kps.k LEFT JOIN hard ON hard.kp_id = kps.kp_id WHERE student_id IS NOT NULL AND correct IS NOT NULL AND occurred_at IS NOT NULL)"""
INPUTS = f"""{GRADED}, inputs AS (SELECT student_id, kp_id, count(*) AS n, avg(y) AS recent_acc, avg(1 - y) AS sev, avg(self_conf::DOUBLE) AS self_conf, sum(1 - y)::BIGINT AS freq, max(occurred_at) AS last_at FROM a GROUP BY 1, 2),
  m AS (SELECT student_id, kp_id, n, last_at, recent_acc, freq, round(100 * (0.6::DOUBLE * recent_acc + 0.3::DOUBLE * (1 - least(sev, 1)) + 0.1::DOUBLE * coalesce(self_conf, 3) / 5), 6) AS score, self_conf FROM inputs)"""
LINKS = f"""{INPUTS}, links AS (SELECT from_kp, to_kp, max(weight) AS weight, max(CASE WHEN {FOLD.format("edge_type")} = 'transfer_gap' THEN 1 ELSE 0 END) AS gap FROM knowledge_edges
    WHERE {FOLD.format("edge_type")} IN ('prerequisite', 'transfer_gap') AND from_kp <> to_kp AND from_kp IN (SELECT kp_id FROM course_kps) AND to_kp IN (SELECT kp_id FROM course_kps) GROUP BY 1, 2),
  names AS (SELECT kp_id, min(kp_name) AS nm FROM course_kps WHERE kp_id IS NOT NULL GROUP BY 1),
  j AS (SELECT t.student_id, l.from_kp, l.to_kp, p.score AS score_from, t.score AS score_to, l.weight, l.gap, t.n AS n_to,
      CASE WHEN t.freq > 0 THEN t.freq WHEN t.recent_acc < 0.5 AND p.score < 40 THEN greatest(1, round_even((0.5::DOUBLE - t.recent_acc) * 12, 0)::INT) ELSE 0 END::BIGINT AS freq
    FROM m t JOIN links l ON l.to_kp = t.kp_id JOIN m p ON p.student_id = t.student_id AND p.kp_id = l.from_kp),
  d AS (SELECT *, CASE WHEN score_from < 40 AND score_to < 50 AND freq > 0 THEN freq::DOUBLE * (50 - score_to) * weight ELSE 0 END AS impact FROM j)"""


def _graded(spark, d):
    return learners.graded_attempts(table(spark, d, "attempts"), table(spark, d, "course_kps"))


def _mastery(spark, d):
    return learners.mastery_v1(learners.mastery_inputs(_graded(spark, d)))


def _links(spark, d):
    return learners.debt_graph(table(spark, d, "knowledge_edges"), table(spark, d, "course_kps"))


def _debts(spark, d):
    return learners.debts(_mastery(spark, d), _links(spark, d), table(spark, d, "course_kps"))


def r6(c):
    return F.round(c, 6)


@R.add("mastery_v1", f"{INPUTS} SELECT student_id, kp_id, n, epoch_us(last_at) AS last_us, score, CASE WHEN score >= 70 THEN 'green' WHEN score >= 40 THEN 'yellow' ELSE 'red' END AS band FROM m")
def mastery_v1(spark, d):
    return _mastery(spark, d).select("student_id", "kp_id", "n", F.unix_micros("last_at").alias("last_us"), "score", "band")


@R.add("debt_links", f"{LINKS} SELECT from_kp, to_kp, weight, gap FROM links")
def debt_links(spark, d):
    return _links(spark, d)


@R.add(
    "debts_top5",
    f"""{LINKS} SELECT student_id, from_kp, to_kp, coalesce(a.nm, from_kp) AS from_name, coalesce(b.nm, to_kp) AS to_name, score_from, score_to, freq, weight, round(impact, 6) AS impact, rank::INT AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY impact DESC, from_kp, to_kp) AS rank FROM d WHERE impact > 0) x
    LEFT JOIN names a ON a.kp_id = from_kp LEFT JOIN names b ON b.kp_id = to_kp WHERE rank <= 5""",
)
def debts_top5(spark, d):
    return learners.top_debts(_debts(spark, d)).withColumn("impact", r6(F.col("impact")))


@R.add(
    "debt_hotspots",
    f"""{LINKS}, h AS (SELECT from_kp, to_kp, count(DISTINCT student_id) AS students, round(avg(impact), 6) AS avg_impact, round(sum(impact), 6) AS sum_impact FROM d WHERE impact > 0 GROUP BY 1, 2)
    SELECT h.*, (SELECT count(*) > 5 AND min(students) < 3 FROM h) AS suppressed FROM h""",
)
def debt_hotspots(spark, d):
    return learners.hotspots(_debts(spark, d))


@R.add(
    "mastery_v2",
    f"""{LINKS}, pre AS (SELECT p.student_id, l.to_kp AS kp_id, count(*) AS n_prereq, avg(p.score / 100) AS mean_p, min(p.score / 100) AS min_p FROM m p JOIN links l ON l.from_kp = p.kp_id GROUP BY 1, 2),
    s AS (SELECT student_id, kp_id, count(*) AS n, sum(y) AS ok, count(*) - coalesce(max(CASE WHEN y = 0 THEN i END), 0) AS streak, max(occurred_at) AS last_at, avg(self_conf::DOUBLE) AS conf
      FROM (SELECT *, row_number() OVER (PARTITION BY student_id, kp_id ORDER BY occurred_at, attempt_id) AS i FROM a) GROUP BY 1, 2),
    v AS (SELECT s.student_id, s.kp_id, n, streak, coalesce(n_prereq, 0) AS n_prereq, (ok + 0.5) / (n + 1) AS emp, 2.5 * (1 + 0.45 * streak) * (1 + 0.25 * ln(1 + greatest(n, 1))) AS stable,
      greatest(epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(last_at), 0) / 86400000000.0::DOUBLE AS age, coalesce(conf, 3) AS conf, coalesce(0.35 * mean_p + 0.65 * min_p, 0.5) AS sup, coalesce(0.55 + 0.45 * min_p, 1) AS ceil
      FROM s LEFT JOIN pre ON pre.student_id = s.student_id AND pre.kp_id = s.kp_id)
    SELECT student_id, kp_id, n, streak, n_prereq, round(emp, 6) AS empirical, round(stable, 6) AS stability, round(exp(-age / stable), 6) AS retention, round(sup, 6) AS support, round(ceil, 6) AS ceiling,
      round(greatest(0, least(1, least(0.5 * (0.85 * emp + 0.15 * conf / 5) + 0.3 * exp(-age / stable) + 0.2 * sup, ceil))), 6) AS score, round(0.75 + 0.25 * exp(-ln(2) * age / 21), 6) AS freshness FROM v""",
)
def mastery_v2(spark, d):
    a = _graded(spark, d)
    run = learners.trailing_run(a, ["student_id", "kp_id"], ["occurred_at", "attempt_id"], F.col("y") == 1, "streak")
    s = a.groupBy("student_id", "kp_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ok"), F.max("occurred_at").alias("last_at"), F.coalesce(F.avg(F.col("self_conf").cast("double")), f.lit(3)).alias("conf"))
    pre = learners.prerequisites(_mastery(spark, d), _links(spark, d))
    v = s.join(run, ["student_id", "kp_id"]).join(pre, ["student_id", "kp_id"], "left")
    age = F.greatest(learners.days_between(F.col("last_at"), F.lit(AS_OF).cast("timestamp")), f.lit(0))
    emp, stable = f.empirical(F.col("ok"), F.col("n")), f.stability(F.col("streak"), F.col("n"))
    sup, ceil = f.support(F.col("mean_prereq"), F.col("min_prereq")), f.ceiling(F.col("min_prereq"))
    return v.select(
        "student_id", "kp_id", "n", "streak", F.coalesce("n_prereq", F.lit(0)).alias("n_prereq"), r6(emp).alias("empirical"), r6(stable).alias("stability"), r6(f.retention(age, stable)).alias("retention"),
        r6(sup).alias("support"), r6(ceil).alias("ceiling"), r6(f.score_v2(emp, F.col("conf"), f.retention(age, stable), sup, ceil)).alias("score"), r6(f.freshness(age)).alias("freshness"),
    )


@R.add(
    "impact_v2",
    f"""{LINKS}, down AS (SELECT from_kp, count(*) AS n FROM links GROUP BY 1),
    v AS (SELECT student_id, j.from_kp, to_kp, freq, CASE WHEN freq > 0 THEN 0.55 / (1 + exp(-8 * (score_from / 100 - 0.55))) / (1 + exp(-8 * (0.5 - score_to / 100))) * greatest(weight, 0) * CASE WHEN gap = 1 THEN 1.15 ELSE 1 END
      * (1 + 0.12 * ln(1 + coalesce(down.n, 0))) * (1 + 0.08 * ln(1 + freq)) ELSE 0 END AS impact FROM j LEFT JOIN down ON down.from_kp = j.to_kp)
    SELECT student_id, from_kp, to_kp, round(impact, 6) AS impact, freq > 0 AND impact >= 0.08 AS hit FROM v""",
)
def impact_v2(spark, d):
    links = _links(spark, d)
    j = learners.debts(_mastery(spark, d), links, table(spark, d, "course_kps")).select("student_id", "from_kp", "to_kp", "score_from", "score_to", "freq")
    down = links.groupBy(F.col("from_kp").alias("to_kp")).agg(F.count(F.lit(1)).alias("down"))
    j = j.join(links, ["from_kp", "to_kp"]).join(down, "to_kp", "left")
    v = f.impact_v2(F.col("score_from") / 100, F.col("score_to") / 100, F.col("weight"), F.col("gap") == 1, F.col("freq"), F.coalesce("down", F.lit(0)))
    return j.select("student_id", "from_kp", "to_kp", r6(v).alias("impact"), f.is_hit(F.col("freq"), v).alias("hit"))


IMPORT_SQL = """r AS (SELECT a.pack_id AS batch_id, a.kp_id, b.difficulty, row_number() OVER (PARTITION BY a.pack_id ORDER BY a.kp_id) AS row_no FROM (SELECT DISTINCT pack_id, kp_id FROM knowledge_nodes WHERE pack_id IS NOT NULL) a
    LEFT JOIN (SELECT kp_id, min(difficulty) AS difficulty FROM course_kps GROUP BY 1) b ON b.kp_id = a.kp_id),
  x AS (SELECT batch_id, row_no, kp_id, row_no / 30.0::DOUBLE AS recent_acc, difficulty / 4.0::DOUBLE AS sev, row_no % 12 / 2.0::DOUBLE AS self_conf FROM r),
  c AS (SELECT *, list_filter([CASE WHEN kp_id IS NULL OR trim(kp_id) = '' THEN 'MISSING_FIELD:kpId' END, CASE WHEN kp_id IS NOT NULL AND trim(kp_id) <> '' AND kp_id NOT IN (SELECT kp_id FROM course_kps WHERE kp_id IS NOT NULL) THEN 'UNKNOWN_KP:kpId' END,
    CASE WHEN recent_acc < 0 OR recent_acc > 1 THEN 'OUT_OF_RANGE:recentAcc' END, CASE WHEN sev < 0 OR sev > 1 THEN 'OUT_OF_RANGE:sev' END, CASE WHEN self_conf < 1 OR self_conf > 5 OR self_conf <> floor(self_conf) THEN 'OUT_OF_RANGE:selfConf' END,
    CASE WHEN count(*) OVER (PARTITION BY batch_id) > 400 THEN 'OUT_OF_RANGE:rows' END], lambda z: z IS NOT NULL) AS issues FROM x)"""


def _imports(spark, d):
    from pyspark.sql import Window

    hard = table(spark, d, "course_kps").groupBy("kp_id").agg(F.min("difficulty").alias("difficulty"))
    r = table(spark, d, "knowledge_nodes").select("pack_id", "kp_id").where("pack_id is not null").distinct().join(hard, "kp_id", "left")
    r = r.withColumn("row_no", F.row_number().over(Window.partitionBy("pack_id").orderBy(F.col("kp_id").asc_nulls_last())))
    return r.select(F.col("pack_id").alias("batch_id"), "row_no", "kp_id", (F.col("row_no") / 30).alias("recent_acc"), (F.col("difficulty") / 4).alias("sev"), (F.col("row_no") % 12 / 2).alias("self_conf"))


@R.add("import_issues", f"WITH {IMPORT_SQL} SELECT batch_id, row_no, array_to_string(issues, ';') AS issues FROM c")
def import_issues(spark, d):
    c = learners.import_issues(_imports(spark, d), table(spark, d, "course_kps"))
    return c.select("batch_id", F.col("row_no").cast("bigint").alias("row_no"), F.array_join("issues", ";").alias("issues"))


@R.add("import_report", f"WITH {IMPORT_SQL}, g AS (SELECT batch_id, len(list_filter(issues, lambda z: z <> 'OUT_OF_RANGE:rows')) > 0 AS bad FROM c) SELECT batch_id, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, count(*) FILTER (NOT bad) = 0 AS all_rejected FROM g GROUP BY 1")
def import_report(spark, d):
    return learners.import_report(learners.import_issues(_imports(spark, d), table(spark, d, "course_kps")))


@R.add(
    "attempt_fold",
    f"""{GRADED.replace("WITH kps", "WITH RECURSIVE kps")}, s AS (SELECT student_id, kp_id, y, row_number() OVER (PARTITION BY student_id, kp_id ORDER BY occurred_at, attempt_id) AS i, count(*) OVER (PARTITION BY student_id, kp_id) AS n FROM a),
    w AS (SELECT student_id, kp_id, i, n, CASE WHEN y = 1 THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS acc, CASE WHEN y = 1 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS sev, CASE WHEN y = 1 THEN 1 ELSE 0 END AS streak FROM s WHERE i = 1
      UNION ALL SELECT s.student_id, s.kp_id, s.i, s.n, (9 * w.acc + s.y) / 10, least(1, w.sev * CASE WHEN s.y = 1 THEN 0.9::DOUBLE ELSE 1.05::DOUBLE END), CASE WHEN s.y = 1 THEN w.streak + 1 ELSE 0 END
      FROM w JOIN s ON s.student_id = w.student_id AND s.kp_id = w.kp_id AND s.i = w.i + 1)
    SELECT student_id, kp_id, round(acc, 6) AS acc, round(sev, 6) AS sev, streak::BIGINT AS streak, n FROM w WHERE i = n""",
)
def attempt_fold(spark, d):
    return learners.attempt_fold(_graded(spark, d)).select("student_id", "kp_id", r6(F.col("acc")).alias("acc"), r6(F.col("sev")).alias("sev"), F.col("streak").cast("bigint").alias("streak"), F.col("n").cast("bigint").alias("n"))


@R.add(
    "scalar_formulas",
    f"""{LINKS}, t AS (SELECT student_id, round(sum(impact), 6) AS total, count(*) AS k FROM d GROUP BY 1), sc AS (SELECT student_id, avg(score) AS score, max(n) AS n, sum(freq) AS freq, min(score) AS low FROM m GROUP BY 1),
    z AS (SELECT sc.student_id, score, n, freq, low, total, k FROM sc JOIN t ON t.student_id = sc.student_id)
    SELECT student_id, round_even(10 * score / 100, 0)::INT AS evidence_right, round(1 + 4 * score / 100, 6) AS evidence_conf, round(1 / (1 + exp(-(score - 50) / 10)), 6) AS squashed,
      round(pow(1 - score / 100, 1.2) * (total / 100 + 0.05) * exp(-4 * pow(0.6 - least(1, score / 100 + 0.15), 2)) * (1 + n / 14.0), 6) AS priority,
      round(least(100, greatest(0, score + 0.4 * 10)), 6) AS expected, round(greatest(0, least(100, greatest(0, score + 0.4 * 10)) - least(30, greatest(5, 5 + 4 + total / 40))), 6) AS lower_bound,
      ([1, 2, 4, 7, 15])[(greatest(0, CASE WHEN score >= 85 THEN 3 WHEN score >= 70 THEN 2 WHEN score >= 50 THEN 1 ELSE 0 END - least(2, n % 4)) + 1)::INT] AS review_days,
      round(greatest(0, total * (50 - 20) / 50.0), 6) AS simulated, least(greatest(round_even(total / 8, 0) + 6, 6), 20)::INT AS minutes,
      round(CASE WHEN low < 40 AND low < 50 THEN greatest(0, total * (50 - least(low + 5, 49)) / (50 - low)) ELSE 0 END, 5) AS predicted, round(0.1 + 0.8 * (1 - exp(-ln(2) * n / 7.0)), 6) AS alpha FROM z""",
)
def scalar_formulas(spark, d):
    t = _debts(spark, d).groupBy("student_id").agg(r6(F.sum("impact")).alias("total"))
    z = _mastery(spark, d).groupBy("student_id").agg(F.avg("score").alias("score"), F.max("n").alias("n"), F.min("score").alias("low")).join(t, "student_id")
    score, total, low = F.col("score"), F.col("total"), F.col("low")
    _, right, conf = f.evidence_of_score(score)
    expected, lower, _ = f.forecast(score, f.lit(0.4), f.lit(10), total)
    child = F.least(low + 5, f.lit(49))
    scaled = F.when(low < 40, F.greatest(total * (f.lit(50) - child) / (f.lit(50) - low), f.lit(0))).otherwise(0.0)
    return z.select(
        "student_id", right.alias("evidence_right"), r6(conf).alias("evidence_conf"), r6(f.sigmoid((score - 50) / 10)).alias("squashed"),
        r6(f.question_priority(f.lit(0.6), score / 100, total / 100, F.col("n").cast("double"))).alias("priority"), F.round(expected, 6).alias("expected"), F.round(lower, 6).alias("lower_bound"),
        f.review_interval(score, (F.col("n") % 4).cast("int")).alias("review_days"), r6(f.simulated_impact(total, f.lit(20))).alias("simulated"), f.minutes_of_impact(total).alias("minutes"),
        F.round(F.when((low < 40), f.predicted_impact(total, f.lit(0), child, low)).otherwise(scaled), 5).alias("predicted"), r6(f.adaptive_alpha(F.col("n").cast("double"))).alias("alpha"),
    )
