"""Scores, decay, weights and association measures as functions of columns. All arithmetic is in doubles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the two generations of scores.
W_ACC, W_SEV, W_CONF = 0.6, 0.3, 0.1
STABILITY, STREAK_GAIN, COUNT_GAIN = 2.5, 0.45, 0.25
GATE_PARENT, GATE_CHILD, STEEP, BASE = 0.55, 0.5, 8.0, 0.55
TRANSFER_GAP, CASCADE, VOLUME, HIT = 1.15, 0.12, 0.08, 0.08


def lit(x: float) -> Column:
    return F.lit(float(x))


def clamp(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c.cast("double"), lit(low)), lit(high)))


def half_up(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def half_even(c: Column, places: int = 6) -> Column:
    return F.bround(c, places)


def score_v1(acc: Column, sev: Column, conf: Column) -> Column:
    """0 to 100: accuracy, severity of mistakes (at most 1 counts) and confidence of 1 to 5; six places, halves up."""
    return half_up(lit(100) * (lit(W_ACC) * acc + lit(W_SEV) * (lit(1) - F.least(sev, lit(1))) + lit(W_CONF) * conf / lit(5)))


def band(score: Column) -> Column:
    return F.when(score >= 70, "green").when(score >= 40, "yellow").otherwise("red")


def empirical(right: Column, n: Column) -> Column:
    """Share of right answers, drawn to a half by one made-up answer; right counts within [0, n]."""
    n = F.greatest(n.cast("double"), lit(0))
    return (F.least(F.greatest(right.cast("double"), lit(0)), n) + lit(0.5)) / (n + lit(1))


def stability(streak: Column, n: Column) -> Column:
    """Days that memory holds."""
    s = F.greatest(streak.cast("double"), lit(0))
    return lit(STABILITY) * (lit(1) + lit(STREAK_GAIN) * s) * (lit(1) + lit(COUNT_GAIN) * F.log(lit(1) + F.greatest(n.cast("double"), lit(1))))


def retention(age_days: Column, stable: Column) -> Column:
    return F.exp(-F.greatest(age_days, lit(0)) / stable)


def support(mean: Column, least: Column) -> Column:
    """Of the prerequisites' scores, by their mean and minimum; a half without any."""
    return F.coalesce(lit(0.35) * mean + lit(0.65) * least, lit(0.5))


def ceiling(least: Column) -> Column:
    return F.coalesce(lit(0.55) + lit(0.45) * least, lit(1))


def score_v2(emp: Column, conf: Column, ret: Column, sup: Column, ceil: Column) -> Column:
    """0 to 1, not rounded."""
    own = lit(0.5) * (lit(0.85) * emp + lit(0.15) * conf / lit(5)) + lit(0.3) * ret + lit(0.2) * sup
    return clamp(F.least(own, ceil), 0, 1)


def evidence_of_score(raw: Column) -> tuple[Column, Column, Column]:
    """(n, right, confidence) that a score of 0 to 100 stands for."""
    p = clamp(raw / lit(100), 0, 1)
    return F.lit(10), F.bround(lit(10) * p, 0).cast("int"), lit(1) + lit(4) * p


def freshness(age_days: Column) -> Column:
    """0.75 to 1, with a half-life of 21 days."""
    return lit(0.75) + lit(0.25) * F.exp(lit(-math.log(2)) * age_days / lit(21))


def sigmoid(x: Column) -> Column:
    return lit(1) / (lit(1) + F.exp(-x))


def recency(days: Column) -> Column:
    return lit(1) / (lit(1) + days / lit(7))


def impact_v1(parent: Column, child: Column, freq: Column, days: Column, weight: Column) -> Column:
    """Of a weak parent on a weak child: 0 unless parent < 40, child < 50 and freq > 0."""
    hit = (parent < 40) & (child < 50) & (freq > 0)
    return F.when(hit, freq.cast("double") * (lit(50) - child) * recency(days) * weight).otherwise(lit(0))


def impact_v2(parent: Column, child: Column, weight: Column, gap: Column, freq: Column, downstream: Column) -> Column:
    """Smooth gates on scores of 0 to 1; 0 without a mistake."""
    out = (
        lit(BASE) * sigmoid((parent - lit(GATE_PARENT)) * lit(STEEP)) * sigmoid((lit(GATE_CHILD) - child) * lit(STEEP)) * F.greatest(weight, lit(0))
        * F.when(gap, lit(TRANSFER_GAP)).otherwise(lit(1)) * (lit(1) + lit(CASCADE) * F.log(lit(1) + F.greatest(downstream.cast("double"), lit(0))))
        * (lit(1) + lit(VOLUME) * F.log(lit(1) + F.greatest(freq.cast("double"), lit(0))))
    )
    return F.when(freq > 0, out).otherwise(lit(0))


def is_hit(freq: Column, impact: Column) -> Column:
    return (freq > 0) & (impact >= HIT)


def projected_weight(impact: Column, most: Column, recent: Column, course: Column, exam: Column, minutes: Column, most_minutes: Column) -> Column:
    part = lambda x, m: F.when(m > 0, x / m).otherwise(lit(0))
    return half_up(lit(0.45) * part(impact, most) + lit(0.2) * recent + lit(0.15) * course + lit(0.1) * exam + lit(0.1) * part(minutes, most_minutes))


def question_priority(difficulty: Column, score: Column, impact: Column, age_days: Column) -> Column:
    """Gap to mastery x impact x fit of the difficulty (a little above the score) x age."""
    s = clamp(score, 0, 1)
    off = difficulty - clamp(score + lit(0.15), 0, 1)
    return F.pow(lit(1) - s, lit(1.2)) * (impact + lit(0.05)) * F.exp(lit(-4) * off * off) * (lit(1) + F.greatest(age_days, lit(0)) / lit(14))


def forecast(score: Column, slope: Column, days: Column, debt: Column) -> tuple[Column, Column, Column]:
    """(expected, lower, upper) in so many days, 1 to 90."""
    d = clamp(days, 1, 90)
    expected = clamp(score + slope * d, 0, 100)
    spread = clamp(lit(5) + lit(0.4) * d + debt / lit(40), 5, 30)
    return half_even(expected), half_even(clamp(expected - spread, 0, 100)), half_even(clamp(expected + spread, 0, 100))


def review_interval(score: Column, lapses: Column) -> Column:
    """Days to the next review: a ladder by score, stepped down by up to two lapses."""
    level = F.when(score >= 85, 3).when(score >= 70, 2).when(score >= 50, 1).otherwise(0)
    step = F.greatest(level - F.least(F.lit(2), lapses), F.lit(0))
    return F.element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 7, 15)]), (step + 1).cast("int"))


def simulated_impact(before: Column, target: Column) -> Column:
    """What remains of an impact when the parent's score becomes `target`."""
    t = clamp(target, 0, 100)
    return F.when(t >= 40, lit(0)).otherwise(F.greatest(before * (lit(50) - t) / lit(50), lit(0)))


def predicted_impact(impact: Column, parent: Column, child: Column, child_before: Column) -> Column:
    still = (parent < 40) & (child < 50)
    left = lit(50) - child_before
    scaled = F.when(left <= 0, impact).otherwise(impact * (lit(50) - child) / F.when(left > 0, left))
    return half_even(F.when(still, F.greatest(scaled, lit(0))).otherwise(lit(0)))


def minutes_of_impact(impact: Column) -> Column:
    return F.least(F.greatest(F.bround(impact / lit(8), 0) + lit(6), lit(6)), lit(20)).cast("int")


def moved_accuracy(before: Column, right: Column) -> Column:
    """Nine parts before, one part new; 0.8 or 0.4 at first."""
    y = F.when(right, lit(1)).otherwise(lit(0))
    return F.when(before.isNull(), F.when(right, lit(0.8)).otherwise(lit(0.4))).otherwise((lit(9) * before + y) / lit(10))


def moved_severity(before: Column, right: Column) -> Column:
    return F.when(before.isNull(), F.when(right, lit(0.2)).otherwise(lit(0.5))).otherwise(clamp(before * F.when(right, lit(0.9)).otherwise(lit(1.05)), 0, 1))


def adaptive_alpha(days: Column, half_life: float = 7.0, low: float = 0.1, high: float = 0.9) -> Column:
    """The weight of new evidence, the greater the longer ago the old is."""
    return lit(low) + lit(high - low) * (lit(1) - F.exp(lit(-math.log(2)) * F.greatest(days, lit(0)) / lit(max(half_life, 0.01))))


def smoothed(old: Column, new: Column, alpha: Column) -> Column:
    return half_even((lit(1) - alpha) * old + alpha * new)


def pmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Pointwise mutual information in bits; 0 without a count."""
    ok = (both > 0) & (a > 0) & (b > 0) & (n > 0)
    ratio = both.cast("double") * n.cast("double") / (F.when(ok, a.cast("double") * b.cast("double")))
    return F.when(ok, F.log2(ratio)).otherwise(lit(0))


def npmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """PMI over its greatest possible value, within [-1, 1]; 1 if the pair is everything."""
    p = both.cast("double") / F.when(n > 0, n.cast("double"))
    return F.when((both > 0) & (p < 1), clamp(pmi(both, a, b, n) / F.when(p < 1, -F.log2(p)), -1, 1)).when(both > 0, lit(1)).otherwise(lit(0))


def hub_score(in_degree: Column, out_degree: Column) -> Column:
    return F.sqrt(in_degree.cast("double") * out_degree) + lit(0.25) * (in_degree + out_degree)


def density(edges: Column, nodes: Column) -> Column:
    return F.when(nodes > 1, edges.cast("double") / (nodes.cast("double") * (nodes - 1))).otherwise(lit(0))


def topic_weight(mastery: Column, interest: Column, difficulty: Column) -> Column:
    """Gap x interest x how near the difficulty is to 0.55."""
    near = lit(1) - F.least(lit(1), F.abs(difficulty - lit(0.55)) / lit(0.45))
    return (lit(1) - clamp(mastery, 0, 1)) * (lit(0.4) + lit(0.6) * F.least(interest * lit(2), lit(1))) * (lit(0.35) + lit(0.65) * near)


def decayed(age_days: Column, half_life: float) -> Column:
    return F.exp(lit(-math.log(2) / half_life) * F.greatest(age_days, lit(0)))


def splitmix(seed: Column) -> Column:
    """A uniform number in [0, 1) of a seed, the same on every run: the public splitmix64 mixing of 64-bit numbers."""
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            z = s.fillna(0).to_numpy().astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return pd.Series(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53)

    return run(seed)


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise of a uniform number in [0, 1)."""
    x = u - lit(0.5)
    return -lit(scale) * F.signum(x) * F.log(F.greatest(lit(1) - lit(2) * F.abs(x), lit(1e-300)))
