"""Learner models: knowledge tracing, spaced repetition, mastery, forgetting, weaknesses and priorities.

Attempt folds are ordered per learner and topic, in one ``aggregate`` over the sorted attempts; every operator
takes ``as_of`` rather than the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.forecast import beta_interval


def _ordered(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "correct"))).alias("_a"))


def knowledge_traced(attempts: DataFrame, keys: list[str], order: list[str], start: float = 0.3, learn: float = 0.15, guess: float = 0.2, slip: float = 0.1) -> DataFrame:
    """Bayesian knowledge tracing: evidence, then transit, over attempts in order."""

    def step(p: Column, a: Column) -> Column:
        right = p * (1 - slip) / (p * (1 - slip) + (1 - p) * guess)
        wrong = p * slip / (p * slip + (1 - p) * (1 - guess))
        known = F.when(a["correct"], right).otherwise(wrong)
        return known + (1 - known) * learn

    rows = _ordered(attempts, keys, order)
    return rows.select(*keys, F.size("_a").cast("long").alias("n"), F.round(F.aggregate("_a", F.lit(start), step), 6).alias("mastery"))


def spaced(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Ease, interval and repetitions by the SM-2 rule, quality 5 for right and 2 for wrong answers."""
    start = F.struct(F.lit(2.5).alias("ease"), F.lit(0.0).alias("interval"), F.lit(0).alias("reps"))

    def step(s: Column, a: Column) -> Column:
        ease = F.greatest(F.lit(1.3), s["ease"] + F.when(a["correct"], 0.1).otherwise(0.1 - 3 * (0.08 + 3 * 0.02)))
        interval = F.when(~a["correct"], 1.0).when(s["reps"] == 0, 1.0).when(s["reps"] == 1, 6.0).otherwise(F.least(F.lit(365.0), s["interval"] * s["ease"]))
        return F.struct(ease.alias("ease"), interval.alias("interval"), F.when(a["correct"], s["reps"] + 1).otherwise(0).alias("reps"))

    rows = _ordered(attempts, keys, order).withColumn("s", F.aggregate("_a", start, step))
    return rows.select(*keys, F.round("s.ease", 4).alias("ease"), F.round("s.interval", 4).alias("interval"), F.col("s.reps").alias("reps"))


def retention(days: Column, strength: Column) -> Column:
    """Exponential forgetting."""
    return F.exp(-days / F.greatest(strength, F.lit(0.1)))


def mastery(attempts: DataFrame, keys: list[str], ts: str, as_of: str) -> DataFrame:
    """Beta posterior of right answers, its 90 % bounds, days since the last and retention."""
    out = attempts.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("right"), F.max(ts).alias("_last"))
    mean, low, high = beta_interval(F.col("right"), F.col("n"))
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("_last"))
    out = out.select(*keys, "n", "right", F.round(mean, 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), days.cast("long").alias("days"))
    return out.withColumn("retention", F.round(retention(F.col("days").cast("double"), 1 + F.col("right").cast("double")), 6))


def review_schedule(frame: DataFrame, keys: list[str], floor: float = 0.6) -> DataFrame:
    """What to review, least retained first, per learner."""
    due = frame.filter(F.col("retention") < floor)
    w = Window.partitionBy(keys[0]).orderBy("retention", F.desc("n"), *keys[1:])
    return due.select(*keys, "retention", F.row_number().over(w).alias("position"))


def weak(frame: DataFrame, prerequisites: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """Weak topics, and topics that need a weak one, direct ones first (E6, S3); prerequisites (topic, needs)."""
    student, topic = keys
    direct = frame.filter(F.col("mean") < least).select(student, topic, F.lit(0).alias("_p"), F.lit("direct").alias("kind"))
    onward = direct.select(student, F.col(topic).alias("needs")).join(F.broadcast(prerequisites), "needs").select(student, F.col("topic").alias(topic), F.lit(1), F.lit("inherited"))
    rows = direct.union(onward)
    return rows.groupBy(student, topic).agg(F.min_by("kind", "_p").alias("kind"))


def domain_weakness(mistakes: DataFrame, keys: list[str], date: str, as_of: str) -> DataFrame:
    """Mistakes weighted max(0.5, 1 - 0.05 per month), over half their number, 1 at most."""
    now = F.to_date(F.lit(as_of))
    months = (F.year(now) * 12 + F.month(now)) - (F.year(date) * 12 + F.month(date))
    out = mistakes.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.5), 1 - 0.05 * months)).alias("_w"))
    return out.select(*keys, "n", F.round(F.least(F.lit(1.0), F.col("_w") / F.greatest(F.lit(1.0), F.col("n") / 2)), 6).alias("weakness"))


def root_causes(mistakes: DataFrame, keys: list[str], causes: dict[str, Column]) -> DataFrame:
    """Share of each cause's score, in per cent, a row per cause."""
    out = mistakes.groupBy(*keys).agg(*[F.sum(c.cast("double")).alias(k) for k, c in causes.items()])
    rows = out.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("cause"), F.col(k).alias("score")) for k in causes])).alias("x")).select(*keys, "x.*")
    total = F.sum("score").over(Window.partitionBy(*keys))
    return rows.withColumn("pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("score"), total), F.lit(0.0)), 4))


def prioritised(frame: DataFrame, forecast: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Probability x (1 - mastery), the k best per learner (P34, E8, E10, J12); topics without forecast count 0.2."""
    student, topic = keys
    rows = frame.join(forecast.select(topic, "probability"), topic, "left")
    rows = rows.withColumn("priority", F.round(F.coalesce("probability", F.lit(0.2)) * (1 - F.col("mean")), 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(student).orderBy(F.desc("priority"), topic))).filter(F.col("rank") <= k).select(student, topic, "priority", "rank")


def weekly_plan(frame: DataFrame, student: str, item: str, order: list[Column], per_week: int = 5, weeks: int = 8) -> DataFrame:
    """Items in order, so many a week, for so many weeks."""
    w = Window.partitionBy(student).orderBy(*order)
    rows = frame.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") < per_week * weeks)
    return rows.select(student, item, (F.floor(F.col("_i") / per_week) + 1).cast("int").alias("week"), (F.col("_i") % per_week + 1).cast("int").alias("day"))


def diagnosis(frame: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row for every rule that holds, in the rules' order."""
    told = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("priority"), F.lit(k).alias("finding"))) for i, (k, c) in enumerate(rules.items())]))
    return frame.select(*keys, F.explode(told).alias("x")).select(*keys, "x.*")


def study_value(exams: DataFrame, keys: list[str], value: str, order: list[str], target: float) -> DataFrame:
    """Weighted mean of the last six scores, later ones more, and whether it reaches a target."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = exams.withColumn("_r", F.row_number().over(w)).filter("_r <= 6").withColumn("_w", F.lit(7) - F.col("_r"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(F.col(value) * F.col("_w")) / F.sum("_w"), 4).alias("expected"))
    return out.withColumn("reaches", F.col("expected") >= target)


def goal_forecast(exams: DataFrame, keys: list[str], value: str, date: str, order: list[str], target: float) -> DataFrame:
    """(keys, n, latest, slope, months, goal, probability) of each learner: when the trend meets the target, and how likely.

    The date: a line through the last six positive scores, by place; months ahead are the first whole number at which it
    reaches the target, 0 if the latest score has, null if the line doesn't rise, or needs no or over 60 months. goal is that
    month, or the latest exam's. The chance: 99 if reached; else 50 + 18 z within 5 and 95, rounded half up, where z is the
    latest score and three of the last five's mean steps over the target, in deviations of all scores (1 if there is none).
    Null scores are left out; learners without scores have no row.
    """
    rows = exams.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(date).alias("_d"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    last = [F.desc(f"_o{i}") for i in range(len(order))]
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*last)))
    positive = rows.filter("_v > 0").withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("_i"))).filter("_p <= 6")
    x, y = F.col("_k") - F.col("_p"), F.col("_v")  # places 0, 1, ... from the oldest
    line = positive.withColumn("_k", F.count("*").over(Window.partitionBy(*keys)))
    line = line.groupBy(*keys).agg(
        F.max("_k").alias("_k"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.max_by("_v", -F.col("_p")).alias("_last"), F.max_by("_d", -F.col("_p")).alias("_date")
    )
    slope = (F.col("_k") * F.col("_xy") - F.col("_x") * F.col("_y")) / F.nullif(F.col("_k") * F.col("_xx") - F.col("_x") * F.col("_x"), F.lit(0))
    line = line.withColumn("slope", slope).withColumn("_b", (F.col("_y") - F.col("slope") * F.col("_x")) / F.col("_k"))
    need = F.ceil(F.round((target - F.col("_b")) / F.col("slope") - F.col("_k") + 1, 9))
    months = F.when(F.col("_k") < 2, None).when(F.col("_last") >= target, 0).when((F.col("slope") > 0) & need.between(1, 60), need)
    line = line.select(*keys, F.round("slope", 6).alias("slope"), months.cast("int").alias("months"), "_date")
    line = line.withColumn("goal", F.date_format(F.add_months(F.trunc("_date", "MM"), F.col("months")), "yyyy-MM")).drop("_date")
    old = F.max_by(F.when(F.col("_i") <= 5, F.col("_v")), F.when(F.col("_i") <= 5, F.col("_i")))
    all_of = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("_v", -F.col("_i")).alias("latest"), F.stddev_pop("_v").alias("_sd"), old.alias("_old"))
    step = F.when(F.col("n") > 1, (F.col("latest") - F.col("_old")) / (F.least("n", F.lit(5)) - 1)).otherwise(0.0)
    z = (F.col("latest") + 3 * step - target) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    chance = F.when(F.col("latest") >= target, 99).otherwise(F.floor(F.round(F.greatest(F.lit(5.0), F.least(F.lit(95.0), 50 + 18 * z)), 9) + 0.5))
    return all_of.select(*keys, "n", "latest", chance.cast("int").alias("probability")).join(line, keys, "left")
