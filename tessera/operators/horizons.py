"""Forecasts for one target period from topic x period counts: six factors with a structural break, three horizons and
their blends, rotation of domains, features, and the final choice of topics.

Input: sparse (domain, topic, year, cnt); a topic is known by both its names. Every factor is a per-topic aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.forecast import cycle_score

KEYS = ["domain", "topic"]

#: Fixed weights of the six factors, and of counts before and after the break.
SIX = {"recency": 0.15, "base": 0.20, "cycle": 0.15, "markov": 0.15, "posterior": 0.20, "trend": 0.15}
BEFORE, AFTER = 0.5, 2.0

#: Fixed weights of the short, medium and long horizon in each blend.
BLENDS = {"short": (0.60, 0.25, 0.15), "medium": (0.20, 0.60, 0.20), "long": (0.10, 0.30, 0.60), "mixed": (0.35, 0.40, 0.25), "balanced": (0.33, 0.34, 0.33)}


def _sum_between(low: int, high: int) -> Column:
    """Counts of the periods from low up to but without high."""
    return F.sum(F.when((F.col("year") >= low) & (F.col("year") < high), F.col("cnt")).otherwise(0))


def _decayed(target: int, half_life: float) -> Column:
    return F.sum(F.col("cnt") * F.exp(F.lit(-math.log(2) / half_life) * (target - F.col("year"))))


def _decay_total(target: int, first: int, half_life: float) -> float:
    return sum(math.exp(-math.log(2) / half_life * (target - y)) for y in range(first, target))


def companions(matrix: DataFrame, target: int, recent: int = 2) -> DataFrame:
    """(domain, topic, together): the most periods that a topic shares with another one that was active of late.

    Pairs of topics of one period meet, so the join grows with the square of the topics of a period: a syllabus, not a corpus.
    """
    rows = matrix.filter(F.col("year") < target).select(*KEYS, "year").distinct()
    late = rows.filter(F.col("year") >= target - recent).select(*KEYS).distinct()
    other = rows.join(late, KEYS, "left_semi").select(F.col("domain").alias("_d"), F.col("topic").alias("_t"), "year")
    pairs = rows.join(other, "year").filter((F.col("domain") != F.col("_d")) | (F.col("topic") != F.col("_t")))
    return pairs.groupBy(*KEYS, "_d", "_t").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.max("n").alias("together"))


def six_factors(matrix: DataFrame, target: int, first: int, broken: int) -> DataFrame:
    """Recency, base rate, cycle, company, posterior and trend, periods from ``broken`` on weighing four times the older, and their blend."""
    n = target - first
    weight = F.when(F.col("year") >= broken, AFTER).otherwise(BEFORE)
    q = math.log(2) / 3
    whole = sum(math.exp(-q * (target - y)) * (AFTER if y >= broken else BEFORE) for y in range(first, target))
    out = matrix.filter(F.col("year") < target).groupBy(*KEYS).agg(
        F.sum(F.col("cnt") * F.exp(F.lit(-q) * (target - F.col("year"))) * weight).alias("_w"),
        F.sum(weight).alias("_a"),
        F.count("*").alias("_n"),
        F.sum("cnt").alias("_total"),
        F.min("year").alias("_first"),
        F.max("year").alias("_last"),
        _sum_between(max(target - 3, broken), target).alias("_late"),
        _sum_between(max(target - 6, broken - 3), target - 3).alias("_early"),
    )
    gap = (F.col("_last") - F.col("_first")) / (F.col("_n") - 1)
    since = target - 1 - F.col("_last")
    cycle = (
        F.when(F.col("_n") < 2, 0.3)
        .when((gap <= 1.5) | (since >= gap - 1), 0.8)
        .when(since >= gap * 0.7, 0.6)
        .when((since <= 1) & (gap > 2), 0.5)
        .when(since <= 1, 0.7)
        .otherwise(0.3)
    )
    seasons = max(1.0, BEFORE * max(1, broken - first) + AFTER * max(1, target - broken))
    trend = F.when(F.col("_late") * AFTER > F.col("_early") * BEFORE, 0.8).when(F.col("_late") * AFTER < F.col("_early") * BEFORE, 0.2).otherwise(0.5)
    factors = {
        "recency": F.least(F.lit(1.0), F.col("_w") / whole / 5),
        "base": 0.4 * F.col("_a") / seasons + 0.6 * F.least(F.lit(1.0), F.col("_total") / F.col("_n") / 15),
        "cycle": cycle,
        "markov": F.when(F.col("together").isNull(), 0.3).otherwise(F.least(F.lit(0.9), F.col("together") / max(1, n) * 4.0)),
        "posterior": (3.0 + F.col("_n")) / (6.0 + n),
        "trend": trend,
    }
    out = out.join(companions(matrix, target), KEYS, "left").select(*KEYS, *[c.alias(k) for k, c in factors.items()])
    score = sum((F.col(k) * w for k, w in SIX.items()), F.lit(0.0))
    rounded = [F.round(k, 6).alias(k) for k in SIX]
    return out.select(*KEYS, *rounded, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.01), score)), 6).alias("probability"))


def horizons(matrix: DataFrame, markov: DataFrame, target: int, first: int) -> DataFrame:
    """Scores of 0 to 100 for one, two to three, and four to five periods ahead, and three blends of them.

    ``markov`` (domain, topic, score): the chance by recent company, 0.3 where there is none. Emerging topics (the last
    three periods above 1.3 times the three before) lean to the short horizon, but not in the long blend.
    """
    n = target - first
    rows = matrix.filter(F.col("year") < target).withColumn("gap", F.col("year") - F.lag("year").over(Window.partitionBy(*KEYS).orderBy("year")))
    late = F.col("year") >= target - 6
    out = rows.groupBy(*KEYS).agg(
        *[F.least(F.lit(1.0), _decayed(target, h) / (5 * _decay_total(target, first, h))).alias(f"_r{h}") for h in (2, 4, 8)],
        F.count("*").alias("_n"),
        F.sum("cnt").alias("_total"),
        F.max("year").alias("_last"),
        F.avg("gap").alias("_gap"),
        F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("_sd"),
        F.coalesce(F.avg(F.when(late, F.col("cnt"))), F.lit(0.0)).alias("_new"),
        F.coalesce(F.avg(F.when(~late, F.col("cnt"))), F.lit(0.0)).alias("_old"),
        F.transform(F.array_sort(F.collect_list(F.when(late, F.struct("year", "cnt")))), lambda s: s["cnt"]).alias("_c"),
        _sum_between(target - 3, target).alias("_late"),
        _sum_between(target - 6, target - 3).alias("_early"),
    )
    drift = F.col("_new") - F.col("_old")
    cusum = F.when(F.abs(drift) > 1.5, F.least(F.lit(1.0), F.abs(drift) / 4.5)).otherwise(0.3)
    posterior = lambda a, b: (F.col("_n") + a) / (n + a + b)
    base = 0.4 * F.col("_n") / n + 0.6 * F.least(F.lit(1.0), F.col("_total") / F.col("_n") / 15)
    last = F.slice("_c", F.greatest(F.size("_c") - 4, F.lit(1)), 5)
    half = F.floor(F.size("_l") / 2).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    rise = total(F.slice("_l", half + 1, F.size("_l"))) / (F.size("_l") - half) - total(F.slice("_l", F.lit(1), half)) / F.greatest(half, F.lit(1))
    rise = F.when(F.size("_c") >= 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rise / 5))).otherwise(0.0)
    out = out.withColumn("_l", last).join(markov.select(*KEYS, F.col("score").alias("_m")), KEYS, "left").withColumn("_m", F.coalesce("_m", F.lit(0.3)))
    cycle = cycle_score(F.col("_gap"), F.col("_sd"), target - F.col("_last"))
    out = out.select(
        *KEYS,
        (100 * (0.35 * F.col("_r2") + 0.25 * F.col("_m") + 0.20 * F.least(F.lit(1.0), cusum + 0.3) + 0.20 * posterior(3.0, 5.0))).alias("_s"),
        (100 * (0.20 * F.col("_r4") + 0.25 * base + 0.20 * cycle + 0.20 * posterior(2.0, 8.0) + 0.15 * F.col("_m"))).alias("_d"),
        (100 * (0.30 * F.col("_r8") + 0.35 * base + 0.25 * posterior(1.5, 12.0) + 0.10 * rise)).alias("_g"),
        ((F.col("_late") * 10 > F.col("_early") * 13) & (F.col("_late") >= 2)).alias("emerging"),
    )

    def blend(name: str, leans: bool) -> Column:
        s, m, g = BLENDS[name]
        bias = F.when(F.col("emerging"), 0.5).otherwise(0.0) if leans else F.lit(0.0)
        return F.round((s + 0.2 * bias) * F.col("_s") + (m - 0.1 * bias) * F.col("_d") + (g - 0.1 * bias) * F.col("_g"), 2)

    out = out.select(*KEYS, F.round("_s", 2).alias("short"), F.round("_d", 2).alias("medium"), F.round("_g", 2).alias("long"), blend("mixed", True).alias("mixed"), blend("short", True).alias("short_first"), blend("long", False).alias("long_first"), "emerging")
    return out


def rotation(matrix: DataFrame, recent: tuple[int, int], older: tuple[int, int]) -> DataFrame:
    """Per domain: topics, total, how often any of its topics comes, and where its counts move between two spans, ends included."""
    out = matrix.groupBy("domain").agg(
        F.countDistinct("topic").alias("topics"),
        F.sum("cnt").alias("total"),
        F.countDistinct("year").alias("_n"),
        ((F.max("year") - F.min("year")) / (F.countDistinct("year") - 1)).alias("_gap"),
        (_sum_between(recent[0], recent[1] + 1) - _sum_between(older[0], older[1] + 1)).alias("change"),
    )
    pattern = F.when(F.col("_n") < 4, "insufficient_data").when(F.col("_gap") <= 1.5, "yearly").when(F.col("_gap") <= 2.5, "biennial").when(F.col("_gap") <= 4, "triennial").otherwise("irregular")
    shift = F.when(F.col("change") > 3, "increasing").when(F.col("change") < -3, "decreasing").otherwise("stable")
    return out.select("domain", "topics", "total", "change", pattern.alias("pattern"), shift.alias("shift"))


def difficulty_mix(topics: DataFrame, score: Column) -> DataFrame:
    """Easy, medium and hard topics by score (35, 60): number and per cent; no score is medium, one of 0 counts as 40."""
    given = F.coalesce(F.nullif(score, F.lit(0)), F.lit(40))
    level = F.when(given >= 60, "hard").when(given >= 35, "medium").otherwise("easy")
    out = topics.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))  # three rows


def markov_steps(chain: DataFrame, steps: int) -> DataFrame:
    """The chance of presence ``steps`` periods on, in closed form, from the counts and one-step chance of ``forecast.markov``."""
    stay = (F.col("n11") + 1) / (F.col("n11") + F.col("n10") + 2)
    enter = (F.col("n01") + 1) / (F.col("n00") + F.col("n01") + 2)
    rest = enter / (1 - stay + enter)
    return chain.select(*KEYS, F.round(rest + (F.col("chance") - rest) * F.pow(stay - enter, F.lit(steps - 1.0)), 6).alias("chance"))


def topic_features(matrix: DataFrame, about: DataFrame, target: int, first: int) -> DataFrame:
    """Eight features per topic of ``about`` (domain, topic, domain_index, difficulty, links, cluster); topics never seen get the defaults (P25).

    Slope and deviation are over all periods, absent ones counting 0.
    """
    n = target - first
    x = F.col("year") - (target - 3)  # the last five periods, from -2 to 2
    seen = matrix.filter((F.col("year") < target) & (F.col("year") >= first)).groupBy(*KEYS).agg(
        F.count("*").alias("_n"),
        (_decayed(target, 3.0) / _decay_total(target, first, 3.0) / 5).alias("recency"),
        F.sum(F.when(F.col("year") >= target - 5, x * F.col("cnt")).otherwise(0)).alias("_x"),
        F.sum("cnt").alias("_s"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("_ss"),
    )
    rows = about.join(seen, KEYS, "left")
    active = rows.filter("cluster is not null").groupBy("cluster").agg(F.sum("_n").alias("_active"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_ss") / n - F.pow(F.col("_s") / n, F.lit(2.0))))
    known = F.col("_n").isNotNull()
    return rows.join(active, "cluster", "left").select(
        *KEYS,
        F.round(F.coalesce(F.col("_n") / n, F.lit(0.0)), 6).alias("presence"),
        F.round(F.coalesce("recency", F.lit(0.0)), 6).alias("recency"),
        (F.col("domain_index") / 4).alias("domain_index"),
        F.when(known, F.coalesce("difficulty", F.lit(0.5))).otherwise(0.5).alias("difficulty"),
        F.when(known, F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / 15)).otherwise(0.0).alias("links"),
        F.when(known & F.col("cluster").isNotNull(), F.least(F.lit(1.0), F.col("_active") / 50)).otherwise(0.3).alias("cluster_activity"),
        F.round(F.when(known, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_x") / 10))).otherwise(0.0), 6).alias("slope"),
        F.round(F.when(known, F.least(F.lit(1.0), spread / 3)).otherwise(0.0), 6).alias("deviation"),
    )


def final_selection(frame: DataFrame, n: int, least: float = 0.5, share: float = 0.4) -> DataFrame:
    """The n best by ``p`` and, of clusters whose ``cluster_p`` reaches ``least``, the topics whose ``boosted`` is its ``share`` of it; rescued are those that only the cluster brings."""
    best = frame.orderBy(F.desc("p"), *KEYS).limit(n).select(*KEYS, F.lit(True).alias("_best"))
    brought = (F.col("cluster_p") >= least) & (F.col("boosted") >= F.col("cluster_p") * share)
    rows = frame.join(best, KEYS, "left").filter(F.col("_best") | brought)
    return rows.select(*KEYS, "p", "boosted", F.col("_best").isNull().alias("rescued"))


def summary(records: DataFrame, p: str, total: str, growth: str) -> DataFrame:
    """One row: the topics of the highest chance, total and growth, the least (domain, topic) of equals (P31); empty without topics."""
    first = lambda c: F.min_by(F.struct(*KEYS), F.struct(-F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))), *KEYS))
    out = records.agg(F.count("*").alias("topics"), first(p).alias("likeliest"), first(total).alias("largest"), first(growth).alias("fastest")).filter("topics > 0")
    picks = [F.concat_ws("/", f"{c}.domain", F.col(f"{c}.topic").cast("string")).alias(c) for c in ("likeliest", "largest", "fastest")]
    return out.select("topics", *picks)


def trend_audit(declared: DataFrame, matrix: DataFrame, asked: DataFrame, recent: int) -> DataFrame:
    """(check, severity, n): declared totals and years of topics that the matrix contradicts, and asked (domain, topic, year) that it lacks.

    Every row asked is checked, not a sample of them.
    """
    found = matrix.filter("cnt > 0").groupBy(*KEYS).agg(F.sum("cnt").alias("_total"), F.count("*").alias("_years"))
    topics = declared.join(found, KEYS, "left").select(*KEYS, "total", "years", F.coalesce("_total", F.lit(0)).alias("_total"), F.coalesce("_years", F.lit(0)).alias("_years"))
    domains = topics.groupBy("domain").agg(F.sum("total").alias("t"), F.sum("_total").alias("f"))
    lost = asked.filter("topic is not null").join(matrix.filter("cnt > 0").select(*KEYS, "year").distinct(), [*KEYS, "year"], "left_anti")
    count = lambda df, check, severity: df.agg(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.count("*").alias("n"))
    return (
        count(topics.filter("total <> _total"), "topic_total", "high")
        .union(count(domains.filter("t <> f"), "domain_total", "high"))
        .union(count(topics.filter("years <> 0 and years <> _years"), "topic_years", "low"))
        .union(count(lost, "topic_year_missing", "medium"))
        .union(count(lost.filter(F.col("year") >= recent).join(declared.select(*KEYS), KEYS, "left_semi"), "recent_missing", "medium"))
    )
