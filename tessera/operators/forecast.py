"""Occurrence forecasts from topic x period counts: every factor is a per-topic aggregate, for any number of target periods at once.

Input: sparse (domain, topic, year, cnt). With ``targets`` (a frame of target periods) each factor only sees earlier
periods, so a forecast and a leave-future-out backtest are the same plan with more rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen(matrix: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows before each target: (target, domain, topic, year, cnt). Targets are a few periods, broadcast."""
    return matrix.join(F.broadcast(targets), F.col("year") < F.col("target"))


def cycle_score(gap: Column, sd: Column, since: Column) -> Column:
    """How due a topic is, by the mean and deviation of its gaps and the periods since it last came."""
    mean = F.round(gap, 9)  # so that engines agree where a threshold is met exactly
    regular = F.round(sd / gap, 9) < 0.5
    return (
        F.when(mean.isNull(), 0.3)
        .when(regular & (since >= mean), F.least(F.lit(1.0), 0.6 + 0.1 * (since - gap)))
        .when(since >= mean, 0.5)
        .otherwise(F.greatest(F.lit(0.1), 0.4 * since / gap))
    )


def factors(matrix: DataFrame, targets: DataFrame, first: int, half_life: float = 3.0) -> DataFrame:
    """Per target and topic: recency, base rate, cycle, posterior, momentum (P1, P2, P3, P5, P11), and the plain counts."""
    keys = ["target", "domain", "topic"]
    rows = seen(matrix, targets).withColumn("gap", F.col("year") - F.lag("year").over(Window.partitionBy(*keys).orderBy("year")))
    decay = F.exp(F.lit(-0.6931471805599453 / half_life) * (F.col("target") - F.col("year")))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("active"),
        F.sum("cnt").alias("total"),
        F.max("year").alias("last"),
        F.avg("gap").alias("gap"),
        F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("gap_sd"),
        F.sum(F.col("cnt") * decay).alias("weighted"),
        F.sum(F.when(F.col("year") >= F.col("target") - 5, F.col("cnt")).otherwise(0)).alias("recent"),
    )
    span = (F.col("target") - first).cast("double")
    q = 0.5 ** (1.0 / half_life)
    # the weights of all periods from first to target - 1, a geometric series
    whole = F.lit(q) * (1 - F.pow(F.lit(q), span)) / (1 - q)
    since = F.col("target") - F.col("last")
    cycle = cycle_score(F.col("gap"), F.col("gap_sd"), since)
    return out.select(
        *keys,
        "active",
        "total",
        "last",
        F.least(F.lit(1.0), F.col("weighted") / (5 * whole)).alias("recency"),
        (0.4 * F.col("active") / span + 0.6 * F.least(F.lit(1.0), F.col("total") / F.col("active") / 15)).alias("base"),
        cycle.alias("cycle"),
        ((F.col("active") + 3) / (span + 6)).alias("posterior"),
        F.least(F.lit(1.0), F.col("recent") / 5).alias("momentum"),
    )


WEIGHTS = {"recency": 0.30, "base": 0.20, "cycle": 0.15, "posterior": 0.20, "momentum": 0.15}


def blended(frame: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The weighted blend, the factors' weighted deviation as spread, and the rank per target."""
    p = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weights.items()]) / sum(weights.values())
    frame = frame.withColumn("probability", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), p)), 6))
    spread = F.sqrt(reduce(lambda a, b: a + b, [w * F.pow(F.col(k) - F.col("probability"), 2) for k, w in weights.items()]) / sum(weights.values()))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("probability"), "domain", "topic"))
    return frame.withColumn("spread", F.round(spread, 6)).withColumn("rank", rank)


def markov(matrix: DataFrame, first: int, last: int) -> DataFrame:
    """Two-state chain of presence with Laplace smoothing: the probability of presence after the last period.

    Absent periods need no rows: transitions are counted from runs of the sparse matrix.
    """
    keys = ["domain", "topic"]
    w = Window.partitionBy(*keys).orderBy("year")
    rows = matrix.select(*keys, "year").distinct().withColumn("next", F.lead("year").over(w))
    stay = F.sum((F.col("next") == F.col("year") + 1).cast("long"))
    out = rows.groupBy(*keys).agg(F.coalesce(stay, F.lit(0)).alias("n11"), F.count("*").alias("present"), F.min("year").alias("a"), F.max("year").alias("b"))
    out = out.withColumn("n10", F.col("present") - F.col("n11") - (F.col("b") == last).cast("long"))
    out = out.withColumn("n01", F.col("present") - F.col("n11") - (F.col("a") == first).cast("long"))
    out = out.withColumn("n00", F.lit(last - first) - F.col("n11") - F.col("n10") - F.col("n01"))
    chance = F.when(F.col("b") == last, (F.col("n11") + 1) / (F.col("n11") + F.col("n10") + 2)).otherwise((F.col("n01") + 1) / (F.col("n00") + F.col("n01") + 2))
    return out.select(*keys, "n11", "n10", "n01", "n00", F.round(chance, 6).alias("chance"))


def hidden_trend(matrix: DataFrame, target: int, recent: int = 6, drift: float = 1.5) -> DataFrame:
    """Mean count of the recent present periods against the older ones (P6); absent periods don't count."""
    late = F.avg(F.when(F.col("year") >= target - recent, F.col("cnt")))
    early = F.avg(F.when(F.col("year") < target - recent, F.col("cnt")))
    out = matrix.filter(F.col("year") < target).groupBy("domain", "topic").agg(F.round(late, 6).alias("recent"), F.round(early, 6).alias("older"))
    state = F.when(F.col("recent").isNull(), "gone").when(F.col("older").isNull(), "new").when(F.col("recent") > drift * F.col("older"), "up").when(F.col("recent") * drift < F.col("older"), "down").otherwise("steady")
    return out.withColumn("state", state)


def record(matrix: DataFrame, last: int) -> DataFrame:
    """The metrics of a topic: totals, span, recent sums, growth, share, and a category."""
    within = lambda n: F.sum(F.when(F.col("year") > last - n, F.col("cnt")).otherwise(0))
    out = matrix.groupBy("domain", "topic").agg(
        F.sum("cnt").alias("total"), F.count("*").alias("active"), F.min("year").alias("first"), F.max("year").alias("last"), within(5).alias("recent5"), within(10).alias("recent10")
    )
    growth = F.when(F.col("recent10") > F.col("recent5"), 100.0 * (F.col("recent5") - (F.col("recent10") - F.col("recent5"))) / (F.col("recent10") - F.col("recent5"))).otherwise(F.when(F.col("recent5") > 0, 100.0).otherwise(0.0))
    out = out.withColumn("growth", F.round(growth, 4)).withColumn("share", F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy("domain")), 6))
    category = F.when(F.col("last") <= last - 10, "disappearing").when(F.col("first") > last - 10, "emerging").when(F.col("growth") > 20, "growing").when(F.col("growth") < -20, "declining").otherwise("stable")
    return out.withColumn("category", category)


def next_value(matrix: DataFrame) -> DataFrame:
    """Mean of the last three appearances plus half their change; needs three."""
    w = Window.partitionBy("domain", "topic").orderBy(F.desc("year"))
    rows = matrix.withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    out = rows.groupBy("domain", "topic").agg(F.count("*").alias("n"), F.avg("cnt").alias("m"), (F.max_by("cnt", "year") - F.min_by("cnt", "year")).alias("d")).filter("n = 3")
    return out.select("domain", "topic", F.round(F.greatest(F.lit(0.0), F.col("m") + 0.5 * F.col("d")), 6).alias("expected"))


def dynamic_n(matrix: DataFrame, target: int, least: int = 8, most: int = 28) -> DataFrame:
    """How many topics to pick per domain: mean of the last three periods and their slope, clamped."""
    yearly = matrix.filter(F.col("year") < target).groupBy("domain", "year").agg(F.countDistinct("topic").alias("n"))
    out = yearly.groupBy("domain").agg(
        F.avg(F.when(F.col("year") >= target - 3, F.col("n"))).alias("recent"), F.coalesce(F.regr_slope(F.when(F.col("year") >= target - 10, F.col("n")).cast("double"), F.col("year").cast("double")), F.lit(0.0)).alias("slope")
    )
    picked = F.coalesce("recent", F.lit(0.0)) + 3 * F.col("slope")
    return out.select("domain", F.round(F.col("slope"), 6).alias("slope"), F.greatest(F.lit(least), F.least(F.lit(most), F.floor(picked + 0.5).cast("int"))).alias("n"))


def backtest(matrix: DataFrame, targets: DataFrame, first: int, threshold: float) -> DataFrame:
    """Leave-future-out precision, recall and F1 of a threshold for each target, in one plan."""
    predicted = blended(factors(matrix, targets, first)).filter(F.col("probability") >= threshold).select("target", "domain", "topic", F.lit(1).alias("_p"))
    actual = matrix.join(F.broadcast(targets), F.col("year") == F.col("target")).select("target", "domain", "topic", F.lit(1).alias("_a"))
    rows = predicted.join(actual, ["target", "domain", "topic"], "full")
    out = rows.groupBy("target").agg(F.count(F.col("_p") * F.col("_a")).alias("tp"), F.count("_p").alias("predicted"), F.count("_a").alias("actual"))
    p, r = F.col("tp") / F.greatest("predicted", F.lit(1)), F.col("tp") / F.greatest("actual", F.lit(1))
    return out.select("target", "tp", "predicted", "actual", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(F.lit(0.001), p + r), 6).alias("f1"))


def ranking_quality(ranked: DataFrame, hits: DataFrame, keys: list[str], item: str, rank: str = "rank") -> DataFrame:
    """Average precision and NDCG of a ranking."""
    rows = ranked.join(hits.select(*keys, item).distinct().withColumn("_h", F.lit(1)), [*keys, item], "left").withColumn("_h", F.coalesce("_h", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(rank)
    rows = rows.withColumn("_c", F.sum("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_ideal", F.when(F.col(rank) <= F.sum("_h").over(Window.partitionBy(*keys)), 1 / F.log2(F.col(rank) + 1.0)).otherwise(0.0))
    out = rows.groupBy(*keys).agg(F.sum("_h").alias("hits"), F.sum(F.col("_h") * F.col("_c") / F.col(rank)).alias("s"), F.sum(F.col("_h") / F.log2(F.col(rank) + 1.0)).alias("g"), F.sum("_ideal").alias("i"))
    return out.select(*keys, F.col("hits").cast("long").alias("hits"), F.round(F.coalesce(F.try_divide("s", "hits"), F.lit(0.0)), 6).alias("average_precision"), F.round(F.coalesce(F.try_divide("g", "i"), F.lit(0.0)), 6).alias("ndcg"))


def cluster_rollup(probabilities: DataFrame, members: DataFrame, topic: str, cluster: str, p: str) -> DataFrame:
    """Mean and largest probability of a cluster's topics (A31, P19); members without a forecast count 0.2."""
    rows = members.join(probabilities.select(topic, p), topic, "left")
    return rows.groupBy(cluster).agg(F.count("*").alias("members"), F.round(F.avg(F.coalesce(p, F.lit(0.2))), 6).alias("mean"), F.round(F.max(F.coalesce(p, F.lit(0.2))), 6).alias("highest"))


def beta_interval(right: Column, n: Column, a: float = 1.0, b: float = 1.0) -> tuple[Column, Column, Column]:
    """Posterior mean of a rate and its 90 % bounds by the normal approximation (M2)."""
    alpha, beta = right + a, n - right + b
    mean = alpha / (alpha + beta)
    sd = F.sqrt(alpha * beta / (F.pow(alpha + beta, 2) * (alpha + beta + 1)))
    return mean, F.greatest(F.lit(0.0), mean - 1.645 * sd), F.least(F.lit(1.0), mean + 1.645 * sd)
