"""Window computations over topic x period matrices and score series.

Inputs are long relations; every window is partitioned by the entity, and every order is total.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Distinct periods of each entity with the number of the run of consecutive ones they are in."""
    rows = df.select(*keys, period).distinct()
    return rows.withColumn("_island", F.col(period) - F.row_number().over(Window.partitionBy(*keys).orderBy(period)))


def streaks(df: DataFrame, keys: list[str], period: str = "year") -> DataFrame:
    """Longest run of consecutive periods, the run that ends with the entity's last, and the gap to the corpus' last."""
    runs = _islands(df, keys, period).groupBy(*keys, "_island").agg(F.count("*").alias("n"), F.max(period).alias("end"))
    last = df.agg(F.max(period).alias("_last"))
    out = runs.groupBy(*keys).agg(F.max("n").alias("longest"), F.max_by("n", "end").alias("trailing"), F.max("end").alias("last_period"))
    out = out.join(F.broadcast(last))  # one row
    return out.select(*keys, "longest", F.when(F.col("last_period") == F.col("_last"), F.col("trailing")).otherwise(0).cast("long").alias("trailing"), (F.col("_last") - F.col("last_period")).alias("gap"))


def intervals(df: DataFrame, keys: list[str], period: str = "year") -> DataFrame:
    """Gaps between appearances: mean, population deviation, largest, and the period that ended the first largest."""
    w = Window.partitionBy(*keys).orderBy(period)
    rows = df.select(*keys, period).distinct().withColumn("gap", F.col(period) - F.lag(period).over(w)).filter("gap is not null")
    return rows.groupBy(*keys).agg(
        F.round(F.avg("gap"), 6).alias("mean_gap"),
        F.round(F.stddev_pop("gap"), 6).alias("sd_gap"),
        F.max("gap").cast("long").alias("max_gap"),
        F.max_by(period, F.struct("gap", -F.col(period))).alias("comeback"),
    )


def recency_weighted(df: DataFrame, keys: list[str], target: int, first: int, half_life: float = 3.0, period: str = "year", count: str = "cnt", cap: float = 5.0) -> DataFrame:
    """Exponentially weighted frequency over all periods of [first, target), absent ones included.

    Periods without a row add nothing above and their weight below, so no dense matrix is made.
    """
    weight = lambda age: math.exp(-math.log(2) / half_life * age)
    below = sum(weight(target - y) for y in range(first, target)) * cap
    rows = df.filter((F.col(period) >= first) & (F.col(period) < target))
    up = F.sum(F.col(count) * F.exp(F.lit(-math.log(2) / half_life) * (F.lit(target) - F.col(period))))
    return rows.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), up / F.lit(below)), 6).alias("recency"))


def linear_recent(df: DataFrame, keys: list[str], target: int, period: str = "year", count: str = "cnt") -> DataFrame:
    """The last five periods weighted 5, 4, 3, 2, 1, over 15 times 5, at most 1."""
    age = F.lit(target) - F.col(period)
    up = F.sum(F.when((age >= 1) & (age <= 5), (F.lit(6) - age) * F.col(count)).otherwise(0))
    return df.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), up / 15.0 / 5.0), 6).alias("recent"))


def halves(df: DataFrame, keys: list[str], period: str = "year", count: str = "cnt", tolerance: float = 0.0) -> DataFrame:
    """Mean count per period in the first and second half of the corpus' periods, and the trend's name."""
    spine = df.select(period).distinct()
    order = Window.orderBy(period)
    spine = spine.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    spine = spine.select(F.col(period).alias("_p"), (F.col("_i") <= F.floor(F.col("_n") / 2)).alias("_early"), F.floor(F.col("_n") / 2).alias("_a"), (F.col("_n") - F.floor(F.col("_n") / 2)).alias("_b"))
    rows = df.join(F.broadcast(spine), F.col(period) == F.col("_p"))
    out = rows.groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col("_early"), F.col(count)).otherwise(0)) / F.greatest(F.max("_a"), F.lit(1)), 6).alias("early"),
        F.round(F.sum(F.when(~F.col("_early"), F.col(count)).otherwise(0)) / F.greatest(F.max("_b"), F.lit(1)), 6).alias("late"),
    )
    trend = F.when(F.col("late") > F.col("early") * (1 + tolerance), "rising").when(F.col("late") < F.col("early") * (1 - tolerance), "falling").otherwise("stable")
    return out.withColumn("trend", trend)


def thirds(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Mean of the first and last third of each series; up or down beyond 20 %."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).withColumn("_t", F.floor(F.col("_n") / 3)).filter("_n >= 3")
    out = rows.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("_i") <= F.col("_t"), F.col(value))), 4).alias("first_third"), F.round(F.avg(F.when(F.col("_i") > F.col("_n") - F.col("_t"), F.col(value))), 4).alias("last_third"))
    return out.withColumn("trend", F.when(F.col("last_third") > F.col("first_third") * 1.2, "up").when(F.col("last_third") < F.col("first_third") * 0.8, "down").otherwise("flat"))


def regression(df: DataFrame, keys: list[str], value: str, order: list[str], last: int | None = None) -> DataFrame:
    """Least-squares slope and intercept on the position, from 0, of each series' last rows; and the next value."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = df.withColumn("_r", F.row_number().over(w))
    rows = rows if last is None else rows.filter(F.col("_r") <= last)
    rows = rows.withColumn("_x", (F.count("*").over(Window.partitionBy(*keys)) - F.col("_r")).cast("double"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("intercept"))
    out = out.filter("n >= 2")
    ahead = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("n"))
    return out.select(*keys, "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round(ahead, 4).alias("next_value"))


def stagnation(df: DataFrame, keys: list[str], value: str, order: list[str], last: int = 4, spread: float = 8.0) -> DataFrame:
    """Range of the last values, and whether it is small."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.max(value) - F.min(value), 4).alias("spread"))
    return out.withColumn("stagnant", (F.col("n") == last) & (F.col("spread") < spread))


def burnout(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Drops of three in a row, change over the last two, and volatility above 0.3 of the mean."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_1", F.lag(value, 1).over(w)).withColumn("_2", F.lag(value, 2).over(w)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    out = rows.groupBy(*keys).agg(
        F.sum(((F.col(value) < F.col("_1")) & (F.col("_1") < F.col("_2"))).cast("long")).alias("drops"),
        F.round(F.max(F.when(F.col("_r") == 1, F.col(value) - F.col("_2"))), 4).alias("last_change"),
        F.round(F.stddev_pop(value), 6).alias("volatility"),
        F.round(F.avg(value), 6).alias("mean"),
    )
    return out.withColumn("drops", F.coalesce("drops", F.lit(0)).cast("long")).withColumn("volatile", F.col("volatility") > 0.3 * F.col("mean"))


def monthly_streaks(df: DataFrame, keys: list[str], month: Column) -> DataFrame:
    """Runs of consecutive months with a row: the last one and the best."""
    rows = _islands(df.withColumn("_m", month), keys, "_m")
    runs = rows.groupBy(*keys, "_island").agg(F.count("*").alias("n"), F.max("_m").alias("end"))
    return runs.groupBy(*keys).agg(F.max_by("n", "end").alias("current"), F.max("n").alias("best"))


def carried(df: DataFrame, keys: list[str], order: list[str], label: str, reset: Column) -> DataFrame:
    """Unknown (null) labels take the one before in their block, then the one after; a reset begins a block."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("block", F.sum(F.coalesce(reset.cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = Window.partitionBy(*keys, "block").orderBy(*order)
    back = F.last(label, ignorenulls=True).over(b.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(label, ignorenulls=True).over(b.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("carried", F.coalesce(back, ahead))


def neighbours(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """The text before and after in the sequence."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(text).over(w)).withColumn("following", F.lead(text).over(w))


def capped_rank(df: DataFrame, group: str, score: Column, ties: list[str], cap: int, n: int) -> DataFrame:
    """The n best rows with at most cap of a group, ranked (W14, E8): the same rows as a greedy pass."""
    rows = df.withColumn("_s", score)
    inside = Window.partitionBy(group).orderBy(F.desc("_s"), *ties)
    rows = rows.withColumn("_g", F.row_number().over(inside)).filter(F.col("_g") <= cap)
    rows = rows.orderBy(F.desc("_s"), *ties).limit(n)  # n rows at most from here on
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_s"), *ties))).drop("_g", "_s")


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, item: str, budget: float) -> DataFrame:
    """Items taken in order while they fit the budget, those that don't being skipped (W15, E17): an ordered fold."""
    items = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, cost, item))).alias("_all"))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast(f"array<{dict(df.dtypes)[item]}>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x[cost] <= budget
        return F.struct(F.when(fits, s["used"] + x[cost]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(x[item]))).otherwise(s["taken"]).alias("taken"))

    return items.select(*keys, F.aggregate("_all", start, step).alias("f")).select(*keys, F.round("f.used", 4).alias("used"), F.col("f.taken").alias("taken"))


def velocity(df: DataFrame, keys: list[str], value: str, date: str, tie: str) -> DataFrame:
    """Change per day between the first and last value, and the projection 30 days on."""
    first, last = F.struct(date, tie), F.struct(date, tie)
    out = df.groupBy(*keys).agg(F.min_by(value, first).alias("_a"), F.max_by(value, last).alias("_b"), F.datediff(F.max(date), F.min(date)).alias("days"))
    speed = F.when(F.col("days") > 0, (F.col("_b") - F.col("_a")) / F.col("days")).otherwise(0.0)
    return out.select(*keys, F.col("days").cast("long").alias("days"), F.round(speed, 4).alias("velocity"), F.round(F.col("_b") + 30 * speed, 4).alias("projected"))


def duplicate_flags(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whether an equal key came before."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def sample_periods(df: DataFrame, keys: list[str], period: str = "year", count: str = "cnt") -> DataFrame:
    """Each entity's share of the first, middle and last period."""
    spine = df.select(period).distinct().withColumn("_i", F.row_number().over(Window.orderBy(period))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    wanted = spine.withColumn("which", F.when(F.col("_i") == 1, "first").when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, "middle").when(F.col("_i") == F.col("_n"), "last")).filter("which is not null")
    rows = df.join(F.broadcast(wanted.select(F.col(period).alias("_p"), "which")), F.col(period) == F.col("_p")).groupBy("which", *keys).agg(F.sum(count).alias("_c"))
    return rows.select("which", *keys, F.round(100.0 * F.col("_c") / F.sum("_c").over(Window.partitionBy("which")), 4).alias("pct"))
