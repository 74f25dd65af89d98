"""Aggregates, set operations and projections over question, mistake and trend relations; scoring and calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import sharing_pairs


def yearly_difficulty(df: DataFrame, year: str, difficulty: str, kind: str, kinds: list[str]) -> DataFrame:
    """Mean difficulty, rows, and rows of each kind per year."""
    return df.groupBy(year).agg(F.round(F.avg(difficulty), 4).alias("mean"), F.count("*").alias("n"), *[F.sum((F.col(kind) == k).cast("long")).alias(f"n_{k.lower()}") for k in kinds])


def domain_years(df: DataFrame, domain: Column, year: str) -> DataFrame:
    """Rows per domain and year; no domain is "unknown" (A7)."""
    return df.groupBy(F.coalesce(domain, F.lit("unknown")).alias("domain"), year).agg(F.count("*").alias("n"))


def topic_counts(df: DataFrame, topic: str, year: str, difficulty: Column, missing: float = 5.0) -> DataFrame:
    """Rows, years and mean difficulty per topic; a missing difficulty, or one of 0, counts as 5."""
    given = F.coalesce(F.nullif(difficulty, F.lit(0)), F.lit(missing))
    return df.groupBy(topic).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(year)), ",").alias("years"), F.round(F.avg(given), 4).alias("difficulty"))


def distributions(df: DataFrame, dimensions: dict[str, Column], confidence: Column) -> DataFrame:
    """(dimension, value, n, confidence): rows per value of each dimension in one shuffle, and the mean of confidences that are not 0."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dimensions.items()]))
    rows = df.select(each.alias("x"), F.nullif(confidence, F.lit(0)).alias("_c"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.round(F.avg("_c"), 6).alias("confidence"))


def node_statistics(df: DataFrame, nodes: dict[str, Column], year: str, difficulty: str, kind: str) -> DataFrame:
    """(type, node, n, years, difficulty, kinds) of the nodes that each row touches."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), c.cast("string").alias("node")) for k, c in nodes.items()]))
    rows = df.select(each.alias("x"), year, difficulty, kind).filter("x.node is not null")
    return rows.groupBy("x.type", "x.node").agg(
        F.count("*").alias("n"), F.countDistinct(year).alias("years"), F.round(F.avg(difficulty), 2).alias("difficulty"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds")
    )


def typed_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per pair, of the type that came first."""
    return edges.groupBy("src", "dst").agg(F.min_by("type", F.struct(*order)).alias("type"))


def recurring(mistakes: DataFrame, concepts: Column, domain: str, date: str, example: str, least: int = 2, k: int = 20) -> DataFrame:
    """Concepts met at least twice: times, share of the mistakes, domains, first and last date, three examples; the most frequent."""
    total = mistakes.agg(F.count("*").alias("_all"))
    rows = mistakes.select(F.explode(concepts).alias("concept"), domain, date, example)
    out = rows.groupBy("concept").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set(domain)), ",").alias("domains"),
        F.min(date).alias("first"),
        F.max(date).alias("last"),
        F.array_join(F.slice(F.array_sort(F.collect_set(F.col(example).cast("string"))), 1, 3), ",").alias("examples"),
    )
    out = out.filter(F.col("n") >= least).join(F.broadcast(total))  # one row
    return out.withColumn("share", F.round(F.col("n") / F.greatest("_all", F.lit(1)), 6)).drop("_all").orderBy(F.desc("n"), "concept").limit(k)


def recurring_by(mistakes: DataFrame, key: Column, kind: str, number: str) -> DataFrame:
    """Mistakes per key: share in per cent, the dominant kind (first by name of equals), different question numbers."""
    counts = mistakes.groupBy(F.coalesce(key, F.lit("unknown")).alias("key"), kind).agg(F.count("*").alias("n"), F.collect_set(number).alias("_q"))
    out = counts.groupBy("key").agg(F.sum("n").alias("total"), F.max_by(kind, F.struct("n", -F.ascii(kind))).alias("dominant"), F.size(F.array_distinct(F.flatten(F.collect_list("_q")))).cast("long").alias("questions"))
    return out.select("key", F.col("total").alias("n"), F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))), 4).alias("pct"), "dominant", "questions")


def failure_patterns(mistakes: DataFrame, patterns: dict[str, tuple[Column, int]], topic: str, exam: str) -> DataFrame:
    """(pattern, label, n): patterns with enough mistakes, and topics mistaken in two exams or more."""
    one = mistakes.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, (c, _) in patterns.items()])
    told = F.array_compact(F.array(*[F.when(F.col(k) >= least, F.struct(F.lit(k).alias("pattern"), F.lit("").alias("label"), F.col(k).alias("n"))) for k, (_, least) in patterns.items()]))
    gaps = mistakes.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("n"), F.countDistinct(exam).alias("_exams")).filter("_exams >= 2")
    return one.select(F.explode(told).alias("x")).select("x.*").union(gaps.select(F.lit("knowledge_gap"), F.col(topic).cast("string"), "n"))


def document_rollup(pages: DataFrame, document: str, quality: Column, low: float) -> DataFrame:
    """Means per document, and over all: the mean of the documents' means, the worst, and documents below a floor."""
    each = pages.groupBy(document).agg(F.count("*").alias("n"), F.avg(quality).alias("q"))
    return each.agg(F.count("*").alias("documents"), F.sum("n").alias("rows"), F.round(F.avg("q"), 6).alias("mean_of_means"), F.round(F.min("q"), 6).alias("worst"), F.sum((F.col("q") < low).cast("long")).alias("low"))


def separation_quality(items: DataFrame, exam: str, number: str) -> DataFrame:
    """Share of expected numbers that are there once, weighted by the exams' items over all: gaps and repeats lower it."""
    each = items.groupBy(exam).agg(F.count("*").alias("n"), F.countDistinct(number).alias("_kinds"), F.max(number).alias("_most"))
    score = F.greatest(F.lit(0.0), (F.col("_kinds") - (F.col("n") - F.col("_kinds"))) / F.greatest("_most", F.lit(1)))
    return each.agg(F.count("*").alias("exams"), F.sum("n").alias("items"), F.round(F.sum(score * F.col("n")) / F.sum("n"), 6).alias("quality"), F.sum((F.col("_most") > F.col("_kinds")).cast("long")).alias("with_gaps"))


def daily_completions(done: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """(day, n) for each of the last days, 0 where nothing was done."""
    spine = done.sparkSession.range(days).select(F.date_sub(F.to_date(F.lit(as_of)), F.col("id").cast("int")).alias("day"))
    counts = done.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("_n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("_n", F.lit(0)).alias("n"))


def kind_trend(df: DataFrame, year: str, kind: str, kinds: list[str]) -> DataFrame:
    """(kind, early, late, pct): means per year in the first and the second half of the years, and the share of all."""
    each = df.groupBy(year).agg(*[F.sum((F.col(kind) == k).cast("long")).alias(k) for k in kinds])
    rows = each.select(year, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")).select(year, "x.*")
    over = Window.partitionBy("kind")
    rows = rows.withColumn("_late", F.row_number().over(over.orderBy(year)) > F.floor(F.count("*").over(over) / 2))
    out = rows.groupBy("kind").agg(F.round(F.avg(F.when(~F.col("_late"), F.col("n"))), 4).alias("early"), F.round(F.avg(F.when(F.col("_late"), F.col("n"))), 4).alias("late"), F.sum("n").alias("_n"))
    return out.select("kind", "early", "late", F.round(100.0 * F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1))), 4).alias("pct"))


def distinct_counts(df: DataFrame, **columns: str) -> DataFrame:
    """Numbers of different values, exactly."""
    return df.agg(*[F.countDistinct(c).alias(k) for k, c in columns.items()])


def shared_years(matrix: DataFrame, group: str, item: str, year: str, least: int) -> DataFrame:
    """(group, a, b, years): pairs of items that share so many years."""
    rows = matrix.select(group, item, year).distinct()
    return sharing_pairs(rows, year, item, least, [group]).select(group, "a", "b", F.col("together").alias("years"))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def combined_history(exams: DataFrame, workbook: DataFrame, score: str, factor: float = 0.95) -> DataFrame:
    """Exam and workbook scores together, workbook scores times a factor."""
    own = exams.withColumn("kind", F.lit("exam"))
    return own.unionByName(workbook.withColumn(score, F.col(score) * factor).withColumn("kind", F.lit("workbook")))


def ranked(df: DataFrame, score: str, index: str) -> DataFrame:
    """Ranks by falling score, of equals the later index first (T4)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), F.desc(index))))


def normalised(df: DataFrame, given: dict[str, list[str]], flags: dict[str, Column]) -> DataFrame:
    """A wide projection: each column from the first of its sources that has a value, and derived flags."""
    return df.select(*[F.coalesce(*[F.col(c) for c in sources]).alias(k) for k, sources in given.items()], *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])


def to_review(df: DataFrame, decided: DataFrame, keys: list[str], confidence: str, quality: Column, least: float = 0.6, floor: float = 0.55) -> DataFrame:
    """Rows without a decision, with why they wait: low confidence, low quality, or neither (F8)."""
    rows = df.join(decided.select(*keys).distinct(), keys, "left_anti")
    return rows.withColumn("why", F.when(F.col(confidence) < least, "confidence").when(quality < floor, "quality").otherwise("pending"))


def subject_rows(df: DataFrame, subject: Column, wanted: str, text: str, least: int = 2) -> DataFrame:
    """Rows of a subject with a text of two characters at least (IO7)."""
    return df.filter((subject == wanted) & (F.length(text) >= least))


def equated(raw: Column, most: float, difficulty: Column) -> Column:
    """Raw score to equated score: high scores give less in easy exams, low ones more in hard exams (M8)."""
    ratio = raw / most
    curve = F.when(difficulty == "easy", most * (ratio * 0.92 + ratio * ratio * 0.08)).when(difficulty == "hard", most * (ratio * 1.08 - ratio * ratio * 0.08)).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.floor(curve + 0.5)))


#: Rates of right answers up to which a deduction shrinks, and to what part (fixed values).
DEDUCTIONS = ((0.30, 0.50), (0.50, 0.75), (0.70, 0.90))


def deducted(base: Column, rate: Column) -> Column:
    """A deduction, less of it where few got the item right; whole without a rate (M9)."""
    out = base
    for most, part in reversed(DEDUCTIONS):
        out = F.when(rate <= most, base * part).otherwise(out)
    return out


def months_between(a: Column, b: Column) -> Column:
    """Whole calendar months from a to b."""
    return F.year(b) * 12 + F.month(b) - F.year(a) * 12 - F.month(a)


def days_until(now: Column, then: Column) -> Column:
    """Days left, begun ones whole."""
    return F.ceil((F.unix_timestamp(then) - F.unix_timestamp(now)) / 86400)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hashed key: the same ones each time."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def scaled(raw: Column, of: Column, most: float) -> Column:
    """A raw score out of ``of`` on a scale up to most, halves upwards."""
    return F.floor(raw * most / of + 0.5)


def platt(df: DataFrame, score: str, label: Column, rounds: int = 30, tolerance: float = 1e-9) -> tuple[float, float]:
    """(slope, intercept) of 1 / (1 + exp(-(slope x score + intercept))), with softened targets (M7): Newton's method, one sum over the rows a round."""
    rows = df.select(F.col(score).cast("double").alias("x"), label.cast("int").alias("y")).filter("x is not null and y is not null")
    right, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    high, low = (right + 1) / (right + 2), 1 / (n - right + 2)
    a, b = 0.0, math.log((right + 1) / (n - right + 1))
    t = F.when(F.col("y") == 1, high).otherwise(low)
    before = math.inf
    for _ in range(rounds):
        z = F.col("x") * a + b
        p = 1 / (1 + F.exp(-z))
        loss = -(t * F.log(F.greatest(p, F.lit(1e-300))) + (1 - t) * F.log(F.greatest(1 - p, F.lit(1e-300))))
        w, d = p * (1 - p), t - p
        ga, gb, haa, hab, hbb, now = rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (d * F.col("x"), d, w * F.col("x") * F.col("x"), w * F.col("x"), w, loss)]).first()
        if before - now < tolerance:
            break
        before = now
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        if not det:
            break
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return a, b


def domain_forecast(matrix: DataFrame, growth: Column | None = None) -> DataFrame:
    """Next year's count per domain: weights from 0.5 to 1.5 over the years, adjusted by the trend, with bounds of a deviation.

    matrix: (domain, year, n), a row for every year that any domain has counts as 0 where it is missing.
    """
    years = matrix.select("year").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("year")) - 1)
    rows = matrix.select("domain").distinct().join(F.broadcast(years)).join(matrix, ["domain", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    last = F.max("_i").over(Window.partitionBy("domain"))
    rows = rows.withColumn("_w", 0.5 + F.col("_i") / F.greatest(F.lit(1), last)).withColumn("_late", F.col("_i") > last / 2)
    out = rows.groupBy("domain").agg(
        (F.sum(F.col("n") * F.col("_w")) / F.count("*")).alias("prior"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"),
        F.avg(F.when(F.col("_late"), F.col("n"))).alias("_b"), F.avg(F.when(~F.col("_late"), F.col("n"))).alias("_a"),
    )
    change = growth if growth is not None else F.when(F.col("_a") > 0, 100.0 * (F.col("_b") - F.col("_a")) / F.col("_a")).otherwise(0.0)
    out = out.withColumn("posterior", F.col("prior") * (1 + change / 100 * 0.3))
    sure = F.greatest(F.lit(0.3), F.least(F.lit(0.95), 1 - 0.5 * F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(1.0)))
    return out.select("domain", F.round("prior", 4).alias("prior"), F.round("posterior", 4).alias("posterior"), F.round(sure, 4).alias("confidence"), F.round(F.greatest(F.lit(0.0), F.col("posterior") - F.col("sd")), 4).alias("low"), F.round(F.col("posterior") + F.col("sd"), 4).alias("high"))


def momentum_forecast(matrix: DataFrame, keys: list[str], last: int) -> DataFrame:
    """0.30 momentum, 0.25 recency, 0.15 streak, 0.15 growth, 0.15 balance (50), each 0 to 100 (P18). matrix: (keys, year, cnt)."""
    streak = Window.partitionBy(*keys).orderBy(F.desc("year"))
    rows = matrix.filter(F.col("year") <= last).withColumn("_run", F.col("year") + F.row_number().over(streak) == last + 1)
    between = lambda a, b: F.coalesce(F.sum(F.when(F.col("year").between(a, b), F.col("cnt"))), F.lit(0))
    out = rows.groupBy(*keys).agg(between(last - 4, last).alias("r5"), between(last - 2, last).alias("r3"), between(last, last).alias("r1"), between(last - 9, last - 5).alias("p5"), F.sum(F.col("_run").cast("int")).alias("run"))
    momentum = 100.0 * F.col("r3") / F.greatest("r5", F.lit(1))
    growth = F.when(F.col("p5") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.col("r5") - F.col("p5")) / F.col("p5")))).otherwise(0.0)
    score = 0.30 * momentum + 0.25 * F.least(F.lit(100), F.col("r1") * 25) + 0.15 * F.least(F.lit(100), F.col("run") * 10) + 0.15 * growth + 0.15 * 50
    return out.select(*keys, F.round(score, 4).alias("score"))


def factor_forecast(matrix: DataFrame, difficulty: DataFrame, target: int, first: int, share: float) -> DataFrame:
    """0.40 recent five years, 0.20 gap, 0.15 domain balance, 0.10 difficulty, 0.15 rotation, in per cent from 1 to 99.

    matrix: (domain, topic, year, cnt) before the target; difficulty: (domain, topic, difficulty); share: a domain's due share.
    """
    rows = matrix.filter((F.col("year") < target) & (F.col("year") >= first) & (F.col("cnt") > 0))
    keys, w = ["domain", "topic"], Window.partitionBy("domain", "topic")
    rows = rows.withColumn("_step", F.col("year") - F.lag("year").over(w.orderBy("year"))).withColumn("_run", F.col("year") + F.row_number().over(w.orderBy(F.desc("year"))) == target)
    recent = F.coalesce(F.sum(F.when(F.col("year") >= target - 5, F.col("cnt") * (F.col("year") - (target - 6)))), F.lit(0))
    out = rows.groupBy(*keys).agg(recent.alias("w"), F.max("year").alias("last"), F.count("*").alias("active"), F.avg("_step").alias("step"), F.sum(F.col("_run").cast("int")).alias("run"))
    domain = rows.filter(F.col("year") >= target - 5).groupBy("domain").agg(F.sum("cnt").alias("_d"))
    domain = domain.withColumn("part", F.col("_d") / F.sum("_d").over(Window.partitionBy(F.lit(1)))).drop("_d")
    out = out.join(domain, "domain", "left").join(difficulty, keys, "left")
    gap = F.lit(target - 1) - F.col("last")
    by_gap = F.when(gap == 0, F.when(F.col("run") > 5, 0.3).otherwise(0.6)).when(gap <= 2, 0.8).when(gap <= 5, 0.6).otherwise(0.2)
    balance = F.greatest(F.lit(0.2), F.least(F.lit(1.0), 0.5 - 2 * (F.coalesce("part", F.lit(0.0)) - share)))
    hard = F.coalesce("difficulty", F.lit(-1.0))
    by_difficulty = F.when(hard < 0, 0.5).when(hard < 30, 0.6).when(hard <= 60, 0.8).when(hard <= 75, 0.5).otherwise(0.3)
    step = F.round("step", 9)
    turn = F.when(F.col("active") < 2, 0.3).when(F.abs(target - F.col("last") - step) <= 1, 0.9).when(gap >= F.floor(step), 0.7).when(gap >= F.floor(step * 0.7), 0.5).otherwise(0.3)
    by_turn = F.when(F.col("active") < 5, 0.4).otherwise(turn)
    score = 100 * (0.40 * F.least(F.lit(1.0), F.col("w") / 15 / 5) + 0.20 * by_gap + 0.15 * balance + 0.10 * by_difficulty + 0.15 * by_turn)
    return out.select(*keys, F.round(score, 4).alias("score"), F.greatest(F.lit(1.0), F.least(F.lit(99.0), F.floor(F.round(score, 6) + 0.5))).alias("pct"))


def moved(matrix: DataFrame, keys: list[str], last: int, by: float = 10.0, k: int = 10) -> DataFrame:
    """The k that rose and fell most by the last five years against the five before, beyond a change in per cent (V6)."""
    between = lambda a, b: F.coalesce(F.sum(F.when(F.col("year").between(a, b), F.col("cnt"))), F.lit(0))
    out = matrix.groupBy(*keys).agg(between(last - 4, last).alias("now"), between(last - 9, last - 5).alias("then")).filter("then > 0")
    out = out.withColumn("change", F.round(100.0 * (F.col("now") - F.col("then")) / F.col("then"), 4)).filter(F.abs("change") > by)
    out = out.withColumn("direction", F.when(F.col("change") > 0, "rising").otherwise("falling"))
    w = Window.partitionBy("direction").orderBy(F.desc(F.abs("change")), *keys)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def concentration(matrix: DataFrame, group: str, item: str, k: int = 10) -> DataFrame:
    """Means of the first and last five years, and the share in per cent of the k largest items, per group (V7)."""
    years = matrix.groupBy(group, "year").agg(F.sum("cnt").alias("n"))
    w = Window.partitionBy(group)
    years = years.withColumn("_i", F.row_number().over(w.orderBy("year"))).withColumn("_j", F.row_number().over(w.orderBy(F.desc("year"))))
    ends = years.groupBy(group).agg(F.round(F.avg(F.when(F.col("_i") <= 5, F.col("n"))), 4).alias("first"), F.round(F.avg(F.when(F.col("_j") <= 5, F.col("n"))), 4).alias("last"))
    items = matrix.groupBy(group, item).agg(F.sum("cnt").alias("n")).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), item)))
    share = items.groupBy(group).agg(F.round(100.0 * F.sum(F.when(F.col("_r") <= k, F.col("n"))) / F.sum("n"), 4).alias("top_pct"))
    return ends.join(share, group)


def lexicon_nearest(docs: DataFrame, key: str, text: str, lexicon: list[str], query_id, least: float = 0.3, k: int = 5) -> DataFrame:
    """Nearest texts by cosine of the counts of a lexicon's words, from a floor."""
    words = F.split(F.lower(text), r"[\s,，.．、。()（）「」【】]+")
    rows = docs.select(key, F.transform(F.array(*map(F.lit, lexicon)), lambda t: F.size(F.filter(words, lambda w: w == t)).cast("double")).alias("_v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    asked = rows.filter(F.col(key) == query_id).select(F.col("_v").alias("_q")).limit(1)
    rows = rows.filter(F.col(key) != query_id).join(F.broadcast(asked))  # one row
    size = F.sqrt(dot(F.col("_v"), F.col("_v")) * dot(F.col("_q"), F.col("_q")))
    rows = rows.select(key, F.round(F.when(size > 0, dot(F.col("_v"), F.col("_q")) / size).otherwise(0.0), 6).alias("similarity"))
    return rows.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(k)


def chains(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, path) of prerequisite chains from the start nodes, a step per hop, no node twice."""
    step = edges.select("src", "dst").distinct()
    found = now = start.select("node", F.array(F.col("node").cast("string")).alias("path"))
    for _ in range(depth):
        onward = now.join(step, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst").cast("string")))
        now = onward.select(F.col("dst").alias("node"), F.concat("path", F.array(F.col("dst").cast("string"))).alias("path"))
        found = found.union(now)
    return found.select("node", F.array_join("path", ">").alias("path"))
