"""Difficulty of questions and its audit, learners' tracked mastery and recommendations, the bundle behind a wrong
answer, the dashboard's tables, and rule classifiers over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.student import retention

#: Fixed weights of the six difficulty factors, and of the six recommendation factors.
DIFFICULTY = {"base": 0.30, "rarity": 0.20, "material": 0.15, "choices": 0.10, "length": 0.10, "period": 0.15}
RECOMMENDED = {"gain": 0.40, "probability": 0.20, "severity": 0.15, "match": 0.10, "centrality": 0.10, "efficiency": 0.05}


def _clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def item_difficulty(questions: DataFrame, keys: list[str], topic: str, base: Column, material: Column, choices: Column, length: Column, year: Column, first: int, span: int) -> DataFrame:
    """Six factors of 0 to 1, their score of 1 to 100 (halves to even) and its category.

    Rare topics are hard: 1 - rows / (all rows / 20); no topic counts 0.5. ``base`` is a level of 1 to 5; ``material`` the
    complexity of what a question shows; years count from ``first`` over ``span``. What is missing counts as level 3, no
    material, four choices, 100 characters and the middle of the span.
    """
    base, material, choices = F.coalesce(base, F.lit(3)), F.coalesce(material, F.lit(0.0)), F.coalesce(choices, F.lit(4))
    length, year = F.coalesce(length, F.lit(100)), F.coalesce(year, F.lit(first + span // 2))
    n = questions.agg(F.greatest(F.count("*") / 20, F.lit(1.0)).alias("_n"))
    seen = questions.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("_f")).join(F.broadcast(n))  # one row
    rarity = seen.select(topic, _clip(1 - F.col("_f") / F.col("_n")).alias("_rarity"))
    factors = {
        "base": (base - 1) / 4.0,
        "rarity": F.coalesce("_rarity", F.lit(0.5)),
        "material": material,
        "choices": F.least(F.lit(1.0), (choices - 2) / 6.0),
        "length": F.least(F.lit(1.0), length / 500.0),
        "period": (year - first) / float(span),
    }
    rows = questions.join(rarity, topic, "left").select(*keys, topic, *[c.cast("double").alias(k) for k, c in factors.items()])
    raw = sum((F.col(k) * w for k, w in DIFFICULTY.items()), F.lit(0.0))
    rows = rows.withColumn("score", _clip(F.bround(F.round(raw * 100, 9)), 1, 100).cast("int"))
    level = F.when(F.col("score") <= 30, "easy").when(F.col("score") <= 60, "medium").when(F.col("score") <= 80, "hard").otherwise("expert")
    return rows.select(*keys, topic, *[F.round(k, 3).alias(k) for k in DIFFICULTY], "score", level.alias("category"))


def difficulty_audit(rated: DataFrame, topic: str, gold: DataFrame, keys: list[str], rare: int = 10, common: int = 30) -> DataFrame:
    """(check, level, n, value) of rated questions: mean score of rare and common topics, the correlation of score and
    topic frequency, scores far from their factors' mean, the categories' shares, and the mean score per gold level (V23)."""
    frequency = rated.groupBy(topic).agg(F.count("*").alias("_f"))
    rows = rated.join(frequency, topic)
    mean = sum((F.col(k) for k in DIFFICULTY), F.lit(0.0)) * 100 / 6
    far = (F.abs(mean - F.col("score")) > 25) & (F.col("score") > 10)
    one = rows.agg(
        F.count(F.when(F.col("_f") < rare, 1)).alias("rn"), F.avg(F.when(F.col("_f") < rare, F.col("score"))).alias("rv"),
        F.count(F.when(F.col("_f") >= common, 1)).alias("cn"), F.avg(F.when(F.col("_f") >= common, F.col("score"))).alias("cv"),
        F.count("*").alias("n"), F.corr(F.col("score").cast("double"), F.col("_f").cast("double")).alias("r"), F.count(F.when(far, 1)).alias("far"),
    )
    line = lambda check, n, value: F.struct(F.lit(check).alias("check"), F.lit("").alias("level"), F.col(n).alias("n"), F.round(value, 4).alias("value"))
    whole = one.select(F.explode(F.array(line("rare_topics", "rn", F.coalesce("rv", F.lit(0.0))), line("common_topics", "cn", F.coalesce("cv", F.lit(0.0))), line("correlation", "n", F.col("r")), line("factors_differ", "far", F.col("far") / F.col("n")))).alias("x")).select("x.*")
    shares = rated.groupBy("category").agg(F.count("*").alias("n")).select(F.lit("distribution"), "category", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))
    levels = rated.join(gold, keys).groupBy(F.col("gold").cast("string").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("v")).select(F.lit("gold"), "level", "n", "v")
    return whole.union(shares).union(levels)


def recommended(topics: DataFrame, keys: list[str], domain: str, topic: str, ability: Column, days: int = 180, hours: float = 10.0, points: float = 90.0, per_domain: int = 6, k: int = 20) -> DataFrame:
    """Six factors, their score of 0 to 100, and the k best per learner with at most ``per_domain`` of one domain.

    ``topics``: a row per learner and topic with mastery, frequency, probability, difficulty and centrality, each of 0 to 1.
    A topic a little (0.15) above the learner's ability is the best match. Missing: mastery and difficulty count 0.5,
    frequency 0.3, probability as frequency, centrality 0.
    """
    for name, default in (("mastery", F.lit(0.5)), ("difficulty", F.lit(0.5)), ("frequency", F.lit(0.3)), ("probability", F.col("frequency")), ("centrality", F.lit(0.0))):
        topics = topics.withColumn(name, F.coalesce(F.col(name), default))
    lack = 1 - F.col("mastery")
    need = 2.0 + F.col("difficulty") * 6.0
    there = days / 7.0 * hours * 0.5
    factors = {
        "gain": F.least(F.lit(1.0), F.greatest(F.lit(0.0), points * F.col("frequency") * 0.08 * lack) / 15.0),
        "probability": F.least(F.lit(1.0), F.col("probability")),
        "severity": F.when(F.col("mastery") >= 0.8, 0.1).when(F.col("mastery") >= 0.6, 0.3).when(F.col("mastery") >= 0.4, 0.6).when(F.col("mastery") >= 0.2, 0.8).otherwise(1.0),
        "match": F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("difficulty") - ability - 0.15) * 2.0),
        "centrality": F.col("centrality"),
        "efficiency": F.least(F.lit(1.0), lack / F.greatest(F.lit(1.0), need) * 5.0 * F.when(need > there, F.greatest(F.lit(0.1), there / need)).otherwise(1.0)),
    }
    score = sum((c * RECOMMENDED[f] for f, c in factors.items()), F.lit(0.0))
    rows = topics.select(*keys, domain, topic, F.round(score * 100, 2).alias("score"))
    order = [F.desc("score"), F.asc(domain), F.asc(topic)]
    rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy(*keys, domain).orderBy(*order))).filter(F.col("_d") <= per_domain)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k).drop("_d")


def with_prerequisites(attempts: DataFrame, prerequisites: DataFrame, topic: str) -> DataFrame:
    """Attempts, and each again as an attempt at what its topic directly needs; prerequisites (topic, needs)."""
    also = attempts.join(prerequisites.select(F.col("topic").alias(topic), "needs").distinct(), topic).withColumn(topic, F.col("needs")).drop("needs")
    return attempts.unionByName(also)


def tracked_mastery(attempts: DataFrame, keys: list[str], order: list[str], start: float = 0.3, learn: float = 0.15, guess: float = 0.2, slip: float = 0.1) -> DataFrame:
    """0.6 of a Beta posterior and 0.4 of knowledge tracing, folded over a learner's attempts in order.

    An attempt weighs 1 + (1 - retention since the one before): what was nearly forgotten tells more. Retention is by
    ``student.retention``, with 1 + the right answers so far as strength; the first of ``order`` is the time.
    """
    rows = attempts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "correct"))).alias("_a"))
    at = order[0]
    state = F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(start).alias("p"), F.lit(0.0).alias("right"), F.lit(None).cast(dict(attempts.dtypes)[at]).alias("at"))

    def step(s: Column, x: Column) -> Column:
        days = F.datediff(F.to_date(x[at]), F.to_date(s["at"])).cast("double")
        weight = F.when(s["at"].isNull(), 1.0).otherwise(2.0 - retention(days, 1.0 + s["right"]))
        right = s["p"] * (1 - slip) / (s["p"] * (1 - slip) + (1 - s["p"]) * guess)
        wrong = s["p"] * slip / (s["p"] * slip + (1 - s["p"]) * (1 - guess))
        known = F.when(x["correct"], right).otherwise(wrong)
        return F.struct(
            (s["a"] + F.when(x["correct"], weight).otherwise(0.0)).alias("a"),
            (s["b"] + F.when(x["correct"], 0.0).otherwise(weight)).alias("b"),
            (known + (1 - known) * learn).alias("p"),
            (s["right"] + x["correct"].cast("double")).alias("right"),
            x[at].alias("at"),
        )

    out = rows.select(*keys, F.size("_a").cast("long").alias("n"), F.aggregate("_a", state, step).alias("s"))
    a, b = F.col("s.a"), F.col("s.b")
    sd = F.sqrt(a * b / (F.pow(a + b, F.lit(2.0)) * (a + b + 1)))
    return out.select(*keys, "n", F.round(0.6 * a / (a + b) + 0.4 * F.col("s.p"), 6).alias("mastery"), F.round(_clip(1 - 2 * sd), 6).alias("confidence"))


def node_mastery(attempts: DataFrame, keys: list[str], order: list[str], as_of: str) -> DataFrame:
    """Accuracy, mastery (0.6 accuracy, up to 0.2 for attempts and for recency each), retention, status, and the last five answers."""
    last = F.sort_array(F.collect_list(F.struct(*order, F.col("correct").cast("int").alias("c"))), asc=False)
    out = attempts.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("_acc"), F.max(order[0]).alias("_last"), F.reverse(F.transform(F.slice(last, 1, 5), lambda s: s["c"])).alias("_five"))
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("_last"))
    fresh = F.coalesce(F.greatest(F.lit(0.0), 0.2 - days / 365 * 0.2), F.lit(0.0))
    mastery = F.round(F.least(F.lit(1.0), F.col("_acc") * 0.6 + F.least(F.lit(0.2), F.col("n") * 0.04) + fresh), 3)
    status = F.when(F.col("_acc") >= 0.8, "mastered").when(F.col("_acc") >= 0.5, "learning").otherwise("weak")
    return out.select(*keys, "n", F.round("_acc", 6).alias("accuracy"), mastery.alias("mastery"), F.round(mastery * 0.8, 3).alias("retention"), status.alias("status"), F.array_join("_five", "").alias("last_five"))


def topic_importance(records: DataFrame, predicted: DataFrame, keys: list[str], span: int = 24) -> DataFrame:
    """Frequency, recency and consistency of a topic, and three parts of a forecast among ten where there is one.

    ``records``: total, active and recent5 per topic; ``predicted``: probability of 0 to 1, also of topics without record.
    """
    recency = F.col("recent5") / F.greatest("active", F.lit(1))
    own = F.round(F.least(F.lit(1.0), F.col("total") / 100) * 0.4 + F.least(F.lit(1.0), recency / 5) * 0.35 + F.least(F.lit(1.0), F.col("active") / span) * 0.25 + 1e-9, 3)  # halves up, whatever their sum's last bit
    rows = records.select(*keys, own.alias("_own")).join(predicted.select(*keys, "probability"), keys, "full")
    both = F.when(F.col("_own").isNull(), F.col("probability")).when(F.col("probability").isNull(), F.col("_own")).otherwise(F.col("_own") * 0.7 + F.col("probability") * 0.3)
    return rows.select(*keys, F.round(both + 1e-9, 3).alias("importance"))


def wrong_answer_bundle(wrong: DataFrame, keys: list[str], weakness: DataFrame, records: DataFrame, difficulty: DataFrame, predicted: DataFrame, span: int = 24) -> DataFrame:
    """What is known of the topic of each wrong answer, the best source first, and its learning priority A to E.

    Joined on ``keys``: weakness (weakness), records (total, recent5), difficulty (difficulty), predicted (probability in
    per cent). A topic that is not among the predicted takes a chance from its record, one without record 30.
    """
    rows = wrong.join(weakness, keys, "left").join(records, keys, "left").join(difficulty, keys, "left").join(predicted, keys, "left")
    seen = F.round(F.least(F.lit(60.0), F.col("total") / span * 10) + F.col("recent5") / F.greatest("total", F.lit(1)) * 30)
    chance = F.coalesce(F.col("probability").cast("double"), F.when(seen.isNotNull(), F.least(F.lit(95.0), seen)), F.lit(30.0))
    source = F.when(F.col("probability").isNotNull(), "prediction").when(F.col("total").isNotNull(), "record").otherwise("default")
    hard = F.coalesce(F.nullif("difficulty", F.lit(0)).cast("double"), F.lit(40.0))
    score = F.coalesce("weakness", F.lit(0.0)) * 40 + F.least(F.lit(25.0), F.coalesce("total", F.lit(0)) / span * 5) + chance / 100 * 25 + F.when((hard >= 30) & (hard <= 60), 10).when(hard > 60, 5).otherwise(8)
    score = F.least(F.lit(100.0), F.round(F.round(score, 9)))
    label = F.when(hard >= 70, "very hard").when(hard >= 55, "hard").when(hard >= 40, "medium").when(hard >= 25, "easy").otherwise("very easy")
    grade = F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").when(score >= 20, "D").otherwise("E")
    return rows.select(*wrong.columns, F.round(chance, 4).alias("chance"), source.alias("source"), label.alias("difficulty_label"), score.cast("int").alias("priority"), grade.alias("grade"))


def legacy_record(matrix: DataFrame, last: int, first: int) -> DataFrame:
    """A topic's totals, spans, gap, trailing run of periods up to its last, growth of the last five periods over all older ones in per cent, and a category by 20 %.

    Placeholders ("untopicized") are left to the caller's filter; the run and averages count periods from first to last.
    """
    keys = ["domain", "topic"]
    within = lambda n: F.sum(F.when(F.col("year") > last - n, F.col("cnt")).otherwise(0))
    out = matrix.filter("cnt > 0").groupBy(*keys).agg(F.sum("cnt").alias("total"), F.count("*").alias("active"), F.min("year").alias("first"), F.max("year").alias("last"), within(3).alias("recent3"), within(5).alias("recent5"), F.array_sort(F.collect_list("year")).alias("_y"))
    older = F.col("total") - F.col("recent5")
    # years less their position are equal within a run
    run = F.transform("_y", lambda y, i: y - i)
    out = out.withColumn("streak", F.size(F.filter(run, lambda x: x == F.element_at(run, -1))).cast("long")).withColumn("gap", last - F.col("last"))
    out = out.withColumn("growth", F.round((F.col("recent5") - older) / F.greatest(older, F.lit(1)) * 100, 1))
    kind = F.when(F.col("first") >= last - 3, "emerging").when((F.col("gap") >= 5) & (F.col("total") >= 2), "disappearing").when(F.col("total") < 3, "rare").when(F.col("growth") > 20, "growing").when(F.col("growth") < -20, "declining").otherwise("stable")
    return out.select(*keys, "total", "active", "gap", "streak", "recent3", "recent5", "growth", F.round(F.col("recent5") / 5, 2).alias("recent_mean"), F.round(older / max(last - 4 - first, 1), 2).alias("older_mean"), kind.alias("category"))


def dashboard_years(matrix: DataFrame, domains: list[str]) -> DataFrame:
    """A row per period: the counts of each domain and in all (V9)."""
    out = matrix.groupBy("year").agg(*[F.sum(F.when(F.col("domain") == d, F.col("cnt")).otherwise(0)).alias(d) for d in domains])
    return out.withColumn("total", sum((F.col(d) for d in domains), F.lit(0)).cast("long"))


def dashboard_topics(records: DataFrame, most: int = 20, best: int = 100) -> DataFrame:
    """(board, rank, domain, topic, value, priority): the largest topics, the most risen and fallen, and the longest absent with priority A, B or C by total (V9)."""

    def board(name: str, rows: DataFrame, value: Column, descending: bool, n: int) -> DataFrame:
        order = [F.desc("value") if descending else F.asc("value"), F.desc("total"), F.asc("domain"), F.asc("topic")]
        rows = rows.withColumn("value", value.cast("double")).orderBy(*order).limit(n)
        grade = F.when(F.col("total") >= 10, "A").when(F.col("total") >= 5, "B").otherwise("C") if name == "gap" else F.lit(None).cast("string")
        rank = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))  # at most n rows
        return rows.select(F.lit(name).alias("board"), rank.alias("rank"), "domain", "topic", "value", grade.alias("priority"))

    return (
        board("largest", records, F.col("total"), True, best)
        .union(board("rising", records.filter("category = 'growing'"), F.col("growth"), True, most))
        .union(board("falling", records.filter("category = 'declining'"), F.col("growth"), False, most))
        .union(board("gap", records.filter("gap >= 3 and total >= 2"), F.col("gap"), True, most))
    )


def indicator_class(text: Column, indicators: dict[str, tuple[dict[str, int], int]]) -> tuple[Column, Column]:
    """The domain of the largest sum of weights of words found, the first of equals, if it reaches that domain's least; else "unknown" and 0."""
    sums = [(d, sum((F.when(F.contains(text, F.lit(w)), n).otherwise(0) for w, n in words.items()), F.lit(0)), least) for d, (words, least) in indicators.items()]
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d"), F.lit(least).alias("least")) for i, (d, s, least) in enumerate(sums)]))
    sure = (best["s"] > 0) & (best["s"] >= best["least"])
    return F.coalesce(F.when(sure, best["d"]), F.lit("unknown")), F.coalesce(F.when(sure, best["s"]), F.lit(0))


def learned_keywords(labelled: DataFrame, label: str, text: Column, least: int = 2) -> DataFrame:
    """(word, label, n): how often each word comes with each label."""
    words = F.filter(F.split(text, r"[ ()·]+"), lambda w: F.length(w) >= least)
    return labelled.filter(F.col(label).isNotNull()).select(label, F.explode(words).alias("word")).groupBy("word", label).agg(F.count("*").alias("n"))


def reclassified(questions: DataFrame, key: str, words: Column, keywords: DataFrame, label: str, patterns: dict[str, Column], choices: dict[str, Column], least: float = 3.0, margin: float = 0.3) -> DataFrame:
    """Three signals per label, weighing 3 (pattern hits, two points each), 1.5 (learned words) and 1 (pattern hits in choices);
    the best label is taken from ``least`` on if it leads by ``margin`` of itself (V16).

    ``words`` is a question's distinct words: words meet by equality, so the join needs no pass over every keyword.
    """
    learned = questions.select(key, F.explode(words).alias("word")).join(keywords, "word").groupBy(key, label).agg((1.5 * F.sum("n")).alias("s"))
    told = F.array(*[F.struct(F.lit(d).alias("l"), (F.lit(3.0) * 2 * patterns[d] + 2 * choices.get(d, F.lit(0))).alias("s")) for d in patterns])
    direct = questions.select(key, F.explode(told).alias("x")).select(key, F.col("x.l").alias(label), F.col("x.s").alias("s")).filter("s > 0")
    sums = learned.union(direct).groupBy(key, label).agg(F.sum("s").alias("s"))
    w = Window.partitionBy(key).orderBy(F.desc("s"), label)
    rows = sums.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("s").over(w), F.lit(0.0))).filter("_r = 1")
    taken = (F.col("s") >= least) & ((F.col("s") - F.col("_next")) / F.greatest("s", F.lit(1.0)) >= margin)
    return rows.filter(taken).select(key, label, F.round("s", 2).alias("score"), F.round(F.col("s") / (F.col("s") + F.col("_next") + 0.01), 3).alias("confidence"))


def prefix_similarity(tokens: Column, keywords: list[str]) -> Column:
    """Cosine of a text's hits on a category's keywords and the keywords' weights, the first weighing most.

    A token hits a keyword that it contains or that contains it (1), and one with the same first two letters (0.5), if both
    have over two. Texts without tokens score 0; no token is ever made up.
    """

    def hit(k: str) -> Column:
        def met(s: Column, t: Column) -> Column:
            near = (F.length(t) > 2) & F.lit(len(k) > 2) & (F.left(t, F.lit(2)) == k[:2])
            return s + F.when(F.contains(t, F.lit(k)) | F.contains(F.lit(k), t), 1.0).otherwise(0.0) + F.when(near, 0.5).otherwise(0.0)

        return F.aggregate(tokens, F.lit(0.0), met)

    hits = [hit(k.lower()) for k in keywords]
    weights = [1 + (len(keywords) - i) * 0.1 for i in range(len(keywords))]
    dot = sum((h * w for h, w in zip(hits, weights)), F.lit(0.0))
    size = F.sqrt(sum((h * h for h in hits), F.lit(0.0)))
    return F.when(size > 0, dot / (size * sum(w * w for w in weights) ** 0.5)).otherwise(0.0)


def is_question(text: Column, script: str, instructions: list[str], markers: list[str]) -> Column:
    """Whether a text is a question: long enough, in the script, not mostly instructions, and with a marker or enough of the script."""
    found = F.regexp_count(text, F.lit(script))
    told = sum((F.contains(text, F.lit(w)).cast("int") for w in instructions), F.lit(0))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(text, F.lit(m))
    real = marked | ((found >= 10) & (F.length(text) >= 50))
    return F.coalesce((F.length(text) >= 20) & (found > 0) & ~((told >= 2) & (F.length(text) < 100)) & real, F.lit(False))


def is_garbage(text: Column, script: str, instructions: list[str], marker: str) -> Column:
    """Whether a recognised text holds too little of the script to be one."""
    size = F.length(F.regexp_replace(text, "[ \n]", ""))
    share = F.try_divide(F.regexp_count(text, F.lit(script)), size)
    told = sum((F.regexp_count(text, F.lit(w)) > 0).cast("int") for w in instructions)
    early = (F.length(text) < 10) | ((told >= 3) & (F.length(text) < 100)) | (size == 0) | ((share < 0.05) & (size > 20))
    return F.coalesce(early | (~text.rlike(marker) & (share < 0.2) & (size < 50)), F.lit(True))
