"""Queries of the window operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import windows as w
from tessera.sources.tables import SQL, attempts, month_index, scores, table, topic_days

KEYS = ["domain", "topic"]


def _scores_sql(body: str) -> str:
    return f"WITH {SQL['scores']} {body}"


def _matrix_sql(body: str) -> str:
    return f"WITH {SQL['matrix']} {body}"


def _knapsack(s, d):
    rows = attempts(s, d).filter("value is not null").select("student", F.col("event_id").alias("pos"), F.round(F.col("value"), 2).alias("cost"), F.col("event_id").cast("string").alias("item"))
    out = w.within_budget(rows, ["student"], ["pos"], "cost", "item", 100.0)
    return out.select("student", "used", F.array_join("taken", ",").alias("taken"))


def _carried(s, d):
    rows = table(s, d, "conversations").withColumn("label", F.when(F.length("text") % 3 != 0, F.col("role")))
    out = w.carried(rows, ["conv_id"], ["turn"], "label", F.col("role") == "system")
    return out.select("conv_id", "turn", "block", "label", "carried")


QUERIES = {
    "topic_year_trend": lambda s, d: w.halves(topic_days(s, d), KEYS),
    "consecutive_streaks": lambda s, d: w.streaks(topic_days(s, d), KEYS),
    "appearance_intervals": lambda s, d: w.intervals(topic_days(s, d), KEYS),
    "recency_weighted_frequency": lambda s, d: w.recency_weighted(topic_days(s, d), KEYS, target=31, first=1),
    "linear_recent_weights": lambda s, d: w.linear_recent(topic_days(s, d), KEYS, target=31),
    "thirds_trend": lambda s, d: w.thirds(scores(s, d), ["student"], "score", ["date", "exam"]),
    "score_regression": lambda s, d: w.regression(scores(s, d), ["student"], "score", ["date", "exam"], last=6),
    "stagnation": lambda s, d: w.stagnation(scores(s, d), ["student"], "score", ["date", "exam"], spread=50000.0),
    "burnout_signals": lambda s, d: w.burnout(scores(s, d), ["student"], "score", ["date", "exam"]),
    "monthly_streaks": lambda s, d: w.monthly_streaks(scores(s, d), ["student"], month_index(F.col("date"))),
    "carry_forward_labels": _carried,
    "neighbour_context": lambda s, d: w.neighbours(table(s, d, "conversations").select("conv_id", "turn", F.left("text", F.lit(40)).alias("text")), ["conv_id"], ["turn"], "text"),
    "capped_rank": lambda s, d: w.capped_rank(
        topic_days(s, d).groupBy("domain", "topic").agg(F.sum("cnt").alias("n")), "domain", F.col("n").cast("double"), ["domain", "topic"], cap=6, n=20
    ),
    "budgeted_schedule": _knapsack,
    "learning_velocity": lambda s, d: w.velocity(scores(s, d), ["student"], "score", "date", "exam"),
    "first_occurrence_flags": lambda s, d: w.duplicate_flags(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct(), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"]
    ),
    "sample_period_shares": lambda s, d: w.sample_periods(topic_days(s, d), ["domain"]),
}

_ISLAND = "SELECT domain, topic, year, year - row_number() OVER (PARTITION BY domain, topic ORDER BY year) AS island FROM matrix"

ORACLES = {
    "topic_year_trend": _matrix_sql(
        """, spine AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM matrix)),
        h AS (SELECT domain, topic, round(sum(CASE WHEN i <= n // 2 THEN cnt ELSE 0 END) / greatest(max(n // 2), 1), 6) AS early,
                     round(sum(CASE WHEN i > n // 2 THEN cnt ELSE 0 END) / greatest(max(n - n // 2), 1), 6) AS late
              FROM matrix JOIN spine USING (year) GROUP BY domain, topic)
        SELECT domain, topic, early, late, CASE WHEN late > early THEN 'rising' WHEN late < early THEN 'falling' ELSE 'stable' END AS trend FROM h"""
    ),
    "consecutive_streaks": _matrix_sql(
        f""", isl AS ({_ISLAND}), runs AS (SELECT domain, topic, island, count(*) AS n, max(year) AS e FROM isl GROUP BY ALL),
        per AS (SELECT domain, topic, max(n) AS longest, arg_max(n, e) AS tail, max(e) AS last FROM runs GROUP BY ALL)
        SELECT domain, topic, longest, CASE WHEN last = (SELECT max(year) FROM matrix) THEN tail ELSE 0 END AS trailing,
               (SELECT max(year) FROM matrix) - last AS gap FROM per"""
    ),
    "appearance_intervals": _matrix_sql(
        """, g AS (SELECT domain, topic, year, year - lag(year) OVER (PARTITION BY domain, topic ORDER BY year) AS gap FROM matrix),
        r AS (SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY gap DESC, year) AS rn FROM g WHERE gap IS NOT NULL)
        SELECT domain, topic, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS sd_gap, CAST(max(gap) AS BIGINT) AS max_gap,
               max(CASE WHEN rn = 1 THEN year END) AS comeback FROM r GROUP BY domain, topic"""
    ),
    "recency_weighted_frequency": _matrix_sql(
        """SELECT domain, topic, round(least(1.0, sum(cnt * exp(-ln(2) / 3.0 * (31 - year))) /
               (SELECT 5.0 * sum(exp(-ln(2) / 3.0 * (31 - y))) FROM range(1, 31) t(y))), 6) AS recency
           FROM matrix WHERE year >= 1 AND year < 31 GROUP BY domain, topic"""
    ),
    "linear_recent_weights": _matrix_sql(
        """SELECT domain, topic, round(least(1.0, sum(CASE WHEN 31 - year BETWEEN 1 AND 5 THEN (6 - (31 - year)) * cnt ELSE 0 END) / 15.0 / 5.0), 6) AS recent
           FROM matrix GROUP BY domain, topic"""
    ),
    "thirds_trend": _scores_sql(
        """, r AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY date, exam) AS i, count(*) OVER (PARTITION BY student) AS n FROM scores),
        m AS (SELECT student, round(avg(score) FILTER (i <= n // 3), 4) AS first_third, round(avg(score) FILTER (i > n - n // 3), 4) AS last_third FROM r WHERE n >= 3 GROUP BY student)
        SELECT *, CASE WHEN last_third > first_third * 1.2 THEN 'up' WHEN last_third < first_third * 0.8 THEN 'down' ELSE 'flat' END AS trend FROM m"""
    ),
    "score_regression": _scores_sql(
        """, r AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY date DESC, exam DESC) AS r FROM scores),
        x AS (SELECT *, CAST(count(*) OVER (PARTITION BY student) - r AS DOUBLE) AS x FROM r WHERE r <= 6),
        m AS (SELECT student, count(*) AS n, regr_slope(score, x) AS b, regr_intercept(score, x) AS a FROM x GROUP BY student HAVING count(*) >= 2)
        SELECT student, n, round(b, 4) AS slope, round(a, 4) AS intercept, round(greatest(0.0, a + b * n), 4) AS next_value FROM m"""
    ),
    "stagnation": _scores_sql(
        """, r AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY date DESC, exam DESC) AS r FROM scores),
        m AS (SELECT student, count(*) AS n, round(max(score) - min(score), 4) AS spread FROM r WHERE r <= 4 GROUP BY student)
        SELECT *, n = 4 AND spread < 50000.0 AS stagnant FROM m"""
    ),
    "burnout_signals": _scores_sql(
        """, r AS (SELECT *, lag(score, 1) OVER w AS p1, lag(score, 2) OVER w AS p2, row_number() OVER (PARTITION BY student ORDER BY date DESC, exam DESC) AS r
                   FROM scores WINDOW w AS (PARTITION BY student ORDER BY date, exam)),
        m AS (SELECT student, CAST(count(*) FILTER (score < p1 AND p1 < p2) AS BIGINT) AS drops, round(max(score - p2) FILTER (r = 1), 4) AS last_change,
                     round(stddev_pop(score), 6) AS volatility, round(avg(score), 6) AS mean FROM r GROUP BY student)
        SELECT *, volatility > 0.3 * mean AS volatile FROM m"""
    ),
    "monthly_streaks": _scores_sql(
        """, m AS (SELECT DISTINCT student, year(date) * 12 + month(date) AS m FROM scores),
        i AS (SELECT student, m, m - row_number() OVER (PARTITION BY student ORDER BY m) AS g FROM m),
        r AS (SELECT student, g, count(*) AS n, max(m) AS e FROM i GROUP BY ALL)
        SELECT student, arg_max(n, e) AS current, max(n) AS best FROM r GROUP BY student"""
    ),
    "carry_forward_labels": """
        WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 <> 0 THEN role END AS label,
                          CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM conversations)
        SELECT conv_id, turn, block, label, coalesce(
            last_value(label IGNORE NULLS) OVER (PARTITION BY conv_id, block ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(label IGNORE NULLS) OVER (PARTITION BY conv_id, block ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS carried FROM r""",
    "neighbour_context": """
        SELECT conv_id, turn, left(text, 40) AS text, lag(left(text, 40)) OVER w AS previous, lead(left(text, 40)) OVER w AS following
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "capped_rank": _matrix_sql(
        """, t AS (SELECT domain, topic, CAST(sum(cnt) AS BIGINT) AS n FROM matrix GROUP BY domain, topic),
        g AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, domain, topic) AS g FROM t)
        SELECT domain, topic, n, CAST(row_number() OVER (ORDER BY n DESC, domain, topic) AS INTEGER) AS rank FROM g WHERE g <= 6 ORDER BY rank LIMIT 20"""
    ),
    "learning_velocity": _scores_sql(
        """, r AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY date, exam) AS i, row_number() OVER (PARTITION BY student ORDER BY date DESC, exam DESC) AS j FROM scores),
        m AS (SELECT student, max(score) FILTER (i = 1) AS a, max(score) FILTER (j = 1) AS b, CAST(date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) AS BIGINT) AS days FROM r GROUP BY student)
        SELECT student, days, round(CASE WHEN days > 0 THEN (b - a) / days ELSE 0.0 END, 4) AS velocity,
               round(b + 30 * CASE WHEN days > 0 THEN (b - a) / days ELSE 0.0 END, 4) AS projected FROM m"""
    ),
    "first_occurrence_flags": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) > 1 AS duplicate
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)""",
    "sample_period_shares": _matrix_sql(
        """, spine AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM matrix)),
        p AS (SELECT year, CASE WHEN i = 1 THEN 'first' WHEN i = n // 2 + 1 THEN 'middle' WHEN i = n THEN 'last' END AS which FROM spine),
        c AS (SELECT which, domain, sum(cnt) AS c FROM matrix JOIN p USING (year) WHERE which IS NOT NULL GROUP BY ALL)
        SELECT which, domain, round(100.0 * c / sum(c) OVER (PARTITION BY which), 4) AS pct FROM c"""
    ),
}
