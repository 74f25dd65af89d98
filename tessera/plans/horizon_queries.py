"""Queries of the forecasts for one target period, with their SQL.

The syllabus: users dealt to forty topics of each event type, by day of month.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import forecast as f
from tessera.operators import horizons as h
from tessera.operators import planning as p
from tessera.sources.tables import SQL, questions, topic_days

TARGET, FIRST, BROKEN = 31, 1, 16


def _syllabus(s, d):
    return topic_days(s, d).groupBy("domain", (F.col("topic") % 40).alias("topic"), "year").agg(F.sum("cnt").alias("cnt"))


def _sparse(s, d):
    return _syllabus(s, d).filter("(year * 7 + topic * 3 + length(domain)) % 5 < 2")


def _horizons(s, d):
    m = _sparse(s, d)
    return h.horizons(m, p.co_occurrence_score(m, TARGET), TARGET, FIRST)


def _mix(s, d):
    topics = questions(s, d).groupBy("domain", "topic").agg(F.max("difficulty").alias("score"))
    return h.difficulty_mix(topics, F.nullif(F.col("score") * 2, F.lit(98)))


def _about(s, d):
    t = _syllabus(s, d).select("domain", "topic").distinct()
    cluster = F.when(F.col("topic") % 4 != 0, F.col("topic") % 4)
    return t.select("*", (F.length("domain") % 5).alias("domain_index"), F.when(F.col("topic") % 3 != 0, F.col("topic") / 40).alias("difficulty"), (F.col("topic") % 20).alias("links"), cluster.alias("cluster"))


def _selection(s, d):
    chance = (F.count("*") / 30).alias("p")
    rows = _sparse(s, d).groupBy("domain", "topic").agg(chance).withColumn("boosted", F.round(F.col("p") * (1 + F.col("topic") % 3 / 10), 6))
    return h.final_selection(rows.withColumn("cluster_p", F.when(F.col("topic") % 4 == 1, 0.7).when(F.col("topic") % 4 == 2, 0.4)), 30)


def _audit(s, d):
    m = _syllabus(s, d)
    declared = m.groupBy("domain", "topic").agg(F.sum("cnt").alias("total"), F.count("*").alias("years"))
    declared = declared.filter("topic < 30").withColumn("total", F.col("total") + F.when(F.col("topic") % 7 == 0, 1).otherwise(0)).withColumn("years", F.when(F.col("topic") % 9 == 0, 0).when(F.col("topic") % 5 == 0, F.col("years") + 1).otherwise(F.col("years")))
    asked = m.select("domain", F.when(F.col("topic") % 11 != 0, F.col("topic")).alias("topic"), (F.col("year") + 1).alias("year"))
    return h.trend_audit(declared, m, asked, BROKEN)


def _summary(s, d):
    rows = _sparse(s, d).groupBy("domain", "topic").agg(F.count("*").alias("p"), F.sum("cnt").alias("total"), (F.max("cnt") - F.min("cnt")).alias("growth"))
    return h.summary(rows, "p", "total", "growth")


QUERIES = {
    "forecast_six_factors": lambda s, d: h.six_factors(_sparse(s, d), TARGET, FIRST, BROKEN),
    "forecast_horizons": _horizons,
    "domain_rotation": lambda s, d: h.rotation(_sparse(s, d), (27, 31), (1, 5)),
    "difficulty_mix": _mix,
    "forecast_markov_steps": lambda s, d: h.markov_steps(f.markov(_sparse(s, d), 1, 30), 3),
    "topic_features": lambda s, d: h.topic_features(_sparse(s, d), _about(s, d), TARGET, FIRST),
    "final_selection": _selection,
    "trend_audit": _audit,
    "forecast_summary": _summary,
}

_DAYS = SQL["matrix"].replace("matrix AS", "days AS", 1)
_ALL = f"WITH {_DAYS}, matrix AS (SELECT domain, topic % 40 AS topic, year, CAST(sum(cnt) AS BIGINT) AS cnt FROM days GROUP BY ALL)"
_FEW = f"WITH {_DAYS}, syllabus AS (SELECT domain, topic % 40 AS topic, year, CAST(sum(cnt) AS BIGINT) AS cnt FROM days GROUP BY ALL), matrix AS (SELECT * FROM syllabus WHERE (year * 7 + topic * 3 + length(domain)) % 5 < 2)"


def _decay(half, extra="1"):
    return f"(SELECT sum(exp(-ln(2) / {half} * (31 - y)) * {extra}) FROM range(1, 31) r(y))"


_W = "CASE WHEN {} >= 16 THEN 2.0 ELSE 0.5 END"
ORACLES = {
    "forecast_six_factors": f"""{_FEW}, m AS (SELECT * FROM matrix WHERE year < 31),
        l AS (SELECT DISTINCT domain, topic FROM m WHERE year >= 29), o AS (SELECT m.domain AS d, m.topic AS t, year FROM m JOIN l USING (domain, topic)),
        c AS (SELECT domain, topic, max(n) AS together FROM (SELECT domain, topic, d, t, count(*) AS n FROM m JOIN o USING (year) WHERE domain <> d OR topic <> t GROUP BY ALL) GROUP BY ALL),
        a AS (SELECT domain, topic, sum(cnt * exp(-ln(2) / 3 * (31 - year)) * {_W.format('year')}) AS w, sum({_W.format('year')}) AS a, count(*) AS n, sum(cnt) AS total, (max(year) - min(year)) / (count(*) - 1) AS gap,
              30 - max(year) AS since, coalesce(sum(cnt) FILTER (year >= 28), 0) AS late, coalesce(sum(cnt) FILTER (year >= 25 AND year < 28), 0) AS early FROM m GROUP BY ALL),
        f AS (SELECT domain, topic, least(1.0, w / {_decay(3, _W.format('y'))} / 5) AS recency, 0.4 * a / (0.5 * 15 + 2.0 * 15) + 0.6 * least(1.0, total / n / 15) AS base,
              CASE WHEN n < 2 THEN 0.3 WHEN gap <= 1.5 OR since >= gap - 1 THEN 0.8 WHEN since >= gap * 0.7 THEN 0.6 WHEN since <= 1 AND gap > 2 THEN 0.5 WHEN since <= 1 THEN 0.7 ELSE 0.3 END AS cycle,
              CASE WHEN together IS NULL THEN 0.3 ELSE least(0.9, together / 30 * 4.0) END AS markov, (3.0 + n) / 36.0 AS posterior, CASE WHEN late * 2.0 > early * 0.5 THEN 0.8 WHEN late * 2.0 < early * 0.5 THEN 0.2 ELSE 0.5 END AS trend
              FROM a LEFT JOIN c USING (domain, topic))
        SELECT domain, topic, round(recency, 6) AS recency, round(base, 6) AS base, round(cycle, 6) AS cycle, round(markov, 6) AS markov, round(posterior, 6) AS posterior, round(trend, 6) AS trend,
          round(least(1.0, greatest(0.01, 0.15 * recency + 0.20 * base + 0.15 * cycle + 0.15 * markov + 0.20 * posterior + 0.15 * trend)), 6) AS probability FROM f""",
    "forecast_horizons": f"""{_FEW}, m AS (SELECT * FROM matrix WHERE year < 31), act AS (SELECT DISTINCT domain, topic AS r FROM m WHERE year >= 29), pre AS (SELECT m.domain, topic AS r, year FROM m JOIN act ON act.domain = m.domain AND act.r = m.topic),
        pn AS (SELECT domain, r, count(*) AS n FROM pre GROUP BY ALL), pb AS (SELECT pre.domain, r, m.topic, count(*) AS b FROM pre JOIN m ON m.domain = pre.domain AND m.year = pre.year AND m.topic <> r GROUP BY ALL),
        ps AS (SELECT domain, topic, sum(b / n) AS s FROM pb JOIN pn USING (domain, r) GROUP BY ALL), pk AS (SELECT domain, count(*) AS k FROM act GROUP BY domain),
        mk AS (SELECT domain, topic, round(least(1.0, 3 * s / k), 6) AS score FROM ps JOIN pk USING (domain)),
        g AS (SELECT *, year - lag(year) OVER (PARTITION BY domain, topic ORDER BY year) AS gap FROM m),
        a AS (SELECT domain, topic, {', '.join(f"least(1.0, sum(cnt * exp(-ln(2) / {x} * (31 - year))) / (5 * {_decay(x)})) AS r{x}" for x in (2, 4, 8))},
              count(*) AS n, sum(cnt) AS total, max(year) AS last, avg(gap) AS gap, coalesce(stddev_pop(gap), 0) AS sd, coalesce(avg(cnt) FILTER (year >= 25), 0) - coalesce(avg(cnt) FILTER (year < 25), 0) AS drift,
              list(cnt ORDER BY year) FILTER (year >= 25) AS c, coalesce(sum(cnt) FILTER (year >= 28), 0) AS late, coalesce(sum(cnt) FILTER (year >= 25 AND year < 28), 0) AS early FROM g GROUP BY ALL),
        b AS (SELECT *, CASE WHEN abs(drift) > 1.5 THEN least(1.0, abs(drift) / 4.5) ELSE 0.3 END AS cusum, 0.4 * n / 30 + 0.6 * least(1.0, total / n / 15) AS base, list_slice(c, greatest(len(c) - 4, 1), len(c)) AS l,
              CASE WHEN gap IS NULL THEN 0.3 WHEN round(sd / gap, 9) < 0.5 AND 31 - last >= round(gap, 9) THEN least(1.0, 0.6 + 0.1 * (31 - last - gap)) WHEN 31 - last >= round(gap, 9) THEN 0.5 ELSE greatest(0.1, 0.4 * (31 - last) / gap) END AS cycle,
              late * 10 > early * 13 AND late >= 2 AS emerging FROM a),
        r AS (SELECT *, CASE WHEN len(c) >= 3 THEN greatest(0.0, least(1.0, (list_sum(l[len(l) // 2 + 1:]) / (len(l) - len(l) // 2) - coalesce(list_sum(l[1:len(l) // 2]), 0) / greatest(len(l) // 2, 1)) / 5)) ELSE 0.0 END AS rise FROM b),
        x AS (SELECT domain, topic, emerging, 100 * (0.35 * r2 + 0.25 * coalesce(score, 0.3) + 0.20 * least(1.0, cusum + 0.3) + 0.20 * (n + 3.0) / 38) AS s,
              100 * (0.20 * r4 + 0.25 * base + 0.20 * cycle + 0.20 * (n + 2.0) / 40 + 0.15 * coalesce(score, 0.3)) AS d, 100 * (0.30 * r8 + 0.35 * base + 0.25 * (n + 1.5) / 43.5 + 0.10 * rise) AS g,
              CASE WHEN emerging THEN 0.5 ELSE 0.0 END AS bias FROM r LEFT JOIN mk USING (domain, topic))
        SELECT domain, topic, round(s, 2) AS short, round(d, 2) AS medium, round(g, 2) AS long, round((0.35 + 0.2 * bias) * s + (0.40 - 0.1 * bias) * d + (0.25 - 0.1 * bias) * g, 2) AS mixed,
          round((0.60 + 0.2 * bias) * s + (0.25 - 0.1 * bias) * d + (0.15 - 0.1 * bias) * g, 2) AS short_first, round(0.10 * s + 0.30 * d + 0.60 * g, 2) AS long_first, emerging FROM x""",
    "domain_rotation": f"""{_FEW}, a AS (SELECT domain, count(DISTINCT topic) AS topics, sum(cnt) AS total, count(DISTINCT year) AS n, (max(year) - min(year)) / (count(DISTINCT year) - 1) AS gap,
          coalesce(sum(cnt) FILTER (year BETWEEN 27 AND 31), 0) - coalesce(sum(cnt) FILTER (year BETWEEN 1 AND 5), 0) AS change FROM matrix GROUP BY domain)
        SELECT domain, topics, total, change, CASE WHEN n < 4 THEN 'insufficient_data' WHEN gap <= 1.5 THEN 'yearly' WHEN gap <= 2.5 THEN 'biennial' WHEN gap <= 4 THEN 'triennial' ELSE 'irregular' END AS pattern,
          CASE WHEN change > 3 THEN 'increasing' WHEN change < -3 THEN 'decreasing' ELSE 'stable' END AS shift FROM a""",
    "difficulty_mix": f"""WITH {SQL['questions']}, t AS (SELECT domain, topic, nullif(max(difficulty) * 2, 98) AS score FROM questions GROUP BY ALL), l AS (SELECT coalesce(nullif(score, 0), 40) AS g FROM t)
        SELECT CASE WHEN g >= 60 THEN 'hard' WHEN g >= 35 THEN 'medium' ELSE 'easy' END AS level, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM l), 1) AS pct FROM l GROUP BY 1""",
    "forecast_markov_steps": f"""{_FEW}, x AS (SELECT domain, topic, year, lead(year) OVER (PARTITION BY domain, topic ORDER BY year) AS nx FROM matrix),
        y AS (SELECT domain, topic, count(*) FILTER (nx = year + 1) AS n11, count(*) AS present, min(year) AS a, max(year) AS b FROM x GROUP BY ALL),
        z AS (SELECT *, present - n11 - CAST(b = 30 AS INT) AS n10, present - n11 - CAST(a = 1 AS INT) AS n01 FROM y), w AS (SELECT *, 29 - n11 - n10 - n01 AS n00 FROM z),
        c AS (SELECT domain, topic, (n11 + 1) / (n11 + n10 + 2) AS stay, (n01 + 1) / (n00 + n01 + 2) AS enter, b FROM w)
        SELECT domain, topic, round(enter / (1 - stay + enter) + (round(CASE WHEN b = 30 THEN stay ELSE enter END, 6) - enter / (1 - stay + enter)) * power(stay - enter, 2), 6) AS chance FROM c""",
    "topic_features": f"""{_FEW}, about AS (SELECT DISTINCT domain, topic, length(domain) % 5 AS i, CASE WHEN topic % 3 <> 0 THEN topic / 40 END AS difficulty, topic % 20 AS links, CASE WHEN topic % 4 <> 0 THEN topic % 4 END AS cluster FROM syllabus),
        a AS (SELECT domain, topic, count(*) AS n, sum(cnt * exp(-ln(2) / 3 * (31 - year))) / {_decay(3)} / 5 AS recency, coalesce(sum((year - 28) * cnt) FILTER (year >= 26), 0) AS x, sum(cnt) AS s, sum(cnt * cnt) AS ss FROM matrix WHERE year < 31 GROUP BY ALL),
        r AS (SELECT * FROM about LEFT JOIN a USING (domain, topic)), c AS (SELECT cluster, sum(n) AS active FROM r WHERE cluster IS NOT NULL GROUP BY cluster)
        SELECT domain, topic, round(coalesce(n / 30, 0), 6) AS presence, round(coalesce(recency, 0), 6) AS recency, i / 4 AS domain_index, CASE WHEN n IS NULL THEN 0.5 ELSE coalesce(difficulty, 0.5) END AS difficulty,
          CASE WHEN n IS NULL THEN 0 ELSE least(1.0, links / 15) END AS links, CASE WHEN n IS NOT NULL AND cluster IS NOT NULL THEN least(1.0, active / 50) ELSE 0.3 END AS cluster_activity,
          round(CASE WHEN n IS NULL THEN 0 ELSE greatest(-1.0, least(1.0, x / 10)) END, 6) AS slope, round(CASE WHEN n IS NULL THEN 0 ELSE least(1.0, sqrt(greatest(0.0, ss / 30 - power(s / 30, 2))) / 3) END, 6) AS deviation
        FROM r LEFT JOIN c USING (cluster)""",
    "final_selection": f"""{_FEW}, q AS (SELECT domain, topic, count(*) / 30 AS p FROM matrix GROUP BY ALL), b AS (SELECT *, round(p * (1 + topic % 3 / 10), 6) AS boosted, CASE topic % 4 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 END AS cp,
          row_number() OVER (ORDER BY p DESC, domain, topic) AS i FROM q)
        SELECT domain, topic, p, boosted, i > 30 AS rescued FROM b WHERE i <= 30 OR (cp >= 0.5 AND boosted >= cp * 0.4)""",
    "forecast_summary": f"""{_FEW}, t AS (SELECT domain || '/' || topic AS name, domain, topic, count(*) AS p, sum(cnt) AS total, max(cnt) - min(cnt) AS growth FROM matrix GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (ORDER BY p DESC, domain, topic) AS a, row_number() OVER (ORDER BY total DESC, domain, topic) AS b, row_number() OVER (ORDER BY growth DESC, domain, topic) AS c FROM t)
        SELECT count(*) AS topics, max(name) FILTER (a = 1) AS likeliest, max(name) FILTER (b = 1) AS largest, max(name) FILTER (c = 1) AS fastest FROM r HAVING count(*) > 0""",
    "trend_audit": f"""{_ALL}, f AS (SELECT domain, topic, sum(cnt) AS t, count(*) AS y FROM matrix GROUP BY ALL),
        d AS (SELECT domain, topic, t, y, t + CASE WHEN topic % 7 = 0 THEN 1 ELSE 0 END AS total, CASE WHEN topic % 9 = 0 THEN 0 WHEN topic % 5 = 0 THEN y + 1 ELSE y END AS years FROM f WHERE topic < 30),
        lost AS (SELECT domain, topic, year + 1 AS year FROM matrix m WHERE topic % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM matrix o WHERE o.domain = m.domain AND o.topic = m.topic AND o.year = m.year + 1))
        SELECT 'topic_total' AS "check", 'high' AS severity, count(*) AS n FROM d WHERE total <> t
        UNION ALL SELECT 'domain_total', 'high', count(*) FROM (SELECT domain FROM d GROUP BY domain HAVING sum(total) <> sum(t))
        UNION ALL SELECT 'topic_years', 'low', count(*) FROM d WHERE years <> 0 AND years <> y
        UNION ALL SELECT 'topic_year_missing', 'medium', count(*) FROM lost UNION ALL SELECT 'recent_missing', 'medium', count(*) FROM lost WHERE year >= 16 AND topic < 30""",
}
