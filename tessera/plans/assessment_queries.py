"""Queries of difficulty, mastery, recommendation, dashboard and rule classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assessment as a
from tessera.operators import graph as g
from tessera.operators import search as se
from tessera.plans.horizon_queries import _ALL
from tessera.plans.model_queries import _TREE, AS_OF, _tree
from tessera.sources.tables import SQL, attempts, questions, table, topic_days

STUDENT = ["student", "topic"]
INDICATORS = {"english": ({" the ": 3, " and ": 2, "tion": 1}, 4), "german": ({" der ": 3, " und ": 2, "ung": 1}, 3), "french": ({" les ": 3, " des ": 2, "eur": 1}, 3)}
CATEGORY = ["revenue", "market", "price", "and", "to"]


def _rated(s, d):
    q = questions(s, d)
    material = F.when(F.col("error_type") == "A", 0.3).when(F.col("error_type") == "R", 0.4).otherwise(0.0)
    return a.item_difficulty(q, ["exam_id", "number"], "topic", F.col("difficulty") % 5 + 1, material, F.col("number") + 1, F.length("name") * 20, F.col("exam_year"), 1992, 7)


def _difficulty_audit(s, d):
    gold = questions(s, d).select("exam_id", "number", (F.col("difficulty") % 5 + 1).alias("gold")).distinct()
    return a.difficulty_audit(_rated(s, d), "topic", gold, ["exam_id", "number"], rare=10, common=30)


def _topics(s, d):
    t = attempts(s, d).groupBy(*STUDENT).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("right"))
    x = F.length("topic")
    return t.select(*STUDENT, F.when(x > 5, "long").otherwise("short").alias("domain"), (F.col("right") / (F.col("n") + 1)).alias("mastery"), (x / 10).alias("frequency"), (x % 4 / 4).alias("probability"), (x % 3 / 3).alias("difficulty"), (x % 5 / 5).alias("centrality"))


def _with_needs(s, d):
    needs = s.createDataFrame([("purchase", "click"), ("click", "view"), ("error", "signup")], "topic string, needs string")
    return a.with_prerequisites(attempts(s, d).select("student", "topic", "ts", "event_id", "correct"), needs, "topic").groupBy(*STUDENT).agg(F.count("*").alias("n"))


def _syllabus(s, d):
    return topic_days(s, d).groupBy("domain", (F.col("topic") % 40).alias("topic"), "year").agg(F.sum("cnt").alias("cnt"))


def _records(s, d):
    m = _syllabus(s, d).filter("topic % 3 <> 0 or year < 20")
    return a.legacy_record(m, 30, 1)


def _importance(s, d):
    predicted = _syllabus(s, d).filter("topic % 2 = 0").groupBy("domain", "topic").agg((F.countDistinct("year") / 30).alias("probability"))
    return a.topic_importance(_records(s, d), predicted, ["domain", "topic"])


def _bundle(s, d):
    m = _syllabus(s, d)
    wrong = attempts(s, d).filter("not correct").select("event_id", F.col("topic").alias("domain"), (F.col("student") % 40).alias("topic"))
    weak = m.filter("topic % 5 <> 0").groupBy("domain", "topic").agg((F.countDistinct("year") / 40).alias("weakness"))
    records = _records(s, d).filter("topic % 7 <> 0").select("domain", "topic", "total", "recent5")
    hard = m.filter("topic % 4 <> 0").groupBy("domain", "topic").agg((F.max("cnt") * 9).alias("difficulty"))
    predicted = m.filter("topic % 6 = 0").groupBy("domain", "topic").agg((F.countDistinct("year") * 3).alias("probability"))
    return a.wrong_answer_bundle(wrong, ["domain", "topic"], weak, records, hard, predicted)


def _indicators(s, d):
    label, score = a.indicator_class(F.lower("text"), INDICATORS)
    return table(s, d, "documents").select("doc_id", label.alias("domain"), score.alias("score"))


def _reclassified(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    words = F.array_distinct(F.filter(F.split("text", r"[ ()·]+"), lambda w: F.length(w) >= 2))
    learned = a.learned_keywords(table(s, d, "benchmark").withColumn("label", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")), "label", F.col("text"))
    patterns = {"even": F.regexp_count("text", F.lit("ing ")), "odd": F.regexp_count("text", F.lit("ed "))}
    choices = {"even": F.regexp_count("lang", F.lit("e"))}
    return a.reclassified(docs, "doc_id", words, learned, "label", patterns, choices)


def _prefix(s, d):
    tokens = F.array_distinct(se.tokens(F.col("text")))
    return table(s, d, "benchmark").select("item_id", F.round(a.prefix_similarity(tokens, CATEGORY), 6).alias("similarity"))


def _validity(s, d):
    text = F.col("text")
    question = a.is_question(text, "[a-z]", ["the", "and"], ["?", "which"])
    return table(s, d, "documents").select("doc_id", question.alias("question"), a.is_garbage(text, "[aeiou]", ["the", "and", "of"], r"[0-9]+\?").alias("garbage"))


def _prerequisite_edges(s, d):
    together = topic_days(s, d).groupBy((F.col("topic") % 25 + 100).cast("int").alias("src"), (F.col("topic") % 7 + 100).cast("int").alias("dst")).agg(F.count("*").alias("together"))
    return g.prerequisite_edges(_tree(s, d), together.withColumn("together", F.col("together") % 9), together.select("src", "dst", (F.col("together") % 10 / 10).alias("similarity")))


QUERIES = {
    "item_difficulty": lambda s, d: _rated(s, d).groupBy("topic", "category").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.round(F.avg("rarity"), 4).alias("rarity")),
    "difficulty_audit": _difficulty_audit,
    "recommendations": lambda s, d: a.recommended(_topics(s, d), ["student"], "domain", "topic", F.lit(0.4), per_domain=2, k=3),
    "prerequisite_attempts": _with_needs,
    "tracked_mastery": lambda s, d: a.tracked_mastery(attempts(s, d), STUDENT, ["ts", "event_id"]),
    "node_mastery": lambda s, d: a.node_mastery(attempts(s, d).withColumn("correct", F.col("event_id") % 3 > 0), STUDENT, ["ts", "event_id"], AS_OF),
    "topic_importance": _importance,
    "wrong_answer_bundle": _bundle,
    "legacy_records": _records,
    "dashboard_years": lambda s, d: a.dashboard_years(_syllabus(s, d), ["click", "purchase", "view"]),
    "dashboard_topics": lambda s, d: a.dashboard_topics(_records(s, d)),
    "indicator_classes": _indicators,
    "reclassified_documents": _reclassified,
    "prefix_similarity": _prefix,
    "text_validity": _validity,
    "prerequisite_edges": _prerequisite_edges,
    "graph_eigenvector": lambda s, d: g.eigenvector(_tree(s, d).withColumn("weight", F.lit(1.0) / (1 + F.col("dst") % 3))),
    "char_ngram_vectors": lambda s, d: se.char_tfidf(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("features"), F.round(F.max("weight"), 4).alias("largest"), F.round(F.sum("weight"), 3).alias("sum")),
}

_REC = f"""{_ALL}, few AS (SELECT * FROM matrix WHERE topic % 3 <> 0 OR year < 20),
  ra AS (SELECT domain, topic, sum(cnt) AS total, count(*) AS active, min(year) AS first, max(year) AS last, coalesce(sum(cnt) FILTER (year > 27), 0) AS recent3, coalesce(sum(cnt) FILTER (year > 25), 0) AS recent5 FROM few GROUP BY ALL),
  rs AS (SELECT domain, topic, count(*) AS streak FROM (SELECT domain, topic, year, count(*) OVER (PARTITION BY domain, topic ORDER BY year DESC) AS i, max(year) OVER (PARTITION BY domain, topic) AS m FROM few) WHERE year = m - i + 1 GROUP BY ALL),
  rg AS (SELECT *, 30 - last AS gap, total - recent5 AS older, round((recent5 - (total - recent5)) / greatest(total - recent5, 1) * 100, 1) AS growth FROM ra JOIN rs USING (domain, topic)),
  rec AS (SELECT domain, topic, total, active, gap, streak, recent3, recent5, growth, round(recent5 / 5, 2) AS recent_mean, round(older / 25, 2) AS older_mean,
    CASE WHEN first >= 27 THEN 'emerging' WHEN gap >= 5 AND total >= 2 THEN 'disappearing' WHEN total < 3 THEN 'rare' WHEN growth > 20 THEN 'growing' WHEN growth < -20 THEN 'declining' ELSE 'stable' END AS category FROM rg)"""
_RATED = f"""WITH {SQL['questions']}, fr AS (SELECT topic, count(*) AS f FROM questions WHERE topic IS NOT NULL GROUP BY topic), na AS (SELECT greatest(count(*) / 20, 1.0) AS n FROM questions),
  fa AS (SELECT exam_id, number, topic, f, difficulty % 5 + 1 AS gold, (difficulty % 5) / 4.0 AS base, coalesce(greatest(0.0, least(1.0, 1 - f / n)), 0.5) AS rarity, CASE error_type WHEN 'A' THEN CAST(0.3 AS DOUBLE) WHEN 'R' THEN 0.4 ELSE 0.0 END AS material,
    least(1.0, (number - 1) / 6.0) AS choices, least(1.0, len(name) * 20 / 500.0) AS length, (exam_year - 1992) / 7.0 AS period FROM questions LEFT JOIN fr USING (topic), na),
  sc AS (SELECT *, CAST(greatest(1, least(100, round_even(round((CAST(0.30 AS DOUBLE) * base + CAST(0.20 AS DOUBLE) * rarity + CAST(0.15 AS DOUBLE) * material + CAST(0.10 AS DOUBLE) * choices + CAST(0.10 AS DOUBLE) * length + CAST(0.15 AS DOUBLE) * period) * 100, 9), 0))) AS INTEGER) AS score FROM fa),
  rated AS (SELECT exam_id, number, topic, f, gold, round(base, 3) AS base, round(rarity, 3) AS rarity, round(material, 3) AS material, round(choices, 3) AS choices, round(length, 3) AS length, round(period, 3) AS period, score,
    CASE WHEN score <= 30 THEN 'easy' WHEN score <= 60 THEN 'medium' WHEN score <= 80 THEN 'hard' ELSE 'expert' END AS category FROM sc)"""
_IND = {d: " + ".join(f"CASE WHEN contains(t, '{w}') THEN {n} ELSE 0 END" for w, n in words.items()) for d, (words, _) in INDICATORS.items()}
_WORDS = "list_filter(regexp_split_to_array(text, '[ ()·]+'), lambda w: len(w) >= 2)"


def _hit(k):
    return f"coalesce(sum(CAST(contains(t, '{k}') OR contains('{k}', t) AS INT) + 0.5 * CAST(len(t) > 2 AND {len(k)} > 2 AND left(t, 2) = '{k[:2]}' AS INT)), 0)"


_SIZE = sum((1 + (len(CATEGORY) - i) * 0.1) ** 2 for i in range(len(CATEGORY))) ** 0.5
_DOT = " + ".join(f"h{i} * {1 + (len(CATEGORY) - i) * 0.1}" for i in range(len(CATEGORY)))
_NORM = " + ".join(f"h{i} * h{i}" for i in range(len(CATEGORY)))

ORACLES = {
    "item_difficulty": f"{_RATED} SELECT topic, category, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, round(avg(rarity), 4) AS rarity FROM rated GROUP BY ALL",
    "difficulty_audit": f"""{_RATED} SELECT 'rare_topics' AS "check", '' AS level, count(*) AS n, round(coalesce(avg(score), 0), 4) AS value FROM rated WHERE f < 10
        UNION ALL SELECT 'common_topics', '', count(*), round(coalesce(avg(score), 0), 4) FROM rated WHERE f >= 30 UNION ALL SELECT 'correlation', '', count(*), round(corr(score, f), 4) FROM rated
        UNION ALL SELECT 'factors_differ', '', count(*) FILTER (abs((base + rarity + material + choices + length + period) * 100 / 6 - score) > 25 AND score > 10), round(count(*) FILTER (abs((base + rarity + material + choices + length + period) * 100 / 6 - score) > 25 AND score > 10) / count(*), 4) FROM rated
        UNION ALL SELECT 'distribution', category, count(*), round(100.0 * count(*) / (SELECT count(*) FROM rated), 4) FROM rated GROUP BY category
        UNION ALL SELECT 'gold', CAST(g.gold AS VARCHAR), count(*), round(avg(score), 4) FROM rated r JOIN (SELECT DISTINCT exam_id, number, gold FROM rated) g USING (exam_id, number) GROUP BY g.gold""",
    "recommendations": f"""WITH {SQL['attempts']}, t AS (SELECT student, topic, count(*) FILTER (correct) / (count(*) + 1) AS m, len(topic) AS x FROM attempts GROUP BY ALL),
        f AS (SELECT *, CASE WHEN x > 5 THEN 'long' ELSE 'short' END AS domain, x % 3 / 3 AS hard FROM t),
        s AS (SELECT student, domain, topic, round(100 * (0.40 * least(1.0, 90 * (x / 10) * 0.08 * (1 - m) / 15) + 0.20 * (x % 4 / 4) + 0.15 * CASE WHEN m >= 0.8 THEN 0.1 WHEN m >= 0.6 THEN 0.3 WHEN m >= 0.4 THEN 0.6 WHEN m >= 0.2 THEN 0.8 ELSE 1.0 END
          + 0.10 * greatest(0.0, 1 - abs(hard - 0.4 - 0.15) * 2) + 0.10 * (x % 5 / 5) + 0.05 * least(1.0, (1 - m) / (2 + hard * 6) * 5)), 2) AS score FROM f),
        d AS (SELECT *, row_number() OVER (PARTITION BY student, domain ORDER BY score DESC, topic) AS i FROM s), r AS (SELECT student, domain, topic, score, row_number() OVER (PARTITION BY student ORDER BY score DESC, domain, topic) AS rank FROM d WHERE i <= 2)
        SELECT * FROM r WHERE rank <= 3""",
    "prerequisite_attempts": f"""WITH {SQL['attempts']}, n AS (SELECT * FROM (VALUES ('purchase', 'click'), ('click', 'view'), ('error', 'signup')) t(topic, needs)),
        u AS (SELECT student, topic FROM attempts UNION ALL SELECT student, needs FROM attempts JOIN n USING (topic)) SELECT student, topic, count(*) AS n FROM u GROUP BY ALL""",
    "node_mastery": f"""WITH {SQL['attempts']}, m AS (SELECT student, topic, event_id % 3 > 0 AS correct, ts, event_id FROM attempts), r AS (SELECT *, row_number() OVER (PARTITION BY student, topic ORDER BY ts DESC NULLS LAST, event_id DESC) AS i FROM m),
        x AS (SELECT student, topic, count(*) AS n, avg(CAST(correct AS INT)) AS acc, max(ts) AS last, string_agg(CAST(CAST(correct AS INT) AS VARCHAR), '' ORDER BY i DESC) FILTER (i <= 5) AS last_five FROM r GROUP BY ALL),
        v AS (SELECT *, round(least(1.0, acc * 0.6 + least(0.2, n * 0.04) + coalesce(greatest(0.0, 0.2 - date_diff('day', CAST(last AS DATE), DATE '{AS_OF}') / 365 * 0.2), 0)), 3) AS mastery FROM x)
        SELECT student, topic, n, round(acc, 6) AS accuracy, mastery, round(mastery * 0.8, 3) AS retention, CASE WHEN acc >= 0.8 THEN 'mastered' WHEN acc >= 0.5 THEN 'learning' ELSE 'weak' END AS status, last_five FROM v""",
    "legacy_records": f"{_REC} SELECT * FROM rec",
    "topic_importance": f"""{_REC}, o AS (SELECT domain, topic, round(least(1.0, total / 100) * 0.4 + least(1.0, recent5 / greatest(active, 1) / 5) * 0.35 + least(1.0, active / 24) * 0.25 + 1e-9, 3) AS own FROM rec),
        p AS (SELECT domain, topic, count(DISTINCT year) / 30 AS pr FROM matrix WHERE topic % 2 = 0 GROUP BY ALL)
        SELECT coalesce(o.domain, p.domain) AS domain, coalesce(o.topic, p.topic) AS topic, round(CASE WHEN own IS NULL THEN pr WHEN pr IS NULL THEN own ELSE own * 0.7 + pr * 0.3 END + 1e-9, 3) AS importance FROM o FULL JOIN p ON o.domain = p.domain AND o.topic = p.topic""",
    "wrong_answer_bundle": f"""{_REC}, w AS (SELECT event_id, event_type AS domain, user_id % 40 AS topic FROM events WHERE event_type = 'error'), k AS (SELECT domain, topic, count(DISTINCT year) / 40 AS weakness FROM matrix WHERE topic % 5 <> 0 GROUP BY ALL),
        h AS (SELECT domain, topic, max(cnt) * 9 AS hard FROM matrix WHERE topic % 4 <> 0 GROUP BY ALL), p AS (SELECT domain, topic, count(DISTINCT year) * 3 AS pr FROM matrix WHERE topic % 6 = 0 GROUP BY ALL),
        j AS (SELECT w.*, weakness, total, recent5, CAST(coalesce(nullif(hard, 0), 40) AS DOUBLE) AS hard, pr FROM w LEFT JOIN k USING (domain, topic) LEFT JOIN (SELECT * FROM rec WHERE topic % 7 <> 0) USING (domain, topic) LEFT JOIN h USING (domain, topic) LEFT JOIN p USING (domain, topic)),
        c AS (SELECT *, coalesce(pr, CASE WHEN total IS NOT NULL THEN least(95.0, round(least(60.0, total / 24 * 10) + recent5 / greatest(total, 1) * 30)) END, 30.0) AS chance FROM j),
        s AS (SELECT *, least(100.0, round(round(coalesce(weakness, 0) * 40 + least(25.0, coalesce(total, 0) / 24 * 5) + chance / 100 * 25 + CASE WHEN hard >= 30 AND hard <= 60 THEN 10 WHEN hard > 60 THEN 5 ELSE 8 END, 9))) AS score FROM c)
        SELECT event_id, domain, topic, round(chance, 4) AS chance, CASE WHEN pr IS NOT NULL THEN 'prediction' WHEN total IS NOT NULL THEN 'record' ELSE 'default' END AS source,
          CASE WHEN hard >= 70 THEN 'very hard' WHEN hard >= 55 THEN 'hard' WHEN hard >= 40 THEN 'medium' WHEN hard >= 25 THEN 'easy' ELSE 'very easy' END AS difficulty_label, CAST(score AS INTEGER) AS priority,
          CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'E' END AS grade FROM s""",
    "dashboard_years": f"{_ALL} SELECT year, {', '.join(f'''CAST(coalesce(sum(cnt) FILTER (domain = '{x}'), 0) AS BIGINT) AS {x}''' for x in ('click', 'purchase', 'view'))}, CAST(coalesce(sum(cnt) FILTER (domain IN ('click', 'purchase', 'view')), 0) AS BIGINT) AS total FROM matrix GROUP BY year",
    "dashboard_topics": f"""{_REC}, b AS (SELECT 'largest' AS board, domain, topic, total, CAST(total AS DOUBLE) AS value, -total AS o, 100 AS n FROM rec UNION ALL SELECT 'rising', domain, topic, total, growth, -growth, 20 FROM rec WHERE category = 'growing'
          UNION ALL SELECT 'falling', domain, topic, total, growth, growth, 20 FROM rec WHERE category = 'declining' UNION ALL SELECT 'gap', domain, topic, total, gap, -gap, 20 FROM rec WHERE gap >= 3 AND total >= 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY board ORDER BY o, total DESC, domain, topic) AS INTEGER) AS rank FROM b)
        SELECT board, rank, domain, topic, value, CASE WHEN board = 'gap' THEN CASE WHEN total >= 10 THEN 'A' WHEN total >= 5 THEN 'B' ELSE 'C' END END AS priority FROM r WHERE rank <= n""",
    "indicator_classes": f"""WITH x AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, {', '.join(f'{e} AS {d}' for d, e in _IND.items())} FROM x), b AS (SELECT *, greatest(english, german, french) AS best FROM s),
        c AS (SELECT doc_id, best, CASE WHEN english = best THEN 'english' WHEN german = best THEN 'german' ELSE 'french' END AS d FROM b)
        SELECT doc_id, CASE WHEN best >= CASE d WHEN 'english' THEN 4 ELSE 3 END THEN d ELSE 'unknown' END AS domain, CASE WHEN best >= CASE d WHEN 'english' THEN 4 ELSE 3 END THEN best ELSE 0 END AS score FROM c""",
    "reclassified_documents": f"""WITH k AS (SELECT word, label, count(*) AS n FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label, unnest({_WORDS}) AS word FROM benchmark) GROUP BY ALL),
        w AS (SELECT doc_id, unnest(list_distinct({_WORDS})) AS word FROM documents), s AS (SELECT doc_id, label, 1.5 * sum(n) AS s FROM w JOIN k USING (word) GROUP BY ALL
          UNION ALL SELECT doc_id, 'even', 6 * (len(text) - len(replace(text, 'ing ', ''))) / 4 + 2 * (len(lang) - len(replace(lang, 'e', ''))) FROM documents UNION ALL SELECT doc_id, 'odd', 6 * (len(text) - len(replace(text, 'ed ', ''))) / 3 FROM documents),
        t AS (SELECT doc_id, label, CAST(sum(s) AS DOUBLE) AS s FROM s WHERE s > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER v AS i, coalesce(lead(s) OVER v, 0) AS nx FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY s DESC, label))
        SELECT doc_id, label, round(s, 2) AS score, round(s / (s + nx + 0.01), 3) AS confidence FROM r WHERE i = 1 AND s >= 3.0 AND (s - nx) / greatest(s, 1.0) >= 0.3""",
    "prefix_similarity": f"""WITH x AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}]+)'), lambda w: len(w) >= 2))) AS t FROM benchmark),
        h AS (SELECT b.item_id, {', '.join(f'{_hit(k)} AS h{i}' for i, k in enumerate(CATEGORY))} FROM benchmark b LEFT JOIN x USING (item_id) GROUP BY b.item_id)
        SELECT item_id, round(CASE WHEN {_NORM} > 0 THEN ({_DOT}) / (sqrt({_NORM}) * {_SIZE}) ELSE 0 END, 6) AS similarity FROM h""",
    "text_validity": """WITH x AS (SELECT doc_id, text, len(text) AS n, len(regexp_replace(text, '[^a-z]', '', 'g')) AS found, len(regexp_replace(text, '[^aeiou]', '', 'g')) AS v, len(regexp_replace(text, '[ \n]', '', 'g')) AS size,
          CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'and') AS INT) AS told, CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'and') AS INT) + CAST(contains(text, 'of') AS INT) AS told3 FROM documents)
        SELECT doc_id, coalesce(n >= 20 AND found > 0 AND NOT (told >= 2 AND n < 100) AND (contains(text, '?') OR contains(text, 'which') OR (found >= 10 AND n >= 50)), false) AS question,
          coalesce(n < 10 OR (told3 >= 3 AND n < 100) OR size = 0 OR (v / size < 0.05 AND size > 20) OR (NOT regexp_matches(text, '[0-9]+\\?') AND v / size < 0.2 AND size < 50), true) AS garbage FROM x""",
    "prerequisite_edges": f"""WITH {SQL['matrix']}, {_TREE}, c AS (SELECT topic % 25 + 100 AS src, topic % 7 + 100 AS dst, count(*) AS n FROM matrix GROUP BY ALL), t AS (SELECT DISTINCT src, dst FROM tree)
        SELECT src, dst, round(0.5 * 0.9 + 0.3 * coalesce(n % 10 / 10, 0) + 0.2 * least(1.0, coalesce(n % 9, 0) / 5), 4) AS weight, round(0.9 * (1 + 0.2 * least(1.0, coalesce(n % 9, 0) / 5)), 4) AS influence FROM t LEFT JOIN c USING (src, dst)""",
}
