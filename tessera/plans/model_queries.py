"""Queries of forecasts, search, graphs, learner models and quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import split_of
from tessera.operators import forecast as f
from tessera.operators import graph as g
from tessera.operators import pruned
from tessera.operators import quality as q
from tessera.operators import relational as r
from tessera.operators import retrieval as re
from tessera.operators import search as se
from tessera.operators import student as st
from tessera.sources.tables import SQL, attempts, questions, scores, table, topic_days

AS_OF = "2024-02-01"


def _targets(s):
    return s.range(25, 31).select(F.col("id").cast("int").alias("target"))


def _blend(s, d):
    return f.blended(f.factors(topic_days(s, d), _targets(s), 1)).filter("rank <= 30").select("target", "domain", "topic", "probability", "rank")


def _factors(s, d):
    names = ["recency", "base", "cycle", "posterior", "momentum"]
    return f.factors(topic_days(s, d), _targets(s), 1).select("target", "domain", "topic", *[F.round(n, 6).alias(n) for n in names])


def _ranking(s, d):
    m = topic_days(s, d)
    ranked = m.filter("year <= 20").groupBy("domain", "topic").agg(F.sum("cnt").alias("n"))
    ranked = r.top_per_group(ranked, ["domain"], [F.desc("n"), F.asc("topic")], 40)
    return f.ranking_quality(ranked, m.filter("year = 21"), ["domain"], "topic")


def _clusters(s, d):
    m = topic_days(s, d).filter("domain = 'click'")
    p = m.groupBy("topic").agg((F.count("*") / 30).alias("p"))
    members = s.range(0, 150).select(F.col("id").alias("topic"), (F.col("id") % 12).alias("cluster"))
    return f.cluster_rollup(p, members, "topic", "cluster", "p")


def _bm25(s, d):
    return se.bm25(table(s, d, "documents"), table(s, d, "benchmark"), "doc_id", "text", "item_id")


def _bm25_pruned(s, d):
    return pruned.bm25_top(table(s, d, "documents"), table(s, d, "benchmark"), "doc_id", "text", "item_id")


def _texts(s, d):
    return table(s, d, "documents").select("doc_id", "text"), table(s, d, "benchmark").select("item_id", "text")


def _lexical(s, d):
    docs, asked = _texts(s, d)
    close = re.trigram_matches(docs, asked, "doc_id", "item_id", "text").select("item_id", "doc_id", F.lit(0.3).alias("lex"))
    ranks = re.term_rank(docs, asked, "doc_id", "item_id", "text").withColumnRenamed("rank", "lex")
    return close.unionByName(ranks).groupBy("item_id", "doc_id").agg(F.max("lex").alias("lex"))


def _nearest(s, d, asked, k, **more):
    v = table(s, d, "embeddings")
    centres = re.fitted_cells(v, "vec_id", "embedding", 16)
    rows = re.indexed(v, "vec_id", "embedding", centres)
    return rows, re.nearest_batch(rows, rows.filter(asked), "vec_id", centres, k, **more)


def _hybrid(s, d):
    # a text's own vector is that of its number; a document's that of its id
    items = table(s, d, "benchmark").select(F.col("item_id").cast("long").alias("vec_id"))
    v = table(s, d, "embeddings")
    centres = re.fitted_cells(v, "vec_id", "embedding", 16)
    rows = re.indexed(v, "vec_id", "embedding", centres)
    own = rows.join(items, "vec_id", "left_semi")
    near = re.nearest_batch(rows, own, "vec_id", centres, 16).select(F.col("query").alias("item_id"), F.col("vec_id").alias("doc_id"))
    near = near.union(own.select("vec_id", "vec_id"))  # a query is no row: the row of its number is one of its neighbours
    asked = own.select(F.col("vec_id").alias("item_id"), "unit")
    return re.hybrid_batch(_lexical(s, d), near, rows.withColumnRenamed("vec_id", "doc_id"), asked, "doc_id", "item_id")


def _tfidf(s, d):
    docs = table(s, d, "documents")
    return pruned.tfidf_top(docs, "doc_id", "text", docs.filter("doc_id % 100 = 0").select("doc_id"))


def _classified(s, d):
    v = table(s, d, "embeddings")
    return se.classified(v, "vec_id", "embedding", se.centroids(v, "label", "embedding"), "label")


def _edges(s, d):
    m = topic_days(s, d).filter("domain = 'purchase'")
    return r.co_occurrence(m, "year", "topic", least=2)


def _graph(s, d):
    return _edges(s, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("jaccard").alias("weight"))


def _tree(s, d):
    n = table(s, d, "nation")
    up = n.select((F.col("n_nationkey") + 100).alias("src"), F.col("n_regionkey").cast("int").alias("dst"))
    return up.union(n.select((F.col("n_nationkey") + 100), (F.col("n_nationkey") % 7 + 100))).filter("src <> dst")


def _causes(s, d):
    wrong = questions(s, d).filter("error_type = 'R'")
    causes = {"hard": F.col("difficulty") >= 40, "late": F.col("number") >= 5, "unsure": F.col("confidence") < 0.95}
    return st.root_causes(wrong, ["topic"], causes)


def _priorities(s, d):
    own = st.mastery(attempts(s, d), ["student", "topic"], "ts", AS_OF)
    forecast = attempts(s, d).groupBy("topic").agg((F.countDistinct("student") / 1000).alias("probability"))
    return st.prioritised(own, forecast, ["student", "topic"], 3)


def _diagnosis(s, d):
    own = st.mastery(attempts(s, d), ["student", "topic"], "ts", AS_OF)
    return st.diagnosis(own, ["student", "topic"], {"few": F.col("n") < 3, "low": F.col("mean") < 0.4, "stale": F.col("days") > 20})


def _gate(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return q.gate(docs, {"text": F.length("text") >= 50, "language": F.col("lang").isin("en", "de", "fr", "es"), "labelled": F.col("quality").isNotNull(), "length": F.length("text") == F.col("n_chars")})


#: Trigram sets as (id, g); the pairs close enough; the documents that hold all terms, and the greater of both scores.
_GRAMS = r"list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_LEXICAL_SQL = rf"""WITH gd AS (SELECT doc_id, {_GRAMS} AS g FROM documents), gq AS (SELECT item_id, {_GRAMS} AS g FROM benchmark),
        close AS (SELECT item_id, doc_id, len(list_intersect(q.g, d.g)) / (len(q.g) + len(d.g) - len(list_intersect(q.g, d.g))) AS similarity FROM gq q JOIN gd d
            ON len(d.g) >= 0.3 * len(q.g) AND 0.3 * len(d.g) <= len(q.g) WHERE len(list_intersect(q.g, d.g)) / (len(q.g) + len(d.g) - len(list_intersect(q.g, d.g))) >= 0.3),
        td AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents), tp AS (SELECT doc_id, term, count(*) AS tf FROM td GROUP BY ALL),
        tq AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS term FROM benchmark), tn AS (SELECT item_id, count(*) AS n FROM tq GROUP BY 1),
        ranks AS (SELECT item_id, doc_id, sum(list_sum(list_transform(range(1, least(tf, 256) + 1), lambda i: 1.0::DOUBLE / (i * i))) * (0.1::DOUBLE / 1.6449340668482264)) / any_value(n) AS rank
            FROM tq JOIN tp USING (term) JOIN tn USING (item_id) GROUP BY ALL HAVING count(*) = any_value(n)),
        lexical AS (SELECT item_id, doc_id, max(lex) AS lex FROM (SELECT item_id, doc_id, 0.3::DOUBLE AS lex FROM close UNION ALL SELECT item_id, doc_id, rank FROM ranks) GROUP BY ALL)"""

QUERIES = {
    "forecast_factors": _factors,
    "forecast_blend": _blend,
    "forecast_markov": lambda s, d: f.markov(topic_days(s, d), 1, 30),
    "forecast_hidden_trend": lambda s, d: f.hidden_trend(topic_days(s, d), 31),
    "forecast_backtest": lambda s, d: f.backtest(topic_days(s, d), _targets(s), 1, 0.3),
    "forecast_next_value": lambda s, d: f.next_value(topic_days(s, d)),
    "forecast_dynamic_n": lambda s, d: f.dynamic_n(topic_days(s, d), 31),
    "topic_records": lambda s, d: f.record(topic_days(s, d), 30),
    "ranking_quality": _ranking,
    "cluster_rollup": _clusters,
    "bm25_search": _bm25,
    "bm25_pruned": _bm25_pruned,
    "tfidf_similar": _tfidf,
    "vector_nearest": lambda s, d: se.nearest(table(s, d, "embeddings"), "vec_id", "embedding", 3),
    "hybrid_search": _hybrid,
    "trigram_matches": lambda s, d: re.trigram_matches(*_texts(s, d), "doc_id", "item_id", "text").select("item_id", "doc_id", F.round("similarity", 6).alias("similarity")),
    "term_ranks": lambda s, d: re.term_rank(*_texts(s, d), "doc_id", "item_id", "text").select("item_id", "doc_id", F.round("rank", 6).alias("rank")),
    "vector_nearest_batch": lambda s, d: _nearest(s, d, F.col("vec_id") % 100 == 0, 20)[1],
    "centroid_classifier": _classified,
    "leader_clusters": lambda s, d: se.leaders(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.4),
    "document_terms": lambda s, d: se.related_terms(table(s, d, "documents"), "doc_id", "text", 5),
    "graph_statistics": lambda s, d: r.co_occurrence_statistics(topic_days(s, d).filter("domain = 'purchase'"), "year", "topic", least=2),
    "graph_degrees": lambda s, d: g.degrees(_graph(s, d)),
    "graph_pagerank": lambda s, d: g.pagerank(_tree(s, d)),
    "graph_reachable": lambda s, d: g.reachable(_tree(s, d), 4),
    "graph_bottlenecks": lambda s, d: g.bottlenecks(_tree(s, d), least=1.0),
    "graph_cycles": lambda s, d: g.in_cycle(_tree(s, d), 8),
    "graph_boosts": lambda s, d: g.boosted(s.range(0, 150).select(F.col("id").alias("node"), (F.col("id") % 10 / 10).alias("p")), _graph(s, d)),
    "similarity_edges": lambda s, d: g.similarity_edges(_edges(s, d)),
    "graph_audit": lambda s, d: g.audit(_tree(s, d), s.range(0, 120).select(F.col("id").cast("int").alias("node"))),
    "knowledge_tracing": lambda s, d: st.knowledge_traced(attempts(s, d), ["student", "topic"], ["ts", "event_id"]),
    "spaced_repetition": lambda s, d: st.spaced(attempts(s, d), ["student"], ["ts", "event_id"]),
    "topic_mastery": lambda s, d: st.mastery(attempts(s, d), ["student", "topic"], "ts", AS_OF),
    "review_schedule": lambda s, d: st.review_schedule(st.mastery(attempts(s, d), ["student", "topic"], "ts", AS_OF), ["student", "topic"]),
    "domain_weakness": lambda s, d: st.domain_weakness(questions(s, d).filter("error_type = 'R'"), ["student", "domain"], "date", "2001-09-01"),
    "root_causes": _causes,
    "study_priorities": _priorities,
    "diagnosis_rules": _diagnosis,
    "score_prediction": lambda s, d: st.study_value(scores(s, d), ["student"], "score", ["date", "exam"], 250000.0),
    "quality_gate": _gate,
    "exam_validation": lambda s, d: q.validated(questions(s, d), ["domain", "exam_year", "exam_round"], "confidence", low=0.92),
    "confidence_summary": lambda s, d: q.confidence_summary(questions(s, d), "confidence"),
    "corpus_statistics": lambda s, d: q.corpus_statistics(table(s, d, "documents"), "text", "lang", "source"),
    "training_export": lambda s, d: q.training_rows(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "doc_id", "lang", ["source", "n_chars"], "quality", split_of(F.col("source"))),
    "qa_dataset": lambda s, d: q.qa_rows(table(s, d, "part"), "p_partkey", {"brand": F.col("p_brand"), "size": F.when(F.col("p_size") > 25, F.col("p_size"))}),
}


def _m(body):
    return f"WITH {SQL['matrix']} {body}"


def _q(body):
    return f"WITH {SQL['questions']} {body}"


_FACTORS = """, t AS (SELECT CAST(range AS INTEGER) AS target FROM range(25, 31)),
  s AS (SELECT target, domain, topic, year, cnt, year - lag(year) OVER (PARTITION BY target, domain, topic ORDER BY year) AS gap FROM matrix JOIN t ON year < target),
  a AS (SELECT target, domain, topic, count(*) AS active, sum(cnt) AS total, max(year) AS last, avg(gap) AS gap, coalesce(stddev_pop(gap), 0) AS sd,
               sum(cnt * exp(-ln(2) / 3 * (target - year))) AS weighted, sum(CASE WHEN year >= target - 5 THEN cnt ELSE 0 END) AS recent FROM s GROUP BY ALL),
  c AS (SELECT *, least(1.0, weighted / (5 * (SELECT sum(exp(-ln(2) / 3 * y)) FROM range(1, target) r(y)))) AS recency,
               0.4 * active / (target - 1) + 0.6 * least(1.0, total / active / 15) AS base,
               CASE WHEN gap IS NULL THEN 0.3 WHEN round(sd / gap, 9) < 0.5 AND target - last >= round(gap, 9) THEN least(1.0, 0.6 + 0.1 * (target - last - gap))
                    WHEN target - last >= round(gap, 9) THEN 0.5 ELSE greatest(0.1, 0.4 * (target - last) / gap) END AS cycle,
               (active + 3) / (target - 1 + 6) AS posterior, least(1.0, recent / 5) AS momentum FROM a),
  b AS (SELECT *, round(greatest(0.01, least(0.99, 0.30 * recency + 0.20 * base + 0.15 * cycle + 0.20 * posterior + 0.15 * momentum)), 6) AS probability FROM c)"""
_TREE = """tree AS (SELECT n_nationkey + 100 AS src, n_regionkey AS dst FROM nation UNION ALL SELECT n_nationkey + 100, n_nationkey % 7 + 100 FROM nation WHERE n_nationkey <> n_nationkey % 7)"""
_CO = """, p AS (SELECT year, topic FROM matrix WHERE domain = 'purchase'), c AS (SELECT topic, count(*) AS n FROM p GROUP BY 1),
  t AS (SELECT x.topic AS a, y.topic AS b, count(*) AS together FROM p x JOIN p y ON x.year = y.year AND x.topic < y.topic GROUP BY ALL HAVING count(*) >= 2),
  e AS (SELECT a, b, together, round(together / (ca.n + cb.n - together), 6) AS jaccard FROM t JOIN c ca ON ca.topic = a JOIN c cb ON cb.topic = b)"""
_TOKENS = "list_filter(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)'), lambda w: len(w) >= 2)"
_REACH = f"""WITH RECURSIVE {_TREE}, reach(src, dst, hops) AS (SELECT DISTINCT src, dst, 1 FROM tree UNION SELECT r.src, t.dst, hops + 1 FROM reach r JOIN tree t ON r.dst = t.src WHERE hops < {{depth}}),
  best AS (SELECT src, dst, min(hops) AS hops FROM reach GROUP BY ALL)"""
_MASTERY = f"""WITH {SQL['attempts']}, m AS (SELECT student, topic, count(*) AS n, count(*) FILTER (correct) AS "right", CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '{AS_OF}') AS BIGINT) AS days FROM attempts GROUP BY ALL),
  p AS (SELECT *, "right" + 1.0 AS a, n - "right" + 1.0 AS b FROM m), v AS (SELECT *, a / (a + b) AS mean0, sqrt(a * b / (power(a + b, 2) * (a + b + 1))) AS sd FROM p),
  mastery AS (SELECT student, topic, n, "right", round(mean0, 6) AS mean, round(greatest(0.0, mean0 - 1.645 * sd), 6) AS low, round(least(1.0, mean0 + 1.645 * sd), 6) AS high, days,
              round(exp(-days / greatest(1.0 + "right", 0.1)), 6) AS retention FROM v)"""

ORACLES = {
    "forecast_factors": _m(_FACTORS + " SELECT target, domain, topic, round(recency, 6) AS recency, round(base, 6) AS base, round(cycle, 6) AS cycle, round(posterior, 6) AS posterior, round(momentum, 6) AS momentum FROM c"),
    "forecast_blend": _m(_FACTORS + ", r AS (SELECT target, domain, topic, probability, CAST(row_number() OVER (PARTITION BY target ORDER BY probability DESC, domain, topic) AS INTEGER) AS rank FROM b) SELECT * FROM r WHERE rank <= 30"),
    "forecast_markov": _m(
        """, x AS (SELECT domain, topic, year, lead(year) OVER (PARTITION BY domain, topic ORDER BY year) AS nx FROM matrix),
        y AS (SELECT domain, topic, count(*) FILTER (nx = year + 1) AS n11, count(*) AS present, min(year) AS a, max(year) AS b FROM x GROUP BY ALL),
        z AS (SELECT *, present - n11 - CAST(b = 30 AS INT) AS n10, present - n11 - CAST(a = 1 AS INT) AS n01 FROM y), w AS (SELECT *, 29 - n11 - n10 - n01 AS n00 FROM z)
        SELECT domain, topic, n11, n10, n01, n00, round(CASE WHEN b = 30 THEN (n11 + 1) / (n11 + n10 + 2) ELSE (n01 + 1) / (n00 + n01 + 2) END, 6) AS chance FROM w"""
    ),
    "forecast_hidden_trend": _m(
        """, h AS (SELECT domain, topic, round(avg(cnt) FILTER (year >= 25), 6) AS recent, round(avg(cnt) FILTER (year < 25), 6) AS older FROM matrix WHERE year < 31 GROUP BY ALL)
        SELECT *, CASE WHEN recent IS NULL THEN 'gone' WHEN older IS NULL THEN 'new' WHEN recent > 1.5 * older THEN 'up' WHEN recent * 1.5 < older THEN 'down' ELSE 'steady' END AS state FROM h"""
    ),
    "forecast_backtest": _m(
        _FACTORS
        + """, p AS (SELECT target, domain, topic FROM b WHERE probability >= 0.3), act AS (SELECT target, domain, topic FROM matrix JOIN t ON year = target),
        j AS (SELECT coalesce(p.target, act.target) AS target, p.topic AS p, act.topic AS a FROM p FULL JOIN act ON p.target = act.target AND p.domain = act.domain AND p.topic = act.topic),
        k AS (SELECT target, count(p + a) AS tp, count(p) AS predicted, count(a) AS actual FROM j GROUP BY target), m AS (SELECT *, tp / greatest(predicted, 1) AS pr, tp / greatest(actual, 1) AS re FROM k)
        SELECT target, tp, predicted, actual, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(0.001, pr + re), 6) AS f1 FROM m"""
    ),
    "forecast_next_value": _m(
        """, x AS (SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY year DESC) AS r FROM matrix)
        SELECT domain, topic, round(greatest(0.0, avg(cnt) + 0.5 * (sum(cnt) FILTER (r = 1) - sum(cnt) FILTER (r = 3))), 6) AS expected FROM x WHERE r <= 3 GROUP BY domain, topic HAVING count(*) = 3"""
    ),
    "forecast_dynamic_n": _m(
        """, y AS (SELECT domain, year, count(DISTINCT topic) AS n FROM matrix WHERE year < 31 GROUP BY ALL),
        a AS (SELECT domain, coalesce(avg(n) FILTER (year >= 28), 0) AS recent, coalesce(regr_slope(CASE WHEN year >= 21 THEN CAST(n AS DOUBLE) END, CAST(year AS DOUBLE)), 0) AS slope FROM y GROUP BY domain)
        SELECT domain, round(slope, 6) AS slope, greatest(8, least(28, CAST(floor(recent + 3 * slope + 0.5) AS INTEGER))) AS n FROM a"""
    ),
    "topic_records": _m(
        """, a AS (SELECT domain, topic, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS active, min(year) AS first, max(year) AS last, CAST(coalesce(sum(cnt) FILTER (year > 25), 0) AS BIGINT) AS recent5,
                          CAST(coalesce(sum(cnt) FILTER (year > 20), 0) AS BIGINT) AS recent10 FROM matrix GROUP BY ALL),
        b AS (SELECT *, round(CASE WHEN recent10 > recent5 THEN 100.0 * (recent5 - (recent10 - recent5)) / (recent10 - recent5) WHEN recent5 > 0 THEN 100.0 ELSE 0.0 END, 4) AS growth,
                     round(100.0 * total / sum(total) OVER (PARTITION BY domain), 6) AS share FROM a)
        SELECT *, CASE WHEN last <= 20 THEN 'disappearing' WHEN first > 20 THEN 'emerging' WHEN growth > 20 THEN 'growing' WHEN growth < -20 THEN 'declining' ELSE 'stable' END AS category FROM b"""
    ),
    "ranking_quality": _m(
        """, s AS (SELECT domain, topic, sum(cnt) AS n FROM matrix WHERE year <= 20 GROUP BY ALL), r AS (SELECT domain, topic, row_number() OVER (PARTITION BY domain ORDER BY n DESC, topic) AS rank FROM s),
        h AS (SELECT r.*, CASE WHEN m.topic IS NULL THEN 0 ELSE 1 END AS h FROM r LEFT JOIN matrix m ON m.year = 21 AND m.domain = r.domain AND m.topic = r.topic WHERE rank <= 40),
        c AS (SELECT *, sum(h) OVER (PARTITION BY domain ORDER BY rank) AS c, sum(h) OVER (PARTITION BY domain) AS n FROM h)
        SELECT domain, CAST(sum(h) AS BIGINT) AS hits, round(coalesce(sum(h * c / rank) / nullif(sum(h), 0), 0), 6) AS average_precision,
               round(coalesce(sum(h / log2(rank + 1)) / nullif(sum(CASE WHEN rank <= n THEN 1 / log2(rank + 1) ELSE 0 END), 0), 0), 6) AS ndcg FROM c GROUP BY domain"""
    ),
    "cluster_rollup": _m(
        """, p AS (SELECT topic, count(*) / 30 AS p FROM matrix WHERE domain = 'click' GROUP BY topic)
        SELECT range % 12 AS cluster, count(*) AS members, round(avg(coalesce(p, 0.2)), 6) AS mean, round(max(coalesce(p, 0.2)), 6) AS highest FROM range(0, 150) LEFT JOIN p ON topic = range GROUP BY 1"""
    ),
    "bm25_search": f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), l AS (SELECT doc_id, greatest(len(t), 1) AS len, unnest(t) AS term FROM d),
        p AS (SELECT doc_id, len, term, count(*) AS tf FROM l GROUP BY ALL), n AS (SELECT count(*) AS n, avg(greatest(len(t), 1)) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len / avgdl))) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL),
        o AS (SELECT item_id, doc_id, round(score / max(score) OVER (PARTITION BY item_id), 6) AS score FROM s),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM o WHERE score > 0.001) SELECT * FROM r WHERE rank <= 12""",
    "document_terms": f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS i FROM p) SELECT doc_id, string_agg(term, ',' ORDER BY i) AS terms FROM r WHERE i <= 5 GROUP BY doc_id""",
    "hybrid_search": _LEXICAL_SQL + """, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
        y AS (SELECT item_id, e.vec_id AS doc_id, round(list_cosine_similarity(e.v, o.v), 6) AS sim FROM benchmark b JOIN e o ON o.vec_id = b.item_id, e),
        z AS (SELECT item_id, doc_id, round(0.55 * coalesce(lex, 0) + 0.45 * coalesce(sim, 0), 6) AS score FROM lexical FULL JOIN y USING (item_id, doc_id)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM z WHERE score > 0) SELECT * FROM r WHERE rank <= 15""",
    "trigram_matches": _LEXICAL_SQL + " SELECT item_id, doc_id, round(similarity, 6) AS similarity FROM close",
    "term_ranks": _LEXICAL_SQL + " SELECT item_id, doc_id, round(rank, 6) AS rank FROM ranks",
    "vector_nearest_batch": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS similarity FROM e q, e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 20""",
    "centroid_classifier": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
        m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
        s AS (SELECT vec_id, c.label, round(list_cosine_similarity(v, c), 6) AS s FROM e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS i FROM s)
        SELECT vec_id, max(label) FILTER (i = 1) AS predicted, max(s) FILTER (i = 1) AS similarity, round(max(s) FILTER (i = 1) - max(s) FILTER (i = 2), 6) AS margin FROM r GROUP BY vec_id""",
    "vector_nearest": """WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id = 3)
        SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q), 6) AS similarity FROM embeddings, q WHERE vec_id <> 3 ORDER BY similarity DESC, vec_id LIMIT 20""",
    "graph_statistics": _m(_CO + ", v AS (SELECT a AS v FROM e UNION SELECT b FROM e) SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, round(2 * count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) AS density, round(avg(jaccard), 6) AS mean_weight FROM e"),
    "graph_degrees": _m(_CO + ", v AS (SELECT a AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT b, 1, 0 FROM e) SELECT node, sum(i) AS indegree, sum(o) AS outdegree FROM v GROUP BY node"),
    "graph_reachable": _REACH.replace("{depth}", "4") + " SELECT * FROM best",
    "graph_cycles": _REACH.replace("{depth}", "8") + " SELECT src AS node FROM best WHERE src = dst",
    "graph_bottlenecks": _REACH.replace("{depth}", "5") + """, o AS (SELECT src AS node, count(DISTINCT dst) AS outdegree FROM tree GROUP BY 1), d AS (SELECT src AS node, max(hops) AS depth FROM best GROUP BY 1)
        SELECT node, outdegree, depth, round(0.6 * outdegree + 0.4 * depth, 4) AS score FROM o JOIN d USING (node) WHERE 0.6 * outdegree + 0.4 * depth >= 1.0""",
    "graph_boosts": _m(_CO + """, n AS (SELECT range AS node, range % 10 / 10 AS p FROM range(0, 150)), g AS (SELECT b AS node, sum(0.3 * jaccard * p) AS g FROM e JOIN n ON n.node = a WHERE p >= 0.2 GROUP BY b)
        SELECT n.node, round(least(1.0, p + coalesce(g, 0)), 6) AS p FROM n LEFT JOIN g ON g.node = n.node"""),
    "similarity_edges": _m(_CO + " SELECT a AS src, b AS dst, round(0.4 * jaccard + 0.6 * least(1.0, together / 8), 6) AS weight FROM e WHERE round(0.4 * jaccard + 0.6 * least(1.0, together / 8), 6) >= 0.3"),
    "graph_audit": f"""WITH {_TREE}, n AS (SELECT range AS node FROM range(0, 120)), u AS (SELECT src AS node FROM tree UNION SELECT dst FROM tree)
        SELECT 'unknown_source' AS fault, count(*) AS n FROM tree WHERE src NOT IN (SELECT node FROM n) UNION ALL SELECT 'unknown_target', count(*) FROM tree WHERE dst NOT IN (SELECT node FROM n)
        UNION ALL SELECT 'loop', count(*) FROM tree WHERE src = dst UNION ALL SELECT 'repeated', count(*) FROM (SELECT src, dst FROM tree GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'orphan', count(*) FROM n WHERE node NOT IN (SELECT node FROM u)""",
    "topic_mastery": _MASTERY + " SELECT * FROM mastery",
    "review_schedule": _MASTERY + " SELECT student, topic, retention, CAST(row_number() OVER (PARTITION BY student ORDER BY retention, n DESC, topic) AS INTEGER) AS position FROM mastery WHERE retention < 0.6",
    "diagnosis_rules": _MASTERY + """ SELECT student, topic, 0 AS priority, 'few' AS finding FROM mastery WHERE n < 3 UNION ALL SELECT student, topic, 1, 'low' FROM mastery WHERE mean < 0.4
        UNION ALL SELECT student, topic, 2, 'stale' FROM mastery WHERE days > 20""",
    "study_priorities": _MASTERY + """, f AS (SELECT topic, count(DISTINCT student) / 1000 AS probability FROM attempts GROUP BY topic), pr AS (SELECT student, topic, round(coalesce(probability, 0.2) * (1 - mean), 6) AS priority FROM mastery LEFT JOIN f USING (topic)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY student ORDER BY priority DESC, topic) AS INTEGER) AS rank FROM pr) SELECT * FROM r WHERE rank <= 3""",
    "domain_weakness": _q("""SELECT student, domain, count(*) AS n, round(least(1.0, sum(greatest(0.5, 1 - 0.05 * (2001 * 12 + 9 - year(date) * 12 - month(date)))) / greatest(1.0, count(*) / 2)), 6) AS weakness
        FROM questions WHERE error_type = 'R' GROUP BY ALL"""),
    "root_causes": _q(""", s AS (SELECT topic, sum(CAST(difficulty >= 40 AS DOUBLE)) AS hard, sum(CAST(number >= 5 AS DOUBLE)) AS late, sum(CAST(confidence < 0.95 AS DOUBLE)) AS unsure FROM questions WHERE error_type = 'R' GROUP BY topic),
        u AS (UNPIVOT s ON hard, late, unsure INTO NAME cause VALUE score) SELECT topic, cause, score, round(coalesce(100.0 * score / nullif(sum(score) OVER (PARTITION BY topic), 0), 0), 4) AS pct FROM u"""),
    "score_prediction": f"""WITH {SQL['scores']}, r AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY date DESC, exam DESC) AS r FROM scores),
        a AS (SELECT student, count(*) AS n, round(sum(score * (7 - r)) / sum(7 - r), 4) AS expected FROM r WHERE r <= 6 GROUP BY student) SELECT *, expected >= 250000.0 AS reaches FROM a""",
    "quality_gate": """WITH d AS (SELECT text, lang, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)), v AS (
          SELECT 'text' AS rule, count(*) FILTER (NOT coalesce(len(text) >= 50, FALSE)) AS violations, count(*) AS checked FROM d UNION ALL SELECT 'language', count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), FALSE)), count(*) FROM d
          UNION ALL SELECT 'labelled', count(*) FILTER (quality IS NULL), count(*) FROM d UNION ALL SELECT 'length', count(*) FILTER (NOT coalesce(len(text) = n_chars, FALSE)), count(*) FROM d) SELECT *, violations = 0 AS passed FROM v""",
    "exam_validation": _q(""", a AS (SELECT domain, exam_year, exam_round, count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS lowest, max(confidence) AS highest, count(*) FILTER (confidence < 0.92) AS low FROM questions GROUP BY ALL)
        SELECT *, CASE WHEN low / n > 0.3 THEN 'FAIL' WHEN low / n > 0.1 THEN 'WARN' ELSE 'PASS' END AS status FROM a"""),
    "confidence_summary": _q("""SELECT count(*) AS n, round(avg(confidence), 6) AS mean, count(*) FILTER (confidence < 0.92) AS bucket_0, count(*) FILTER (confidence >= 0.92 AND confidence < 0.94) AS bucket_1,
        count(*) FILTER (confidence >= 0.94 AND confidence < 0.96) AS bucket_2, count(*) FILTER (confidence >= 0.96 AND confidence < 0.98) AS bucket_3, count(*) FILTER (confidence >= 0.98) AS bucket_4 FROM questions"""),
    "corpus_statistics": """SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS without_text, count(*) FILTER (len(text) < 50) AS short, CAST(sum(len(text)) AS BIGINT) AS chars, min(len(text)) AS shortest, max(len(text)) AS longest,
        count(DISTINCT lang) AS labels, count(DISTINCT source) AS groups FROM documents""",
    "qa_dataset": "SELECT p_partkey, 'brand' AS question, p_brand AS answer FROM part WHERE p_brand <> '' UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 25",
}

#: The same rows by bounds.
ORACLES["bm25_pruned"] = ORACLES["bm25_search"]
