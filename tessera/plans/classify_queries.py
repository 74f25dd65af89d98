"""Queries of label voting, recovery and fuzzy matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import classify as c
from tessera.sources.tables import SQL, questions, table, topic_days


def _recovered(s, d):
    t = F.lower("text")
    scores = {"en": F.regexp_count(t, F.lit(r"the ")), "de": F.regexp_count(t, F.lit(r"der ")), "fr": F.regexp_count(t, F.lit(r"les "))}
    label, confidence = c.recovered(scores)
    return table(s, d, "documents").select("doc_id", label.alias("label"), confidence.alias("confidence"))


def _votes(s, d):
    # two votes of a question, of 2 and of 3, as one row
    weight = F.lit(2.0) + F.when(F.col("difficulty") >= 25, 3.0).otherwise(0.0)
    votes = questions(s, d).select("exam_id", F.col("domain").alias("label"), weight.alias("w"))
    return c.section_votes(votes, ["exam_id"], "label", "w")


def _tags(s, d):
    words = [("the", "article", "word"), ("tion", "noun", "suffix"), ("and", "joiner", "word"), ("ing", "verb", "suffix"), (",", "comma", "sign")]
    return c.concept_tags(table(s, d, "documents"), "doc_id", "text", words, 4)


def _fuzzy(s, d):
    return c.fuzzy_found(table(s, d, "benchmark").select("item_id", "text"), "text", "thereof").select("item_id", "distance")


def _louvain(s, d):
    found = c.louvain_shared(topic_days(s, d).filter("domain = 'purchase'"), "year", "topic", least=3)
    return found.select(F.lit("g").alias("graph"), "node", "community")


QUERIES = {
    "recovered_labels": _recovered,
    "section_votes": _votes,
    "longest_keyword_topic": lambda s, d: table(s, d, "documents").select("doc_id", c.longest_keyword(F.col("text"), {"english": ["the ", "that "], "german": ["der ", "nicht "], "french": ["les ", "pour "]}).alias("topic")),
    "merged_blocks": lambda s, d: c.merged_blocks(table(s, d, "events").select("event_id", "event_type", F.col("user_id").cast("double").alias("x"), "value").filter("value is not null"), ["event_type"], "x", "value", "value", ["event_id"], 25.0).select("event_type", "event_id"),
    "concept_tags": _tags,
    "fuzzy_substring": _fuzzy,
    "louvain_communities": _louvain,
}

_COUNT = "(len(t) - len(replace(t, '{w}', ''))) / len('{w}')"

ORACLES = {
    "recovered_labels": f"""WITH x AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, {_COUNT.format(w='the ')} AS e, {_COUNT.format(w='der ')} AS g, {_COUNT.format(w='les ')} AS f FROM x),
        b AS (SELECT *, greatest(e, g, f) AS best, greatest(e + g + f, 1e-9) AS total FROM s), c AS (SELECT *, best / total * least(1.0, best / 4) AS conf FROM b)
        SELECT doc_id, CASE WHEN conf >= 0.5 THEN CASE WHEN e = best THEN 'en' WHEN g = best THEN 'de' ELSE 'fr' END END AS label, round(conf, 6) AS confidence FROM c""",
    "section_votes": f"""WITH {SQL['questions']}, v AS (SELECT exam_id, domain AS label, sum(2.0 + CASE WHEN difficulty >= 25 THEN 3.0 ELSE 0 END) AS w FROM questions GROUP BY ALL),
        k AS (SELECT *, sum(w) OVER (PARTITION BY exam_id) AS t, row_number() OVER (PARTITION BY exam_id ORDER BY w DESC, label) AS i FROM v) SELECT exam_id, label, round(w / t, 6) AS confidence FROM k WHERE i = 1""",
    "concept_tags": """WITH w AS (SELECT * FROM (VALUES ('the', 'article', 'word'), ('tion', 'noun', 'suffix'), ('and', 'joiner', 'word'), ('ing', 'verb', 'suffix'), (',', 'comma', 'sign')) t(w, tag, category)),
        f AS (SELECT doc_id, len(text) AS n, category, tag, instr(lower(text), w) AS "at" FROM documents, w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "at", category, tag) AS i FROM f WHERE "at" > 0)
        SELECT doc_id, category, tag, "at", round(1 - 0.5 * "at" / n, 6) AS confidence FROM r WHERE i <= 4""",
    "longest_keyword_topic": """WITH x AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'nicht ') THEN 'german' WHEN contains(t, 'that ') THEN 'english' WHEN contains(t, 'pour ') THEN 'french'
        WHEN contains(t, 'the ') THEN 'english' WHEN contains(t, 'der ') THEN 'german' WHEN contains(t, 'les ') THEN 'french' END AS topic FROM x""",
    "merged_blocks": """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, floor(user_id / 25.0 + 0.5), floor(value / 25.0 + 0.5) ORDER BY value DESC, event_id) AS i FROM events WHERE value IS NOT NULL) WHERE i = 1""",
}
