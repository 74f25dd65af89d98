"""Small inputs on which the third round's findings failed."""

import collections
import math
import random
import re

import pytest
from oracle import DATA, duck_rows, spark_rows

from pyspark.sql import functions as F

from tessera.functions import text as text_functions
from test_pruned import best_cosines, corpus
from test_retrieval import brandes

from tessera.operators import classify, graph, planning, pruned, relational, retrieval, search
from tessera.plans import registry
from tessera.sources import tables


def same_as_sql(spark, name, folder):
    assert spark_rows(registry.QUERIES[name](spark, folder)) == duck_rows(registry.ORACLES[name], folder)


def test_review_queue_counts_letters_of_all_scripts_and_texts_without_characters(spark, tmp_path):
    texts = ["éèüöñ " * 20, "привет мир", "abc def", "!!!! ???? a", "", None, "日本語", "١٢٣ ٤٥٦"]
    docs = spark.createDataFrame([(60 + i, x) for i, x in enumerate(texts)] + [(5, "abc"), (161, "???")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(161,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    names, rows = spark_rows(registry.QUERIES["review_queue"](spark, str(tmp_path)))
    assert names == ["n", "why"] and rows == [(1, "confidence"), (1, "quality"), (7, "pending")]


def test_co_occurrence_makes_no_row_for_each_session_of_a_pair(spark, monkeypatch):
    random.seed(3)
    rows = [(g, random.randrange(70), random.choice([None, *range(60)])) for g in ("p", "q") for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, item long, session int").distinct()
    want = {}
    sets = {}
    for g, i, x in set(rows):
        sets.setdefault((g, i), set()).add(x)
    for (g, a), x in sets.items():
        for (h, b), y in sets.items():
            both = len(x & y - {None})
            if g == h and a < b and both >= 3:
                want[g, a, b] = (both, len(x) + len(y))
    monkeypatch.setattr(relational, "BLOCK", 32)
    by_bits = relational.sharing_pairs(df, "session", "item", 3, ["g"])
    assert {(r.g, r.a, r.b): (r.together, r._n) for r in by_bits.collect()} == want
    assert "Aggregate" not in by_bits._jdf.queryExecution().executedPlan().toString()  # pairs leave the join complete
    monkeypatch.setattr(relational, "SESSIONS", 9)
    by_rows = relational.sharing_pairs(df, "session", "item", 3, ["g"])
    assert {(r.g, r.a, r.b): (r.together, r._n) for r in by_rows.collect()} == want


def test_co_occurrence_score_makes_no_pairs_of_topics(spark):
    random.seed(4)
    rows = {(d, t, y) for d in ("a", "b") for t in range(40) for y in range(1, 31) if random.random() < 0.1} | {("c", 1, 30), ("c", 2, 3), ("c", 3, 29), ("c", 3, 3)}
    out = planning.co_occurrence_score(spark.createDataFrame([(*r, 1) for r in rows], "domain string, topic int, year int, cnt int"), 31)
    want = {}
    for d in "abc":
        of = {t: {y for e, u, y in rows if (e, u) == (d, t)} for e, t, _ in rows if e == d}
        active = [t for t in of if of[t] & {29, 30}]
        for t in of:
            shares = [len(of[r] & of[t]) / len(of[r]) for r in active if r != t]
            if any(shares):
                want[d, t] = round(min(1.0, 3 * sum(shares) / len(active)), 6)
    assert {(r.domain, r.topic): r.score for r in out.collect()} == pytest.approx(want, abs=1.1e-6)
    assert "NOT (_r" not in out._jdf.queryExecution().analyzed().toString()


def test_trend_probability_of_one_period(spark):
    out = planning.trend_probability(spark.createDataFrame([("a", 1, 3, 4), ("a", 2, 3, 4), ("a", 2, 4, 5)], "domain string, topic int, year int, cnt int"))
    assert {r.topic: r.p for r in out.collect()} == {1: 0.5, 2: 0.817574}


def test_char_ngrams_of_a_long_text(spark):
    text = "".join(random.Random(5).choices("abc é\n漢😀", k=60_000))
    df = spark.createDataFrame([(text,), ("😀a",), ("",), (None,)], "x string")
    got = [r.g for r in df.select(text_functions.char_ngrams(F.lower("x"), 3).alias("g")).collect()]
    assert got == [[text[i : i + 3] for i in range(len(text) - 2)], [], [], []]


def test_queries_of_many_lines_stay_in_parts_by_order(spark, monkeypatch):
    monkeypatch.setattr(tables, "MANY", 1)
    monkeypatch.setattr(tables, "PART_LINES", 300)
    rows = tables.questions(spark, DATA)
    assert rows.groupBy("exam_id").count()._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    for name in ("section_votes", "date_arithmetic", "equated_scores", "separation_quality", "personal_accuracy", "difficulty_audit"):
        same_as_sql(spark, name, DATA)


def test_document_terms_move_texts_once(spark):
    plan = registry.QUERIES["document_terms"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    same_as_sql(spark, "document_terms", DATA)


def test_overlaps_are_counted_without_pairs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, rng.choice([i, 7]), float(rng.randrange(60)), rng.randrange(-3, 9)) for k in ("a", "b", "c") for i in range(rng.choice([1, 200]) if k == "c" else 203)]
    rows = [(k, i, low, low + n) for k, i, low, n in rows] + [("a", None, 1.0, 2.0), ("a", 3, None, 2.0), (None, 4, 1.0, 2.0), ("z", 4, 1.0, 2.0)]
    want = {}
    for k, i, low, high in rows:
        if None not in (k, i, low):
            met = [j for g, j, x, y in rows if g == k and None not in (j, x) and j > i and low <= y and x <= high]
            n, last = want.get((k, i), (0, 0))
            want[k, i] = (n + len(met), max([last, *met]))
    want = {k: v for k, v in want.items() if v[0]}
    df = spark.createDataFrame(rows, "k string, id long, low double, high double")
    for size in (1, 50, 1000):
        monkeypatch.setattr(relational, "INTERVALS", size)
        out = relational.overlaps_after(df, ["k"], "id", "low", "high")
        assert {(r.k, r.a): (r.n, r.last) for r in out.collect()} == want
    same_as_sql(spark, "interval_overlap", DATA)


def test_trigrams_and_terms_meet_where_documents_are(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ASKED", 7)
    monkeypatch.setattr(retrieval, "PART", 90)
    plan = registry.QUERIES["trigram_matches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate explode(g" not in plan  # sets meet whole, no row for each trigram
    for name in ("term_ranks", "bm25_search"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "REPARTITION_BY_COL" in plan
    for name in ("trigram_matches", "term_ranks", "hybrid_search", "bm25_search"):
        same_as_sql(spark, name, DATA)


def test_communities_of_shared_sessions_make_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = {(x, i) for i in range(260) for x in range(30) if rng.random() < (0.75 if i % 3 == x % 3 else 0.2)} | {(None, 5), (3, None), (77, 900)}
    df = spark.createDataFrame(sorted(rows, key=str), "session int, item long")
    pairs = relational.co_occurrence(df.filter("item is not null"), "session", "item", 3).collect()
    assert len(pairs) > 20_000  # the former limit
    edges = spark.createDataFrame([("g", r.a, r.b, r.jaccard) for r in pairs], "graph string, src long, dst long, weight double")
    near = {}
    for r in pairs:
        near.setdefault(r.a, {})[r.b] = near.setdefault(r.b, {})[r.a] = r.jaccard
    home, degree = {v: v for v in near}, {v: sum(x.values()) for v, x in near.items()}
    total, whole = dict(degree), sum(degree.values())
    for _ in range(10):
        before = dict(home)
        for v in sorted(near):
            links = {}
            for u, w in sorted(near[v].items()):
                links[home[u]] = links.get(home[u], 0.0) + w
            total[home[v]] -= degree[v]
            home[v] = max(sorted({home[v], *links}), key=lambda c: (links.get(c, 0.0) - total[c] * degree[v] / whole, c == home[v]))
            total[home[v]] += degree[v]
        if home == before:
            break
    want = {v: min(u for u in home if home[u] == home[v]) for v in home}
    assert len(set(want.values())) > 1
    assert {r.node: r.community for r in classify.louvain(edges, "graph").collect()} == want
    found = classify.louvain_shared(df, "session", "item", 3)
    assert {r.node: r.community for r in found.collect()} == want and "Join" not in found._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")
    monkeypatch.setattr(relational, "SESSIONS", 9)
    assert {r.node: r.community for r in classify.louvain_shared(df, "session", "item", 3).collect()} == want


def test_char_ngram_vectors_shuffle_no_grams_of_documents(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices("abçd😀", k=rng.choice((1, 3, 9)))) for _ in range(rng.choice((0, 2, 60))))) for i in range(90)] + [(3, "ab\tAB\n"), (200, None), (201, "")]
    weights = {}
    monkeypatch.setattr(search, "CHARACTERS", 400)
    for some in (rows, rows[:90]):
        out = search.char_tfidf(spark.createDataFrame(some, "id long, text string").repartition(3), "id", "text", features=50)
        weights[len(some)] = {(r.id, r.gram): r.weight for r in out.collect()}
        tf = {}
        for i, text in some:
            tf.setdefault(i, collections.Counter()).update(p[j : j + n] for w in (text or "").lower().split() for p in [f" {w} "] for n in (1, 2, 3) for j in range(len(p) - n + 1))
        df = collections.Counter(g for c in tf.values() for g in c)
        kept = sorted((g for g in df if 2 <= df[g] <= 0.85 * len(some)), key=lambda g: (-sum(c[g] for c in tf.values()), g.encode()))[:50]
        want = {}
        for i, c in tf.items():
            v = {g: (1 + math.log(c[g])) * (1 + math.log((1 + len(some)) / (1 + df[g]))) for g in kept if c[g]}
            want |= {(i, g): x / math.sqrt(sum(x * x for x in v.values())) for g, x in v.items()}
        assert weights[len(some)] == pytest.approx(want, abs=1e-9)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_betweenness_makes_no_pairs_of_nodes(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(40), 100 - rng.randrange(40)) for _ in range(90)] + [(100 - i, rng.randrange(40)) for i in range(40)] + [(i, i + 1) for i in range(200, 230)] + [(None, 3), (7, 7)]
    out = graph.betweenness(spark.createDataFrame(edges, "src int, dst int"))
    want = brandes([e for e in edges if None not in e and e[0] != e[1]])
    got = {r.node: r.betweenness for r in out.collect()}
    assert got == pytest.approx(want, abs=2e-6) and any(got.values())
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_quality_counts_are_those_of_the_expressions(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(letters, k=rng.choice((2, 5, 9, 60)))) for letters in ("ab", "abc", "a😀", "é 　字", "ab\n。�\x85\x1c") for _ in range(60)]
    texts += ["abababa" + "bababcbcbcbc", "ababab" + "cbcbcbb", "aaaababab", "", "  \t", None, "ｱ１Ａー", "abababab\nxx"]
    count = lambda t: sum(len(m[0]) for p in (r"(?s)(.)\1{3,}", r"(?s)((.)(?!\2).)\1{2,}") for m in re.finditer(p, t))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rest = text_functions.bare(F.col("t"))
    odd = F.regexp_count(rest, F.lit(f"[^{text_functions.MEANINGFUL}{text_functions.PUNCTUATION}]"))
    known = F.regexp_count(rest, F.lit(f"[{text_functions.MEANINGFUL}]"))
    out = df.select("t", text_functions.repeated_characters(F.col("t")).alias("n"), F.length(rest).alias("rest"), odd.alias("odd"), known.alias("known"), text_functions.broken_share(F.col("t")).alias("broken"), text_functions.meaningful_share(F.col("t")).alias("share"))
    for r in out.collect():
        assert r.n == count(r.t or "")
        assert r.broken == (min(1.0, (r.odd + 0.5 * r.n) / r.rest) if r.rest else 1.0) and r.share == (r.known / r.rest if r.rest else 0.0)
    plan = registry.QUERIES["quality_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 1


def test_leaders_are_found_in_rounds_and_parts(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(g, i, [rng.gauss(0, 1) for _ in range(4)]) for g in ("a", "b", None) for i in rng.sample(range(1000), 90 if g else 5)] + [("b", 2000, [0.0] * 4)]
    want = {}
    for g in {r[0] for r in rows}:
        heads = []
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            near = [j for j, u in heads if sum(map(lambda p, q: p * q, u, v)) / (math.hypot(*u) * math.hypot(*v) or 1.0) >= 0.7]
            heads += [] if near else [(i, v)]
            want[g, i] = near[0] if near else i
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    for folded, met in ((7, 20), (1000, 1000)):
        monkeypatch.setattr(search, "FOLDED", folded)
        monkeypatch.setattr(search, "MET", met)
        assert sorted(map(tuple, search.leaders(df, "g", "i", "v", 0.7).collect()), key=str) == sorted(((g, i, j) for (g, i), j in want.items()), key=str)


def test_similar_documents_are_scored_in_parts_without_shuffled_postings(spark, monkeypatch):
    monkeypatch.setattr(pruned, "PART", 60)
    monkeypatch.setattr(pruned, "DOCS", 7)
    rows = corpus(13)
    docs = spark.createDataFrame([*rows, (None, "w1 w2")], "id long, text string")
    out = pruned.tfidf_top(docs, "id", "text", docs.filter("id % 5 = 0").select("id"), 4)
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append(-r.similarity)
    want = {q: [s for s, i in x if i is not None] for q, x in best_cosines([*rows, (None, "w1 w2")], [i for i, _ in rows if i % 5 == 0], 5).items()}
    assert found.keys() == {q for q, x in want.items() if x}
    for q, x in found.items():
        assert x == pytest.approx(want[q][: len(x)], abs=2e-6) and len(x) == min(4, len(want[q]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # words are met in their part, no pairs are joined
