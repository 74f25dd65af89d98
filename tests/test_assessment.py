"""Folds, iterations, search boosts and vectors against brute force on small rows."""

import datetime
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import assessment, graph, horizons, search
from tessera.sources import tables


def test_tracked_mastery(spark):
    rng = random.Random(3)
    rows = [(s, t, datetime.datetime(2024, 1, d), i, rng.random() < 0.6) for i, (s, t, d) in enumerate((s, t, d) for s in (1, 2) for t in "ab" for d in sorted(rng.sample(range(1, 29), 6)))]
    df = spark.createDataFrame(rows, "student int, topic string, ts timestamp, event_id int, correct boolean")
    got = {(r.student, r.topic): (r.n, r.mastery, r.confidence) for r in assessment.tracked_mastery(df, ["student", "topic"], ["ts", "event_id"]).collect()}
    for key in {(r[0], r[1]) for r in rows}:
        a = b = 1.0
        p, right, last = 0.3, 0, None
        for _, _, ts, _, ok in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            weight = 1.0 if last is None else 2 - math.exp(-(ts - last).days / max(1 + right, 0.1))
            known = p * 0.9 / (p * 0.9 + (1 - p) * 0.2) if ok else p * 0.1 / (p * 0.1 + (1 - p) * 0.8)
            p = known + (1 - known) * 0.15
            a, b, right, last = a + weight * ok, b + weight * (not ok), right + ok, ts
        sd = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert got[key][0] == 6
        assert abs(got[key][1] - (0.6 * a / (a + b) + 0.4 * p)) < 2e-6 and abs(got[key][2] - max(0, min(1, 1 - 2 * sd))) < 2e-6


def test_eigenvector(spark):
    edges = [(1, 2, 1.0), (2, 3, 0.5), (3, 1, 0.7), (3, 4, 0.2), (1, 2, 0.4)]
    got = {r.node: r.centrality for r in graph.eigenvector(spark.createDataFrame(edges, "src int, dst int, weight double")).collect()}
    heaviest = {}
    for s, d, w in edges:
        heaviest[s, d] = max(w, heaviest.get((s, d), 0))
    x = dict.fromkeys((1, 2, 3, 4), 0.25)
    for _ in range(100):
        y = dict.fromkeys(x, 0.0)
        for (s, d), w in heaviest.items():
            y[d] += x[s] * w
            y[s] += x[d] * w * 0.5
        size = math.sqrt(sum(v * v for v in y.values()))
        y = {k: v / size for k, v in y.items()}
        moved, x = sum(abs(y[k] - x[k]) for k in x), y
        if moved < 1e-6:
            break
    assert all(abs(got[k] - x[k]) < 1e-5 for k in x)
    assert graph.eigenvector(spark.createDataFrame([], "src int, dst int, weight double")).count() == 0


def test_char_tfidf(spark):
    docs = [(1, "ab abc"), (2, "ab  zz\nAB"), (3, "q"), (4, ""), (5, None), (6, "bc q")]
    got = {(r.id, r.gram): r.weight for r in search.char_tfidf(spark.createDataFrame(docs, "id int, text string"), "id", "text", features=6).collect()}
    tf = {}
    for key, text in docs:
        tf[key] = Counter(p[i : i + n] for w in (text or "").lower().split() for p in [f" {w} "] for n in (1, 2, 3) for i in range(len(p) - n + 1))
    df = Counter(g for c in tf.values() for g in c)
    kept = sorted((g for g in df if 2 <= df[g] <= 0.85 * len(docs)), key=lambda g: (-sum(c[g] for c in tf.values()), g))[:6]
    want = {}
    for key, c in tf.items():
        v = {g: (1 + math.log(c[g])) * (1 + math.log((1 + len(docs)) / (1 + df[g]))) for g in kept if c[g]}
        size = math.sqrt(sum(x * x for x in v.values()))
        want |= {(key, g): x / size for g, x in v.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_search_boosts(spark):
    docs = spark.createDataFrame([(1, "red fish", "sea", "eco"), (2, "red fish", "land", "pol"), (3, "red", "sea", "pol"), (4, "blue", "sea", "eco")], "doc int, text string, topic string, domain string")
    asked = spark.createDataFrame([(9, "red fish", ["sea"], ["eco"])], "q int, text string, topic array<string>, domain array<string>")
    boosts = search.match_boosts(docs, asked, "doc", "q", "topic", "domain")
    assert {r.doc: round(r.factor, 6) for r in boosts.collect()} == {1: 1.68, 3: 1.5, 4: 1.68}
    plain = {r.doc: r.score for r in search.bm25(docs, asked, "doc", "text", "q").collect()}
    raised = {r.doc: r.score for r in search.bm25(docs, asked, "doc", "text", "q", boosts=boosts).collect()}
    assert plain[1] == plain[2] == 1.0 and raised[1] == 1.0 and abs(raised[2] - 1 / 1.68) < 1e-5


def test_boosted_similar(spark):
    pairs = spark.createDataFrame([(1, 2, 0.2), (1, 3, 0.1), (1, 4, 0.95), (1, 5, 0.05)], "query int, doc int, similarity double")
    about = spark.createDataFrame([(1, "d", "cat", ["a", "b"]), (2, "d", "wild cat", ["a"]), (3, "", "", None), (4, "d", "cat", ["a", "b"]), (5, None, None, ["b"])], "doc int, domain string, topic string, tags array<string>")
    got = [tuple(r) for r in search.boosted_similar(pairs, about, "query", "doc").orderBy("rank").collect()]
    # 5 is 0.05 + 0.05: not strictly above the least
    assert got == [(1, 4, 1.0, "text_match", 1), (1, 2, 0.7, "hybrid", 2)]


def test_similarity_edges_leave_out_known_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, 8), (2, 3, 0.9, 8), (3, 4, 0.9, 1)], "a int, b int, jaccard double, together int")
    known = spark.createDataFrame([(2, 1)], "src int, dst int")
    assert [(r.src, r.dst, r.weight) for r in graph.similarity_edges(pairs, known=known).collect()] == [(2, 3, 0.96)]


def test_rule_classifiers(spark):
    df = spark.createDataFrame([(1, "次の問いに答えよ。需要と供給について説明しなさい。"), (2, "注意事項 鉛筆 これは長い本文ではありませんよね"), (3, "abc"), (4, None)], "id int, text string")
    script, told = r"[぀-ヿ一-鿿]", ["注意事項", "鉛筆"]
    got = {r.id: (r.q, r.g) for r in df.select("id", assessment.is_question(F.col("text"), script, told, ["問", "①"]).alias("q"), assessment.is_garbage(F.col("text"), script, told, r"問\s*\d+").alias("g")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True), 4: (False, True)}


def test_lock_list(spark, tmp_path):
    import hashlib

    for name in "abc":
        (tmp_path / name).write_text(name)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = spark.createDataFrame([("a", sha("a")), ("b", sha("x")), ("d", sha("d"))], "name string, sha256 string")
    assert {tuple(r) for r in tables.verified(spark, str(tmp_path), expected).collect()} == {("a", "ok"), ("b", "changed"), ("c", "unlisted"), ("d", "missing")}


def test_saved_centroids_classify_alike(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 1.0])], "id int, label int, v array<double>")
    means = search.centroids(v, "label", "v")
    for _ in range(2):
        search.save_centroids(means, str(tmp_path / "m"))
    got = search.classified(v, "id", "v", search.load_centroids(spark, str(tmp_path / "m")), "label")
    assert sorted(got.collect()) == sorted(search.classified(v, "id", "v", means, "label").collect())


def test_missing_company_and_records_take_their_defaults(spark):
    matrix = spark.createDataFrame([("d", 1, 5, 2), ("d", 2, 9, 1)], "domain string, topic int, year int, cnt int")
    assert {(r.topic, r.markov) for r in horizons.six_factors(matrix, 10, 1, 5).collect()} == {(1, 0.3), (2, 0.3)}
    wrong = spark.createDataFrame([("d", 1)], "domain string, topic int")
    none = [spark.createDataFrame([], f"domain string, topic int, {c}") for c in ("weakness double", "total long, recent5 long", "difficulty int", "probability int")]
    r = assessment.wrong_answer_bundle(wrong, ["domain", "topic"], *none).first()
    assert (r.chance, r.source, r.priority, r.grade) == (30.0, "default", 18, "E")
