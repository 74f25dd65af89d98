"""Retrieval in batches, betweenness, Beta draws and goal dates against brute force."""

import collections
import datetime
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, planning, retrieval, student


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


def test_trigram_matches(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "été", "Über"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(120)] + [(200, None), (201, ""), (202, "?!"), (203, "a"), (None, "beta")]
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(20)] + [(30, None), (31, ""), (32, "a")]
    d, q = spark.createDataFrame(docs, "key long, text string"), spark.createDataFrame(asked, "item long, text string")
    for least in (0.3, 0.6):
        found = {(r.item, r.key): r.similarity for r in retrieval.trigram_matches(d, q, "key", "item", "text", least).collect() if r.key is not None}
        want = {}
        for (i, a), (j, b) in itertools.product(asked, docs):
            a, b = grams(a), grams(b)
            if j is not None and a and b and len(a & b) / len(a | b) >= least:
                want[i, j] = len(a & b) / len(a | b)
        assert found == want and want


def test_term_rank_needs_all_terms(spark):
    d = spark.createDataFrame([(1, "red red fox"), (2, "red"), (3, "Fox, RED; dog"), (4, None)], "key long, text string")
    q = spark.createDataFrame([(1, "red fox"), (2, "cat"), (3, "")], "item long, text string")
    found = {(r.item, r.key): r.rank for r in retrieval.term_rank(d, q, "key", "item", "text").collect()}
    assert found.keys() == {(1, 1), (1, 3)}
    assert found[1, 3] == pytest.approx(0.1 / (math.pi**2 / 6)) and found[1, 1] == pytest.approx(0.1 / (math.pi**2 / 6) * (1.25 + 1) / 2)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([c + 0.35 * rng.normal(size=(60, 16)) for c in centres] + [np.ones((50, 16)), np.zeros((2, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    return x, spark.createDataFrame(rows, "key long, v array<double>")


def exact(x, i, k):
    size = np.sqrt((x * x).sum(1))
    u = x / np.where(size > 0, size, 1)[:, None]
    s = np.round(u @ u[i], 6) + 0.0
    return sorted((-s[j], j) for j in range(len(x)) if j != i)[:k]


def test_nearest_batch_exact_and_probed(spark, clustered, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 100)  # crowded cells in parts
    x, frame = clustered
    centres = retrieval.fitted_cells(frame, "key", "v", 20)
    index = retrieval.indexed(frame, "key", "v", centres)
    assert index.count() == len(x)
    asked = index.filter("key % 25 = 0")
    found = collections.defaultdict(list)
    for r in retrieval.nearest_batch(index, asked, "key", centres, 10).orderBy("query", "rank").collect():
        found[r.query].append((-r.similarity, r.key))
    assert found == {i: exact(x, i, 10) for i in range(0, len(x), 25)}
    some = {(r.query, r.key) for r in retrieval.nearest_batch(index, asked, "key", centres, 10, probes=5).collect()}
    want = {(q, key) for q, rows in found.items() for s, key in rows}
    assert len(some & want) >= 0.9 * len(want)  # recall


def test_hybrid_batch_has_the_best_of_all_pairs(spark, clustered):
    x, frame = clustered
    centres = retrieval.fitted_cells(frame, "key", "v", 8)
    index = retrieval.indexed(frame, "key", "v", centres)
    asked = index.filter("key in (3, 70)")
    rng = random.Random(1)
    lex = {(q, key): rng.random() for q in (3, 70, 9999) for key in rng.sample(range(len(x)), 40)}
    near = retrieval.nearest_batch(index, asked, "key", centres, 16).select(F.col("query").alias("item"), "key").union(asked.select("key", "key"))
    lexical = spark.createDataFrame([(q, i, s) for (q, i), s in lex.items()], "item long, key long, lex double")
    found = {(r.item, r.rank): (r.key, r.score) for r in retrieval.hybrid_batch(lexical, near, index, asked.select(F.col("key").alias("item"), "unit"), "key", "item").collect()}
    size = np.sqrt((x * x).sum(1))
    u = x / np.where(size > 0, size, 1)[:, None]
    for q in (3, 70, 9999):
        score = sorted((-round(0.55 * lex.get((q, i), 0) + (0.45 * round(float(u[i] @ u[q]), 6) if q < 9999 else 0), 6), i) for i in range(len(x)))
        want = {(q, n + 1): (i, -s) for n, (s, i) in enumerate([w for w in score if w[0] < 0][:15])}
        assert {k: v[0] for k, v in found.items() if k[0] == q} == {k: v[0] for k, v in want.items()}
        assert all(found[k][1] == pytest.approx(v[1], abs=2e-6) for k, v in want.items())


def brandes(edges):
    nodes = sorted({v for e in edges for v in e if e[0] != e[1]})
    out = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        far, ways, before, queue = {s: 0}, collections.Counter({s: 1}), collections.defaultdict(list), [s]
        for v in queue:
            for t in out[v]:
                if t not in far:
                    far[t] = far[v] + 1
                    queue.append(t)
                if far[t] == far[v] + 1:
                    ways[t] += ways[v]
                    before[t].append(v)
        share = collections.Counter()
        for t in reversed(queue):
            for v in before[t]:
                share[v] += ways[v] / ways[t] * (1 + share[t])
            if t != s:
                score[t] += share[t]
    n = len(nodes)
    return {v: round(x / max(1, (n - 1) * (n - 2)), 6) for v, x in score.items()}


@pytest.mark.parametrize("n,m", [(12, 20), (25, 60), (6, 5)])
def test_betweenness(spark, n, m):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n, n + 1), (n + 1, n + 2), (n, n), (n, n + 1)]
    found = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brandes(edges)
    assert found.keys() == want.keys() and all(abs(found[v] - want[v]) <= 2e-6 for v in want)


def test_betweenness_of_nothing(spark):
    assert graph.betweenness(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert graph.betweenness(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


@pytest.mark.parametrize("a,b", [(1, 1), (3, 7), (40, 2), (200, 300)])
def test_beta_draws(spark, a, b):
    rows = spark.range(20_000).select(planning.beta_draw(F.lit(a), F.lit(b), F.col("id"), F.lit(7)).alias("x"), "id")
    x = np.array([r.x for r in rows.collect()])
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    assert ((x > 0) & (x < 1)).all() and abs(x.mean() - mean) < 5 * math.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.06
    again = rows.repartition(7).orderBy("id").collect()
    assert [r.x for r in again] == [r.x for r in rows.orderBy("id").collect()]


def test_thompson(spark):
    rows = [(s, t, r, n, 0.5, d) for s in (1, 2) for t, (r, n, d) in enumerate(((0, 0, 0), (90, 100, 1), (5, 100, 9), (None, None, None)))]
    frame = spark.createDataFrame(rows, "s long, t long, r long, n long, c double, d long")
    found = planning.thompson(frame, ["s", "t"], "r", "n", "c", "d", days=365)
    got = {(r.s, r.t): r for r in found.collect()}
    for (s, t, _, n, _, d), r in zip(rows, (got[x[0], x[1]] for x in rows)):
        want = 0.35 * (1 - r.mastery) + 0.15 + 0.15 * min(0.3, 0.05 * (d or 0)) + 0.02 + 0.1 * max(0.0, 0.2 * (1 - (n or 0) / 5))
        assert r.score == pytest.approx(want, abs=1e-8)
    assert sorted(r["rank"] for r in got.values() if r.s == 1) == [1, 2, 3, 4]
    again = planning.thompson(frame.repartition(5), ["s", "t"], "r", "n", "c", "d", days=365)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    assert planning.thompson(frame, ["s", "t"], "r", "n", "c", "d", per_group=2).count() == 4


def test_goal_forecast(spark):
    day = lambda m: datetime.date(2024, m, 15)
    rows = [(1, day(m), 100.0 + 10 * m) for m in range(1, 7)]  # rises by 10 a month: 160 at the last
    rows += [(2, day(m), 100.0 - m) for m in range(1, 7)] + [(3, day(1), 250.0), (4, day(1), 10.0), (5, day(1), None)] + [(6, day(m), 0.5 * m) for m in range(1, 4)]
    found = {r.s: r for r in student.goal_forecast(spark.createDataFrame(rows, "s long, d date, v double"), ["s"], "v", "d", ["d"], 200.0).collect()}
    assert found.keys() == {1, 2, 3, 4, 6}
    assert (found[1].slope, found[1].months, found[1].goal) == (10.0, 4, "2024-10")
    sd = np.std([110, 120, 130, 140, 150, 160])
    assert found[1].probability == math.floor(min(95, max(5, 50 + 18 * (160 + 30 - 200) / sd)) + 0.5)
    assert (found[2].months, found[2].probability) == (None, 5)
    assert (found[3].months, found[3].probability) == (None, 99) and found[4].months is None
    assert found[6].months is None  # more than 60 months away
