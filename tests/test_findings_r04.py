"""Small inputs on which the fourth round's findings failed."""

import datetime
import random

import numpy as np
from oracle import DATA, duck_rows, spark_rows

from tessera.operators import classify, graph, relational
from tessera.plans import registry


def same_as_sql(spark, name, folder):
    assert spark_rows(registry.QUERIES[name](spark, folder)) == duck_rows(registry.ORACLES[name], folder)


def events(spark, folder, rows):
    """Events of (user, kind, day, times)."""
    rows = [(u, k, datetime.datetime(2024, 1, day, 1, i)) for u, k, day, times in rows for i in range(times)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")


def test_trend_of_a_single_period_is_that_of_the_sql(spark, tmp_path):
    events(spark, tmp_path, [(1, "click", 3, 4), (2, "click", 3, 4), (2, "click", 4, 5), (2, "view", 9, 1), (None, "view", 9, 1)])
    same_as_sql(spark, "forecast_trend_probability", str(tmp_path))


def test_text_quality_of_odd_texts_and_halves_is_that_of_the_sql(spark, tmp_path):
    texts = [None, "", " \n", "a\vb", "\v ", "a\u3000b", "éa\x85\x1c"] + ["a" * k + "!" * (n - k) for k, n in ((41, 640), (323, 640), (333, 640), (201, 3200), (1, 640), (1, 128), (3, 7), (5, 5))]
    spark.createDataFrame([(i, x, "en", "a") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, "text_quality", str(tmp_path))


def test_louvain_of_shared_sessions_counts_weights_at_moves_only(monkeypatch):
    rng = np.random.default_rng(3)
    for least, p in ((1, 0.1), (3, 0.3), (3, 0.05)):
        bits = (rng.random((300, 70)) < np.where(np.arange(70) % 3 == np.arange(300)[:, None] % 3, 2.5 * p, p)) @ (1 << (np.arange(70) % 35))[:, None] * [1, 0]
        bits[:, 1] = rng.integers(0, 8, 300)
        maps, of = np.unique(np.concatenate([bits, bits[:20]]), axis=0, return_inverse=True)
        of = of.ravel()
        sharing, calls = relational.Sharing(list(maps.T), least), []
        every = np.array([sharing.weights(i)[of] for i in of])
        both = np.bitwise_count(maps[of][:, None, :].astype(np.uint64) & maps[of][None, :, :].astype(np.uint64)).sum(2, dtype=int)
        size = np.diag(both)
        want = np.floor(both / np.maximum(size + size[:, None] - both, 1) * 1e6 + 0.5) * (both >= least)
        assert (every == want).all()
        np.fill_diagonal(every, 0)
        degree = every.sum(1)
        visits = []
        plain = classify._settled(degree.astype(float), lambda v: (visits.append(v), np.flatnonzero(every[v]), every[v][every[v] > 0].astype(float))[1:], 10)
        counted = sharing.weights
        sharing.weights = lambda i: (calls.append(i), counted(i))[1]
        found = classify._settled_shared(sharing, of, degree, 10)
        assert (found == plain).all() and len(calls) < len(visits)  # each visit of the former code counted them
    monkeypatch.setattr(classify, "SUMS", 1)
    assert classify._settled_shared(relational.Sharing([1 << np.arange(60) | 1 << np.arange(60) // 2 * 2], 1), np.arange(60), np.full(60, 1_000_000), 10) is None


def test_louvain_query_with_sums_and_without(spark, monkeypatch):
    rng = random.Random(4)
    rows = sorted({(x % 30 + 1, i) for i in range(120) for x in range(40) if rng.random() < (0.6 if i % 4 == x % 4 else 0.1)})
    df = spark.createDataFrame(rows, "session int, item long")
    found = {r.node: r.community for r in classify.louvain_shared(df, "session", "item", 2).collect()}
    pairs = relational.co_occurrence(df, "session", "item", 2)
    plain = classify.louvain(pairs.selectExpr("'g' as graph", "a as src", "b as dst", "jaccard as weight"), "graph")
    assert found == {r.node: r.community for r in plain.collect()} and len(set(found.values())) > 1


def test_graph_statistics_make_no_pairs(spark, monkeypatch):
    out = registry.QUERIES["graph_statistics"](spark, DATA)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")
    same_as_sql(spark, "graph_statistics", DATA)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(70)]), rng.choice([None, *range(50)])) for _ in range(400)] + [(s, i) for s in (1, 2, 3) for i in (900, 901, 902)]
    df = spark.createDataFrame(rows, "session int, item long")
    for least in (1, 2):
        pairs = relational.co_occurrence(df.filter("item is not null"), "session", "item", least).selectExpr("a as src", "b as dst", "jaccard as weight")
        want = graph.statistics(pairs).collect()
        found = relational.co_occurrence_statistics(df, "session", "item", least)
        assert found.collect() == want and found.dtypes == graph.statistics(pairs).dtypes
    assert tuple(relational.co_occurrence_statistics(df, "session", "item", 50).first()) == (0, 0, None, None)
    monkeypatch.setattr(relational, "SESSIONS", 9)
    assert relational.co_occurrence_statistics(df, "session", "item", 2).collect() == want


def test_betweenness_packs_its_graph_and_takes_the_shorter_way(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = np.unique(rng.integers(0, 300, (6000, 2)), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    out, into = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))], pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
    held = (np.searchsorted(out[:, 0], np.arange(301)), out[:, 1], np.searchsorted(into[:, 1], np.arange(301)), into[:, 0])
    met, edges_of = [], graph._edges_of
    monkeypatch.setattr(graph, "_edges_of", lambda *a: (met.append(a[0][a[1] + 1] - a[0][a[1]]), edges_of(*a))[1])
    total = sum(graph._dependencies(held, v, 1000) for v in range(300))
    monkeypatch.undo()
    assert sum(x.sum() for x in met) < 300 * len(pairs)  # the former code met each edge about twice for each source
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toPandas", None)  # no rows of edges in the driver
    df = spark.createDataFrame([*pairs.tolist(), [7, 7], [None, 3], pairs[0].tolist()], "src long, dst long")
    found = {r.node: r.betweenness for r in graph.betweenness(df).collect()}
    assert len(found) == 300 and all(abs(found[v] - total[v] / (299 * 298)) < 1e-6 for v in range(300))
    names = spark.createDataFrame([("b", "c"), ("a", "b"), ("c", "d"), ("a", "b")], "src string, dst string")
    assert {r.node: r.betweenness for r in graph.betweenness(names).collect()} == {"a": 0.0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0.0}
    assert graph.betweenness(names.filter("src = 'z'")).count() == 0


def test_pairs_of_shared_sessions_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(7)
    rows = sorted({(rng.choice("pq"), rng.randrange(40), rng.randrange(90)) for _ in range(2500)})
    df = spark.createDataFrame([*rows, (None, 1, 2), ("p", None, 3)], "g string, item long, session int")
    monkeypatch.setattr(relational, "BLOCK", 7)
    monkeypatch.setattr(relational, "PAIRS", 50)
    out = relational.sharing_pairs(df, "session", "item", 3, ["g"])
    of = {}
    for g, i, x in rows:
        of.setdefault((g, i), set()).add(x)
    want = {(g, a, b, len(x & y), len(x) + len(y)) for (g, a), x in of.items() for (h, b), y in of.items() if g == h and a < b and len(x & y) >= 3}
    assert set(map(tuple, out.collect())) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for name in ("co_occurrence", "shared_years", "similarity_edges"):
        same_as_sql(spark, name, DATA)
