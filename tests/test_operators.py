"""Operators that the SQL comparison doesn't reach: sources, sinks, streams, folds, text functions on literals."""

import json
import math
import os
import random

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import forecast, graph, quality, relational, search, segmentation, student
from tessera.plans import registry
from tessera.sources import sinks, tables
from tessera.streaming import incremental


def test_discovery_and_content_addresses(spark, tmp_path):
    for name, body in (("exam_2012_1.json", "a"), ("exam_2013_2.json", "a"), ("notes.txt", "b")):
        (tmp_path / name).write_text(body)
    found = {(r.year, r.round) for r in tables.discovered(spark, str(tmp_path), "exam_*.json").collect()}
    assert found == {(2012, 1), (2013, 2)}
    assert tables.content_addressed(spark, str(tmp_path)).count() == 2


def test_text_records_fail_on_other_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"file": "x", "text": "y"}]))
    assert [tuple(r) for r in tables.text_records(spark, str(tmp_path / "a.json")).collect()] == [("x", "y")]


def test_empty_table_for_a_missing_path(spark, tmp_path):
    schema = spark.createDataFrame([], "a int").schema
    assert tables.table_or_empty(spark, str(tmp_path / "none"), schema).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2012, "long text" * 100, {"x": 1, "tags": ["p", "q"]})], "id long, year int, text string, meta struct<x:int,tags:array<string>>")
    sinks.partitioned_json(df, str(tmp_path / "j"), ["year"], "text", 10)
    assert len(spark.read.json(str(tmp_path / "j")).first().text) == 10
    sinks.flat_csv(df, str(tmp_path / "c"))
    row = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c")).first()
    assert row["meta.x"] == "1" and row["meta.tags"] == "p; q"
    for _ in range(2):
        sinks.upsert(df.select("id", "year"), str(tmp_path / "u"), ["id"])
    assert spark.read.parquet(str(tmp_path / "u")).count() == 1
    assert sinks.dry_run(df, ["id"], {"tags": "meta.tags"}).first().tags == 2


def test_streams_equal_batch(spark, tmp_path):
    batch = tables.table(spark, DATA, "events")
    os.symlink(f"{DATA}/events.parquet", tmp_path / "events.parquet")
    schema = ", ".join(f"{c} {k}" for c, k in batch.dtypes)
    stream = incremental.event_stream(spark, str(tmp_path), schema)
    query = incremental.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(str(r.start)[:10], r.topic, r.n) for r in spark.sql("SELECT * FROM daily").collect()}
    want = batch.groupBy(F.to_date("ts").cast("string").alias("d"), "event_type").count()
    assert got == {(r.d, r.event_type, r["count"]) for r in want.collect()}
    for _ in range(2):
        incremental.ingest(incremental.event_stream(spark, str(tmp_path), schema), str(tmp_path / "out"), ["event_id"], str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_streamed_mastery_equals_the_fold(spark, tmp_path):
    batch = tables.table(spark, DATA, "events").filter("user_id < 20")
    batch.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{c} {k}" for c, k in batch.dtypes)
    stream = incremental.event_stream(spark, str(tmp_path / "in"), schema)
    attempts = stream.select(F.col("user_id").alias("student"), F.col("event_type").alias("topic"), "ts", (F.col("event_type") != "error").alias("correct"))
    query = incremental.mastery_stream(attempts).writeStream.outputMode("update").format("memory").queryName("mastery").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.student, r.topic): (r.n, round(r.mastery, 6)) for r in spark.sql("SELECT * FROM mastery").collect()}
    rows = tables.attempts(spark, DATA).filter("student < 20")
    want = {(r.student, r.topic): (r.n, r.mastery) for r in student.knowledge_traced(rows, ["student", "topic"], ["ts", "event_id"]).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in got)


def test_knowledge_tracing_by_hand(spark):
    df = spark.createDataFrame([(1, "a", 1, True), (1, "a", 2, False)], "student long, topic string, ts int, correct boolean")
    p = 0.3
    for right in (True, False):
        known = p * 0.9 / (p * 0.9 + (1 - p) * 0.2) if right else p * 0.1 / (p * 0.1 + (1 - p) * 0.8)
        p = known + (1 - known) * 0.15
    assert abs(student.knowledge_traced(df, ["student", "topic"], ["ts"]).first().mastery - p) < 1e-6


def test_forecast_sees_no_future(spark):
    m = tables.topic_days(spark, DATA)
    targets = spark.createDataFrame([(25,)], "target int")
    a = forecast.factors(m, targets, 1).collect()
    b = forecast.factors(m.filter("year < 25"), targets, 1).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_pagerank_of_a_cycle_and_a_sink(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert {r["rank"] for r in graph.pagerank(ring, rounds=5).collect()} == {round(1 / 3, 6)}
    sink = graph.pagerank(spark.createDataFrame([(1, 2)], "src long, dst long"), rounds=30).collect()
    assert abs(sum(r["rank"] for r in sink) - 1) < 1e-5


def test_pagerank_converges(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 3), (5, 1), (5, 1), (5, 6)]
    rank = {v: 1 / 6 for v in range(1, 7)}
    out = {v: [b for a, b in edges if a == v] for v in rank}
    for _ in range(500):
        lost = sum(rank[v] for v in rank if not out[v])
        rank = {v: 0.15 / 6 + 0.85 * (lost / 6 + sum(rank[a] / len(out[a]) for a, b in edges if b == v)) for v in rank}
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-5 for v in rank)


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert {(r.src, r.dst, r.hops) for r in graph.reachable(edges, 9).collect()} == {(1, 2, 1), (2, 1, 1), (2, 3, 1), (1, 1, 2), (2, 2, 2), (1, 3, 2)}


def test_tfidf_query_scores_documents_of_any_length(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(rng.choices(words, k=rng.choice((5, 40, 900)))) for i in [*range(1, 30), 100, 200, 207]}
    texts[100] = texts[7] + " " + texts[200]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert max(map(len, texts.values())) > 1500
    sets = {i: set(x.split()) for i, x in texts.items()}
    idf = {w: math.log(1 + len(sets) / (sum(w in x for x in sets.values()) + 1)) for w in words}
    size = {i: math.sqrt(sum(idf[w] ** 2 for w in x)) for i, x in sets.items()}
    want = set()
    for q in (100, 200):
        best = [(-round(sum(idf[w] ** 2 for w in sets[q] & x) / (size[q] * size[i]), 6), i) for i, x in sets.items() if i != q and sets[q] & x]
        want |= {(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(best)[:10])}
    got = registry.QUERIES["tfidf_similar"](spark, str(tmp_path)).collect()
    assert {(r["query"], r.doc_id, r["rank"]) for r in got} == want


def test_normal_form_keys_are_of_whole_texts(spark, tmp_path):
    same = "the same beginning of more than thirty letters "
    rows = [(1, same + "one"), (2, same + "two"), (3, same + "two")]
    spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.n for r in registry.QUERIES["normal_form_keys"](spark, str(tmp_path)).collect()) == [1, 2]


def test_leaders_follow_the_order(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.9, 0.1]), (0, 3, [0.0, 1.0]), (0, 4, [0.1, 1.0])], "g int, id long, v array<double>")
    assert {r.id: r.leader for r in search.leaders(df, "g", "id", "v", 0.8).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_budget_skips_what_does_not_fit(spark):
    from tessera.operators.windows import within_budget

    df = spark.createDataFrame([("s", i, c, str(i)) for i, c in enumerate((5.0, 7.0, 4.0, 1.0))], "k string, pos int, cost double, item string")
    r = within_budget(df, ["k"], ["pos"], "cost", "item", 10.0).first()
    assert r.taken == ["0", "2", "3"] and r.used == 10.0


@pytest.mark.parametrize("value,fault", [(None, "absent"), ("", "absent"), ("x", "non_integer"), ("1.5", "non_integer"), ("1000", "thousands"), ("101", "over_100"), ("0", "below_min"), ("39", "out_of_range"), ("38", None)])
def test_number_faults(spark, value, fault):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(relational.number_fault(F.col("v"))).first()[0] == fault


def test_segmentation_literals(spark):
    page = spark.createDataFrame([(1, "noise\n1. first\nmore\n\n2. second\nA. x\nB. y\nC. z")], "doc_id long, text string")
    rows = segmentation.lines(page, ["doc_id"], "text")
    parts = segmentation.segments(rows, ["doc_id"], F.col("line").rlike(r"^\d+\. "))
    assert [r.text for r in parts.orderBy("segment").collect()] == ["1. first\nmore", "2. second\nA. x\nB. y\nC. z"]
    found = segmentation.choices(parts, ["doc_id", "segment"], "text", r"(?m)^\s*([A-Z])[.)]\s+(.*)$").collect()
    assert [(r.ordinal, r.label, r.choice) for r in found] == [(0, "A", "x"), (1, "B", "y"), (2, "C", "z")]
    numbers = segmentation.numbered_items(rows, ["doc_id"], r"^(\d+)\. ", 50).collect()
    assert {(r.number, r.first_line) for r in numbers} == {(1, 1), (2, 4)}


def test_text_literals(spark):
    df = spark.createDataFrame([("ＡＢＣ  １２３", "aaaaaa", "In 1999, x", [2.0, 1.0])], "a string, b string, c string, s array<double>")
    r = df.select(t.normalized(F.col("a")), t.garbled(F.col("b")), t.year_found(F.col("c")), t.softmax_margin(F.col("s")), t.js_round(F.lit(-2.5))).first()
    assert r[0] == "abc123" and r[1] and r[2] == 1999 and abs(r[3] - 1 / (1 + math.exp(-1))) < 1e-9 and r[4] == -2


def test_validation_compat(spark):
    df = spark.createDataFrame([(1, 0.5), *[(1, 0.9)] * 4], "e int, c double")
    assert quality.validated(df, ["e"], "c").first().status == "WARN"
    assert quality.validated(df, ["e"], "c", compat="reference").first().status == "PASS"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
