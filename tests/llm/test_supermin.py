"""SuperMinHash groups against brute force: signatures, components, large buckets, odd rows."""

import random

import numpy as np
import pytest
from oracle import DATA, duck_rows, spark_rows
from pyspark.sql import functions as F
from test_llm_operators import VOCABULARY, brute_components, frame, odd_rows, prose  # noqa: F401

from tessera.llm import queries, sharding, similarity, supermin
from tessera.llm import words as w


def slow_signature(members, slots):
    """The definition: each member's permutation step by step, no early stop."""
    out = [None] * slots
    with np.errstate(over="ignore"):
        for x in members:
            x, order = np.array([x], np.uint64), list(range(slots))
            for j in range(slots):
                k = j + int(w.mix(x ^ supermin._STEP[j, 0])[0] % np.uint64(slots - j))
                offer = int((w.mix(x + supermin._STEP[j, 1]) >> np.uint64(8))[0]) | j << 56
                order[j], order[k] = order[k], order[j]
                out[order[j]] = offer if out[order[j]] is None else min(out[order[j]], offer)
    return out


def test_signatures_follow_the_definition():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 5, 40, 300)]
    for slots in (16, 128):
        assert [slow_signature(s, slots) for s in sets] == supermin.signatures(sets, slots).tolist()
    assert len(supermin.signatures([])) == 0


def test_equal_places_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(1)
    share = []
    for _ in range(400):
        a = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        one, other = supermin.signatures([a, np.concatenate([a[:90], rng.integers(0, 1 << 63, 10).astype(np.uint64)])])
        share.append((one == other).mean())
    jaccard = 90 / 110
    assert abs(np.mean(share) - jaccard) < 0.01 and np.var(share) < 0.8 * jaccard * (1 - jaccard) / 128


def groups(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in supermin.near_groups(df, **more).collect()), key=repr)


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 80, 100)])
def test_near_groups(spark, odd_rows, k, num, den):  # noqa: F811
    want = [(i, n, c, i == c) for i, n, c in brute_components(odd_rows, k, num, den)]
    assert groups(frame(spark, odd_rows), k=k, num=num, den=den) == sorted(want, key=repr)


def test_near_groups_of_nothing(spark):
    assert groups(frame(spark, [])) == []


def test_a_large_bucket_of_near_copies(spark, monkeypatch):
    """Blocks and passes of every kind, and rows apart from the bucket's largest component."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = random.Random(8)
    rows, base = [], prose(rng, 60).split()
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(own), "a"))
    want = [(i, n, c, i == c) for i, n, c in brute_components(rows, 3, 85, 100)]
    assert groups(frame(spark, rows), k=3, num=85, den=100) == sorted(want, key=repr)
    assert 1 < len({r[2] for r in want}) < 150


@pytest.mark.parametrize("apart", [0, 3])
def test_a_hot_tile_is_dealt_in_proportion(spark, apart):
    """20,000 sets of one tile: a block each at first; then only sets apart from the largest component meet all others."""
    n = 20_000
    label = F.when(F.col("id") < apart, F.col("id")).otherwise(F.lit(9).cast("long"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("tile"), F.col("id").alias("sid"), label.alias("label"), F.lit(100).cast("long").alias("n"), F.lit(True).alias("early"))
    blocks = -(-n // similarity.BLOCK)
    new = similarity._dealt(rows.withColumn("label", F.col("sid")), 85, 100, "diagonal", False)
    assert new.count() == n and new.filter("more").count() == n
    rest = similarity._dealt(rows, 85, 100, "rest", False).count()
    assert rest == (n + apart * blocks if apart else 0) < 2 * n


def test_query_against_sql(spark):
    assert spark_rows(queries.QUERIES["op11_near_groups"](spark, DATA)) == duck_rows(queries.ORACLES["op11_near_groups"])


def test_shards_do_not_depend_on_the_order_of_arrival(spark, monkeypatch):
    """Equally long texts, in several blocks, reversed and dealt anew."""
    monkeypatch.setattr(sharding, "BLOCK", 64)
    rows = [(i, f"text number {i:05d}", "a") for i in range(600)]
    once, again = (
        sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(df, shards=16).select("doc_id", "shard", "slot").collect())
        for df in (frame(spark, rows), frame(spark, rows[::-1]).repartition(13))
    )
    assert once == again
