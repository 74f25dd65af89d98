"""Hard negatives and cohort retention against brute force: nulls, ties, repeats, odd vectors and times, empty tables."""

import collections
import datetime
import math
import random
import zlib

import numpy as np
import pytest
from oracle import DATA, duck_rows, spark_rows
from pyspark.sql import functions as F

from tessera.llm import cohorts, negatives, queries

VECTORS = "vec_id long, label int, embedding array<float>, id string, v int, cell int, slot int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)


def brute_negatives(rows, positives=5, negatives_=3):
    good = []
    for i, lab, v in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a in sorted({g for g in good if g[0] % 50 == 0}):
        scored = [(-clip(sum(p * q for p, q in zip(a[2], g[2]))), g[0], g[1] == a[1]) for g in good if g[0] != a[0]]
        for s, i, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives_]
            out += [(a[0], i, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def mined(df, **more):
    found = negatives.mine(df, F.col("vec_id") % 50 == 0, **more)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(i, 1, [0.5] * 8) for i in range(400, 520)]  # copies of one vector
    rows += [(520, 2, [0.5] * 8), (521, 2, [0.5] * 8), (50, 3, [1.0] * 8), rows[100], rows[3], rows[3]]
    rows += [(522, None, [1.0]), (None, 1, [1.0]), (523, 1, None), (524, 1, [None, 1.0]), (525, 1, [float("nan")]), (526, 1, [float("inf"), 1.0])]
    rows += [(527, 1, []), (550, 1, []), (528, 2, [2.0, 1.0]), (600, 2, [3e18, 1e18] * 4), (601, 2, [2e18] * 8), (602, 3, [1.6e18] * 8), (650, 0, [-1.0] * 12), (603, 0, [1.0] * 12), (604, 1, [-0.6] * 12)]
    return rows


def test_hard_negatives(spark, odd_vectors, monkeypatch):
    want = brute_negatives(odd_vectors)
    assert mined(vector_frame(spark, odd_vectors)) == want and len(want) > 50
    # many cells, chunks, slices and blocks
    for name, size in (("CELL", 1), ("ANCHORS", 2), ("BLOCK", 2), ("CANDIDATES", 16), ("SLICE", 4096), ("SAMPLE", 40)):
        monkeypatch.setattr(negatives, name, size)
    assert mined(vector_frame(spark, odd_vectors)) == want


def test_hard_negatives_of_other_windows(spark, odd_vectors):
    found = mined(vector_frame(spark, odd_vectors), positives=2, negatives=1)
    assert found == brute_negatives(odd_vectors, 2, 1)


def test_hard_negatives_of_nothing(spark):
    assert mined(vector_frame(spark, [])) == []
    assert mined(vector_frame(spark, [(1, 1, [1.0]), (2, 2, [1.0])])) == []
    assert mined(vector_frame(spark, [(50, 1, [1.0]), (2, 2, [1.0])])) == []


def test_cells_keep_candidates_away():
    """Far clusters: a candidate serves the cells near it only, and none that needs it is left out."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 12)) * 500
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 12)) * 5 for c in centres]))
    square = float((x * x).sum(1).max())
    cells = negatives._cells(x[::7], 16, square)
    d = cells.distances(x[::20], True)
    cell = d.argmin(1)
    for i, a in enumerate(x[::20]):
        kth = np.sort(x @ a)[-6]
        c, far = cell[i], math.sqrt(max(0.0, (a * a).sum() + square - 2 * kth))
        cells.radius[c], cells.far[c], cells.near[c] = max(cells.radius[c], d[i, c]), max(cells.far[c], far), 0.0
    serves = cells.serves(x)
    for i, a in enumerate(x[::20]):
        assert serves[np.argsort(x @ a)[-6:], cell[i]].all()
    assert serves.sum() < 0.4 * serves.shape[0] * (cells.far > -np.inf).sum()


def test_windows_are_exact():
    p = [0, 1, -1, 19, 20, 21, -20, 10**6 + 7, (1 << 63) - 1, -(1 << 63) + 1]
    low, high = negatives.windows(np.array(p), (50, 100), (95, 100))
    assert low.tolist() == [-(-x * 50 // 100) for x in p] and high.tolist() == [x * 95 // 100 for x in p]


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, _client long, _key int, state string, cents int"
CLIENTS = "client_id long, city string, updated_at timestamp_ntz, segment string, _n int"
EPOCH = datetime.datetime(1970, 1, 1)


def micros(t):
    return (t - EPOCH) // datetime.timedelta(microseconds=1)


def brute_retention(clicks, clients):
    def early(c):
        h = zlib.crc32(str(c[0]).encode()) if c[0] is not None else 1
        return c[2] is not None and c[2] + datetime.timedelta(days=h % 100 if h % 3 == 0 else 0) < datetime.datetime(2024, 3, 1)

    rows = {c for c in clicks if c[1] is not None and c[3] is not None}
    city = {}
    for i, name, at in sorted(clients, key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[2] or EPOCH, r[1] or "")):
        city[i] = name or ""
    starts = [{}, {}]
    for c in rows:
        for state in (0, 1):
            if c[4] == "purchase" and (state or early(c)):
                starts[state][c[3]] = min(starts[state].get(c[3], c[1]), c[1])
    span = 3 * 86_400_000_000
    cells = collections.defaultdict(lambda: [set(), set(), 0])
    for c in rows:
        for state in (0, 1):
            s = starts[state].get(c[3])
            if s is None or c[1] < s or not (state or early(c)):
                continue
            other = starts[1 - state].get(c[3])
            cell = cells[state, city.get(c[3], ""), micros(s) // span, (micros(c[1]) - micros(s)) // span]
            cell[0].add(c[3])
            if other is not None and micros(other) // span != micros(s) // span:
                cell[1].add(c[3])
            v = c[5]
            cell[2] += math.floor(100 * v + 0.5) if v is not None and math.isfinite(v) and abs(v) < 9.2e16 else 0
    return sorted((*k, len(u), sum(zlib.crc32(str(x).encode()) for x in u), len(m), n) for k, (u, m, n) in cells.items())


def retained(spark, clicks, clients, **more):
    c = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in clicks], CLICKS)
    k = spark.createDataFrame([(*r, "x", 1) for r in clients], CLIENTS)
    found = cohorts.retention(c, k, as_of="2024-03-01 00:00:00", arrives=cohorts.late_arrival(c), **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def odd_clicks():
    rng = random.Random(5)
    start, rows = datetime.datetime(2024, 1, 1), []
    for i in range(900):
        at = start + datetime.timedelta(microseconds=rng.randrange(120 * 86_400_000_000))
        arrived = at + datetime.timedelta(seconds=rng.randrange(90_000))
        client = 7 if rng.random() < 0.35 else rng.choice([None, *range(60)])
        rows.append((i, at, arrived, client, rng.choice(("view", "purchase", "click", None)), rng.choice((None, 0.005, 12.345, -3.1, 1e30, float("nan"), float("inf"))), rng.choice((None, "{}"))))
    rows += rng.choices(rows, k=60)  # repeats
    rows += [(*r[:6], "other") for r in rng.choices(rows, k=10)]  # alike but for one column
    t = datetime.datetime(2024, 2, 1, 0, 0, 0, 1)
    for n, (a, b) in enumerate(((0, -1), (3, 0), (3, -1), (6, 0))):  # to the microsecond
        rows.append((2000 + n, t + datetime.timedelta(days=a, microseconds=b), t, 100, "purchase", 1.0, None))
    rows += [(3000, datetime.datetime(1969, 12, 30, 5), None, 101, "purchase", 1.0, None), (None, t, t, 101, "view", 2.0, None), (3001, None, t, 102, "purchase", 1.0, None)]
    clients = [(i, rng.choice(("A", "B", None)), start) for i in range(40)] + [(7, "late", datetime.datetime(2025, 1, 1)), (7, "none", None), (None, "x", start)]
    return rows, clients


@pytest.mark.parametrize("parts", [4096, 4])
def test_retention(spark, odd_clicks, parts):
    found = retained(spark, *odd_clicks, parts=parts)
    assert found == brute_retention(*odd_clicks) and len({r[0] for r in found}) == 2 and any(r[6] for r in found)


def test_retention_does_not_depend_on_the_zone(spark, odd_clicks):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = retained(spark, *odd_clicks)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == brute_retention(*odd_clicks)


def test_retention_of_nothing(spark):
    assert retained(spark, [], []) == []


def test_retention_with_maps_and_instants(spark):
    """Times with a zone are instants; columns of maps, which Spark doesn't compare, are compared as JSON."""
    c = spark.sql("SELECT 1L AS click_id, timestamp'2024-01-05 10:00:00' AS ts, timestamp'2024-01-05 10:00:00' AS arrived_at, 5L AS client_id, 'purchase' AS kind, 1.5D AS value, map('a', 1) AS m")
    k = spark.createDataFrame([], "client_id long, city string, updated_at timestamp")
    found = cohorts.retention(c.union(c), k, as_of="2024-03-01 00:00:00", arrives=cohorts.late_arrival(c)).collect()
    assert [(r.users, r.cents, r.cohort) for r in found if r.state == 1] == [(1, 150, 6575)]


@pytest.mark.parametrize("name", ["op12_cohort_retention", "op13_hard_negatives"])
def test_query_against_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck_rows(queries.ORACLES[name])
