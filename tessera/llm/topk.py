"""Exact top-k search by inner product with a pivot table.

Vectors are turned to integers floor(scale * x); the score is the integer inner product. With M the greatest
norm, adding the component sqrt(M^2 - |x|^2) to candidates and 0 to queries makes |q - x|^2 = |q|^2 + M^2 - 2 q.x,
so the largest products are the least distances. Candidates lie in blocks; each block's rows carry their
distances to PIVOTS pivots, computed once, and lie in chunks of CHUNK rows with about the same nearest pivot. For a
query, the greatest distance from d(q, p) to a chunk's least and greatest d(x, p) over pivots p bounds its distances
to the chunk's rows from below. A query first meets the chunk of the least bound, and then those whose bound isn't
beyond the k-th best distance found; queries of a block are multiplied with a chunk together, and with the whole
block where few are eliminated. Components are whole numbers, so products and scores are exact, and bounds have a
margin for rounding; ties go to the smaller id.

Queries are a stated set; they travel in blocks of QUERIES to the candidates' blocks of CANDIDATES, which move once
(to several tasks if there are few of them). A query's k-th best score among the SAMPLE rows goes with it, so that every
block starts with a bound. Each gives its k best per query, and these are ranked per query. Pivots are chosen, each farthest from those before, from SAMPLE rows of least hashed id; they only
affect speed.

Vectors that are null, or hold null or non-finite components, take no part. Vectors of different lengths are
compared on the components that both have; empty ones score 0. Rows with equal ids are candidates of their own
(their ids tie); a query meets every row but those of its own id. Vectors whose products could leave the integers
that doubles hold are kept in blocks of their own, without pivots, and scored in whole numbers of any length; scores
outside 64 bits are given as the nearest number of 64 bits, and components that scaling takes beyond a double as the
largest double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

PIVOTS = 24
SAMPLE = 1024
CANDIDATES = 4096
QUERIES = 256
CHUNK = 64
#: So many tasks at least, if there are as many blocks of queries.
TASKS = 32


def _packed(rows: DataFrame, per_block: int, n: int, shared, k: int = 0, first: int = 0) -> DataFrame:
    """(block, ids, vectors, distances, floors): rows of a hashed block in one row of bytes; floors for queries (k > 0).

    shared: broadcast pivots, greatest square norm, and ids and vectors of the sample.
    """
    blocks = max(1, -(-n // per_block))

    def run(key, table):
        table = table.sort_by("id")
        found = table.column("v").combine_chunks()
        lengths, values = pc.list_value_length(found).to_numpy(), found.flatten().to_numpy()
        width = int(lengths.max(initial=0))
        vectors = np.zeros((len(found), width))
        vectors[np.arange(width) < lengths[:, None]] = values
        pivots, greatest, ids, sample = shared.value
        own = table.column("id").to_numpy().astype(np.int64)
        far = np.zeros((len(own), 0)) if k or first else _to_pivots(vectors, pivots, greatest)
        if far.shape[1]:
            order = np.lexsort((far.min(1), far.argmin(1)))
            own, vectors, far = own[order], vectors[order], far[order]
        least = _floors(own, vectors, ids, sample, k) if k else np.zeros(0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())} | {c: pa.array([a.tobytes()], pa.binary()) for c, a in (("ids", own), ("vectors", vectors), ("distances", far), ("floors", least))})

    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) + F.lit(first))
    return rows.groupBy("block").applyInArrow(run, "block long, ids binary, vectors binary, distances binary, floors binary")


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether sums of products of these vectors' components are exact in doubles."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) < 2.0**53


def _floors(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches: the k-th best in the sample, less than any if there is none."""
    width = max(q.shape[1], sample.shape[1])
    q, sample = _padded(q, width), _padded(sample, width)
    out = np.full(len(q), -np.inf)
    for i in range(len(q)):
        others = sample[sample_ids != ids[i]]
        if len(others) >= k and _fits(q[i : i + 1], others):
            out[i] = np.partition(others @ q[i], len(others) - k)[len(others) - k]
    return out


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray, greatest: float, query: bool = False) -> np.ndarray:
    """Distances in the space with the added component; pivots are candidates."""
    width = max(vectors.shape[1], pivots.shape[1])
    v, p = _padded(vectors, width), _padded(pivots, width)
    v2, p2 = (v * v).sum(1), (p * p).sum(1)
    extra_v = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, greatest - v2))
    extra_p = np.sqrt(np.maximum(0, greatest - p2))
    square = v2[:, None] + p2[None, :] - 2 * v @ p.T + (extra_v[:, None] - extra_p[None, :]) ** 2
    return np.sqrt(np.maximum(0, square))


def _whole(a: np.ndarray) -> np.ndarray:
    """Whole numbers of any length."""
    return np.array([[int(v) for v in row] for row in a.tolist()], object).reshape(a.shape)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    first = np.searchsorted(query, query)
    return order[np.arange(len(order)) - first < k]


def search_block(q_ids, q, floors, ids, x, distances, pivots, greatest, k) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Queries, candidates, scores: each query's k best of one block of candidates that reach its floor; and how many were evaluated."""
    width = max(q.shape[1], x.shape[1])
    q, x = _padded(q, width), _padded(x, width)
    fits = np.abs(q).max(1, initial=0) * np.abs(x).max(initial=0) * max(width, 1) < 2.0**53
    out_q, out_c, out_s, evaluated = [], [], [], 0
    if not fits.all():
        long_x = _whole(x)
        for i in np.flatnonzero(~fits):
            others = np.flatnonzero(ids != q_ids[i])
            s = long_x[others] @ _whole(q[i : i + 1])[0]
            some = np.lexsort((ids[others], -s))[:k]
            evaluated += len(others)
            out_q.append(np.full(len(some), q_ids[i]))
            out_c.append(ids[others[some]])
            out_s.append(np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s[some]], np.int64))
    q_ids, q, floors = q_ids[fits], q[fits], floors[fits]
    n = len(q)
    if n and len(x):
        begins = np.arange(0, len(x), CHUNK)
        sizes = np.diff(np.append(begins, len(x)))
        bound = np.zeros((n, len(begins)))
        if distances.shape[1]:
            low, high = np.minimum.reduceat(distances, begins), np.maximum.reduceat(distances, begins)
            for p, far in enumerate(_to_pivots(q, pivots, greatest, query=True).T):
                bound = np.maximum(bound, np.maximum(low[:, p] - far[:, None], far[:, None] - high[:, p]))
        square = (q * q).sum(1) + greatest
        least = floors.copy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]  # rows of queries, candidates, scores

        def meet(rows: np.ndarray, at: slice) -> None:
            nonlocal evaluated
            own = ids[at]
            s = q[rows] @ x[at].T
            evaluated += s.size
            for i in np.flatnonzero(np.isin(q_ids[rows], own)):
                s[i, own == q_ids[rows[i]]] = -np.inf
            if s.shape[1] > k:
                open_ = np.flatnonzero(least[rows] == -np.inf)
                least[rows[open_]] = np.partition(s[open_], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            i, j = np.nonzero((s >= least[rows, None]) & (s > -np.inf))
            found.append((rows[i], j + (at.start or 0), s[i, j]))

        def needed() -> np.ndarray:
            """Of what can't be eliminated."""
            with np.errstate(invalid="ignore"):
                reach = np.sqrt(np.maximum(0.0, square - 2 * least)) * (1 + 1e-9) + 1e-6
            return ~(bound > np.where((least > -np.inf) & np.isfinite(square), reach, np.inf)[:, None])

        nearest = bound.argmin(1)
        if distances.shape[1] and needed().mean() < 0.9:
            for c in np.unique(nearest):
                meet(np.flatnonzero(nearest == c), slice(begins[c], begins[c] + sizes[c]))
            rows, places, s = (np.concatenate(v) for v in zip(*found))
            kept = _best(rows, ids[places], s, k)
            rows, s = rows[kept], s[kept]
            last = np.flatnonzero(np.bincount(rows, minlength=n) == k)
            lowest = np.full(n, np.inf)
            np.minimum.at(lowest, rows, s)
            least[last] = np.maximum(least[last], lowest[last])
        some = needed()
        if some.mean() > 0.5:
            del found[1:]
            meet(np.arange(n), slice(0, len(x)))
        else:
            if len(found) > 1:
                some[np.arange(n), nearest] = False
            for c in np.flatnonzero(some.any(0)):
                meet(np.flatnonzero(some[:, c]), slice(begins[c], begins[c] + sizes[c]))
        rows, places, s = (np.concatenate(v) for v in zip(*found))
        kept = _best(rows, ids[places], s, k)
        out_q.append(q_ids[rows[kept]])
        out_c.append(ids[places[kept]])
        out_s.append(s[kept].astype(np.int64))
    return *(np.concatenate([np.zeros(0, np.int64), *v]) for v in (out_q, out_c, out_s)), evaluated


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, evaluated: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among ``vectors`` (all, if fewer).

    evaluated counts the products that were not eliminated, when the result is computed.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        df = df.filter(F.col(id_col).isNotNull() & usable(v))
        most = F.lit(1.7976931348623157e308)
        scaled = F.transform(v, lambda x: F.greatest(-most, F.least(most, x * scale)))
        # doubles from 2^52 on are whole
        return df.select(F.col(id_col).cast("long").alias("id"), F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(F.when(F.abs(x) < float(1 << 52), x)).cast("double")).otherwise(x)).alias("v"))

    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    every, q = whole(vectors), whole(queries)
    x, big = every.filter(norm < float(1 << 52)), every.filter(norm >= float(1 << 52))
    n, greatest = x.agg(F.count("*"), F.max(norm)).first()
    asked, n_big = q.count(), big.count()
    greatest = float(greatest or 0.0)
    found = x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    sample = found["v"].tolist()
    rows = np.zeros((len(sample), max(map(len, sample), default=0)))
    for i, v in enumerate(sample):
        rows[i, : len(v)] = v
    chosen = rows[:1]
    while 0 < len(chosen) < min(PIVOTS, len(rows)):
        near = _to_pivots(rows, chosen, greatest).min(1)
        if near.max() <= 0:
            break
        chosen = np.concatenate([chosen, rows[[int(near.argmax())]]])
    shared = spark.sparkContext.broadcast((chosen, greatest, found["id"].to_numpy(np.int64), rows))

    blocks = max(1, -(-n // CANDIDATES))
    candidates = _packed(x, CANDIDATES, n, shared)
    if n_big:
        candidates = candidates.union(_packed(big, CANDIDATES, n_big, shared, first=blocks))
        blocks += max(1, -(-n_big // CANDIDATES))
    candidates = cut(candidates.drop("floors"))
    slices = max(1, min(-(-asked // QUERIES), -(-TASKS // blocks)))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    asking = _packed(q, QUERIES, asked, shared, k).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "floors", (F.col("block") % slices).alias("slice"), F.explode(each(blocks)).alias("block"))
    asking = asking.repartition(min(4096, 2 * blocks * slices), "block", "slice")
    candidates = candidates.withColumn("slice", F.explode(each(slices))).repartition(min(4096, 2 * blocks * slices), "block", "slice")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p, g, _, _ = shared.value
        out = [(np.zeros(0, np.int64),) * 3]
        for block in right.to_pylist():
            ids = np.frombuffer(block["ids"], np.int64)
            theirs, far = (np.frombuffer(block[c]).reshape(len(ids), -1) for c in ("vectors", "distances"))
            for row in left.to_pylist():
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                *found, count = search_block(q_ids, np.frombuffer(row["q_vectors"]).reshape(len(q_ids), -1), np.frombuffer(row["floors"]), ids, theirs, far, p, g, k)
                out.append(found)
                if evaluated is not None:
                    evaluated.add(int(count))
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in zip(("query_id", "vec_id", "score"), zip(*out))})

    found = asking.groupBy("block", "slice").cogroup(candidates.groupBy("block", "slice")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
