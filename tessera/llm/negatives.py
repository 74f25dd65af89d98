"""Hard-negative mining: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels
whose scores lie in a window under the positive's.

Method: a Voronoi-partition kNN join, twice. Vectors are turned to integers floor(scale * x); the score is the integer
inner product. With M the greatest norm, adding the component sqrt(M^2 - |x|^2) to candidates and 0 to anchors makes
|a - x|^2 = |a|^2 + M^2 - 2 a.x, so scores are distances. Pivots, with 0 added as anchors have, are chosen, each farthest
from those before, from SAMPLE rows of least hashed id; an anchor belongs to the cell of its nearest pivot, a cell has its radius. How far an anchor must
look follows from a score that its last answer reaches at least: the k-th best among the SAMPLE rows, or the window's end;
how near it need not look from the window's start. A candidate at distance d of a cell's pivot is copied to the cell only
if [d - radius, d + radius] meets [least, greatest] of its anchors. Cells, and so what is known of them on each worker, are
PIVOTS at most. Within a cell, chunks of ANCHORS anchors meet slices of the candidates, block by block, and each gives its
best; these are ranked per anchor. The first join finds the positives, the second, with windows known, the negatives.
A cell that holds many rows (copies of one vector, say) is only more chunks and slices: no task's rows grow with it.

Results. Rows take no part if the id, the label or the vector is null, or a component is null or not finite. Vectors of
different lengths are compared on the components that both have. Ties go to the smaller id. Rows of the anchor's own id are
none of its candidates; repeated rows are candidates each; anchors that are equal in id, label and vector are one, those
of one id that differ each have their answers. Labels are compared by equality. Scores outside 64 bits are the nearest
number of 64 bits (vectors of which a product may leave the integers that doubles hold are scored in whole numbers of any
length), and components that scaling takes beyond a double are the largest double. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.topk import _fits, _padded, _whole, usable

#: Cells at most; a cell for so many anchors.
PIVOTS, CELL = 128, 256
#: Rows from which pivots and first bounds come.
SAMPLE = 1024
#: Anchors and candidates that are scored at once.
BLOCK, CANDIDATES = 256, 2048
#: Anchors of a chunk, and bytes of the vectors of a slice: a task holds one of each.
ANCHORS, SLICE = 4096, 8 << 20

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles; beyond a double the largest."""
    most = F.lit(1.7976931348623157e308)
    x = F.transform(vector.cast("array<double>"), lambda x: F.greatest(-most, F.least(most, x * scale)))
    # doubles from 2^52 on are whole
    return F.transform(x, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(F.when(F.abs(x) < float(1 << 52), x)).cast("double")).otherwise(x))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of doubles, padded by zeros to the longest; the flat buffer is taken as it is."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    width = int(sizes.max(initial=0))
    if len(sizes) * width == len(flat):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, kept to 64 bits."""
    width = max(a.shape[1], x.shape[1])
    a, x = _padded(a, width), _padded(x, width)
    if _fits(a, x):
        return (a @ x.T).astype(np.int64)
    found = [[min(max(int(v), _LEAST), _MOST) for v in row] for row in (_whole(a) @ _whole(x).T).tolist()]
    return np.array(found, np.int64).reshape(len(a), len(x))


def windows(positive: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score s with low <= s / positive <= high, as products: shares are (numerator, denominator)."""

    def part(p: np.ndarray, num: int, den: int) -> np.ndarray:  # floor(p * num / den), without leaving 64 bits
        return p // den * num + p % den * num // den

    return -part(-np.maximum(positive, _LEAST + 1), *low), part(positive, *high)


class Cells:
    """Pivots with their cells' radius, and the distances between which a cell's anchors look; of bounded size."""

    def __init__(self, pivots: np.ndarray, square: float):
        self.pivots, self.square = pivots, square
        self.radius = np.zeros(len(pivots))
        self.near, self.far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        """To the pivots, which lie where anchors do (0 added); vectors too large to be measured are at no distance (nan)."""
        width = max(v.shape[1], self.pivots.shape[1])
        v, p = _padded(v, width), _padded(self.pivots, width)
        with np.errstate(over="ignore", invalid="ignore"):
            v2, p2 = (v * v).sum(1), (p * p).sum(1)
            extra = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(0, self.square - v2))
            square = v2[:, None] + p2 - 2 * v @ p.T + extra[:, None] ** 2
            out = np.sqrt(np.maximum(0, square))
        out[~np.isfinite(v2) | (v2 > (self.square if not anchors else 2.0**52))] = np.nan
        return out

    def serves(self, x: np.ndarray) -> np.ndarray:
        """Which cells' anchors each candidate might serve."""
        d = self.distances(x, False)
        slack = 1e-6 * (1 + np.abs(d))
        return np.isnan(d) | ((d - self.radius <= self.far + slack) & (d + self.radius >= self.near - slack))


def _cells(rows: np.ndarray, most: int, square: float) -> Cells:
    chosen = rows[:1]
    while 0 < len(chosen) < min(most, len(rows)):
        near = np.nan_to_num(Cells(chosen, square).distances(rows, True), nan=0.0).min(1)
        if near.max() <= 0:
            break
        chosen = np.concatenate([chosen, rows[[int(near.argmax())]]])
    return Cells(chosen, square)


def _best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best (scores, places), of equals the first; places are -1 where there are fewer."""
    left, rows = ok.copy(), np.arange(len(score))
    s, at = np.zeros((len(score), k), np.int64), np.full((len(score), k), -1)
    held = np.where(left, score, _LEAST)
    for i in range(k):
        j = held.argmax(1)  # the first of equals
        short = ~left[rows, j]
        if short.any():  # scores as low as the mark
            j[short] = left[short].argmax(1)
        there = left[rows, j]
        s[:, i], at[:, i] = np.where(there, score[rows, j], 0), np.where(there, j, -1)
        held[rows, j], left[rows, j] = _LEAST, False
    return s, at


def _merged(s: np.ndarray, ids: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (scores, ids) that are there, of equals the least id."""
    order = np.lexsort((ids, ~s, ~there), axis=-1)  # ~s falls as s rises, and stays within 64 bits
    return tuple(np.take_along_axis(x, order, -1)[..., :k] for x in (s, ids, there))


def _search(anchors: DataFrame, rows: DataFrame, slices: int, known: Broadcast, k: int, same: bool) -> DataFrame:
    """(akey, slot, id, score): of each slice's rows the k best of each window of each anchor.

    anchors: (akey, id, label, v, cell, low, high), low and high arrays of the windows' ends, one slot each.
    known: the cells with this join's bounds.
    """
    chunks = cut(anchors.groupBy("cell").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("_chunks")))  # PIVOTS rows

    def packed(key, table):
        table = table.sort_by("akey")
        fields = {"akey": np.asarray(table["akey"]), "ids": np.asarray(table["id"]), "labels": np.asarray(table["label"]), "vectors": matrix(table["v"])}
        low, high = (np.array(table[c].to_pylist(), np.int64) for c in ("low", "high"))
        fields |= {"low": low, "high": high}
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "n": [len(table)]} | {c: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for c, a in fields.items()}).select(order)

    order = ["cell", "chunk", "n", "akey", "ids", "labels", "vectors", "low", "high"]
    dealt = anchors.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("akey"), F.col("_chunks")).cast("int"))
    blocks = dealt.groupBy("cell", "chunk").applyInArrow(packed, "cell int, chunk int, n long, akey binary, ids binary, labels binary, vectors binary, low binary, high binary")
    blocks = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the candidates of one slice for each cell that they might serve."""
        cells = known.value
        for batch in batches:
            ids, labels, part, x = np.asarray(batch["id"]), np.asarray(batch["label"]), np.asarray(batch["slice"]), matrix(batch["v"])
            serves = cells.serves(x)
            for c in np.flatnonzero(serves.any(0)).tolist():
                at = np.flatnonzero(serves[:, c])
                at = at[np.lexsort((ids[at], part[at]))]
                for b in np.split(at, np.flatnonzero(np.diff(part[at])) + 1):
                    for one in np.split(b, range(CANDIDATES, len(b), CANDIDATES)):
                        fields = [pa.array([a.tobytes()], pa.binary()) for a in (ids[one], labels[one], x[one])]
                        yield pa.record_batch([pa.array([c], pa.int32()), pa.array([int(part[one[0]])], pa.int32()), pa.array([len(one)]), *fields], ["cell", "slice", "m", "x_ids", "x_labels", "x_vectors"])

    # a slice's rows start together, so that a batch has few slices, and blocks are full
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("id", "v"), F.lit(slices)).cast("int")).repartition(slices, "slice")
    served = sliced.mapInArrow(spread, "cell int, slice int, m long, x_ids binary, x_labels binary, x_vectors binary")
    served = served.join(F.broadcast(chunks), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds.values()], list(kinds))
        a = left.to_pylist()[0]
        akey, ids, labels = (np.frombuffer(a[c], np.int64) for c in ("akey", "ids", "labels"))
        v = np.frombuffer(a["vectors"]).reshape(len(ids), -1)
        low, high = (np.frombuffer(a[c], np.int64).reshape(len(ids), -1) for c in ("low", "high"))
        shape = (*low.shape, k)
        best = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        for batch in right.to_batches(1):
            for r in batch.to_pylist():
                x_ids, x_labels = np.frombuffer(r["x_ids"], np.int64), np.frombuffer(r["x_labels"], np.int64)
                x = np.frombuffer(r["x_vectors"]).reshape(len(x_ids), -1)
                for first in range(0, len(ids), BLOCK):
                    of = slice(first, first + BLOCK)
                    s = scores(v[of], x)
                    fits = labels[of, None] == x_labels if same else labels[of, None] != x_labels
                    fits &= ids[of, None] != x_ids
                    for slot in range(low.shape[1]):
                        mine = fits & (s >= low[of, slot, None]) & (s <= high[of, slot, None])
                        some = np.flatnonzero(mine.any(1))
                        if not len(some):
                            continue
                        new, at = _best(s[some], mine[some], k)
                        joined = [np.concatenate([b[of][some, slot], n], -1) for b, n in zip(best, (new, x_ids[at], at >= 0))]
                        for b, n in zip(best, _merged(*joined, k)):
                            b[first + some, slot] = n
        i, slot, j = np.nonzero(best[2])
        return pa.Table.from_arrays([pa.array(akey[i]), pa.array(slot.astype(np.int32)), pa.array(best[1][i, slot, j]), pa.array(best[0][i, slot, j])], list(kinds))

    kinds = {"akey": pa.int64(), "slot": pa.int32(), "id": pa.int64(), "score": pa.int64()}
    key = ["cell", "chunk", "slice"]
    return blocks.groupBy(*key).cogroup(served.groupBy(*key)).applyInArrow(run, "akey long, slot int, id long, score long")


def _bounds(anchors: DataFrame, cells: Broadcast) -> Cells:
    """Each cell's radius, and the least and greatest distance to which its anchors look (floor, ceiling: of scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[float]] = {}
        for batch in batches:
            v, cell = matrix(batch["v"]), np.asarray(batch["cell"])
            d = cells.value.distances(v, True)[np.arange(len(v)), cell]
            with np.errstate(over="ignore", invalid="ignore"):
                square = (v * v).sum(1) + cells.value.square
                far, near = (np.sqrt(np.maximum(0, square - 2 * np.asarray(batch[c]).astype(float))) for c in ("floor", "ceiling"))
            far[np.asarray(batch["floor"]) == _LEAST] = np.inf
            near[np.asarray(batch["ceiling"]) == _MOST] = 0
            # what isn't measured looks everywhere
            odd = ~np.isfinite(d)
            d[odd], far[odd], near[odd] = np.inf, np.inf, 0
            for c in np.unique(cell).tolist():
                of = cell == c
                r, n, f = held.get(c, (0.0, np.inf, -np.inf))
                held[c] = max(r, d[of].max()), min(n, near[of].min()), max(f, far[of].max())
        yield pa.record_batch([pa.array(list(held), pa.int32()), *(pa.array([x[i] for x in held.values()], pa.float64()) for i in range(3))], ["cell", "radius", "near", "far"])

    each = anchors.mapInArrow(run, "cell int, radius double, near double, far double")
    found = each.groupBy("cell").agg(F.max("radius").alias("radius"), F.min("near").alias("near"), F.max("far").alias("far")).collect()  # PIVOTS rows
    out = Cells(cells.value.pivots, cells.value.square)
    for r in found:
        out.radius[r.cell], out.near[r.cell], out.far[r.cell] = r.radius, r.near, r.far
    return out


def mine(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``anchors`` marks.

    positives: the first rows of the anchor's label by score; negatives: for each of these the first rows of other labels
    with low * positive_score <= negative_score <= high * positive_score, low and high being numerator and denominator.
    ``label`` may be of any type that can be hashed.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    kept = vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col).cast("array<double>")))
    whole = label.cast("long") if dict(vectors.select(label.alias("l")).dtypes)["l"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label)
    rows = kept.select(F.col(id_col).cast("long").alias("id"), whole.alias("label"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    small = F.when(norm < float(1 << 52), norm)
    components, square = rows.agg(F.sum(F.size("v")), F.max(small)).first()
    slices = max(1, -(-8 * (components or 0) // SLICE))
    sample = rows.filter(norm < float(1 << 52)).select("id", "label", "v").orderBy(F.xxhash64("id"), "id", "label", "v").limit(SAMPLE).toArrow()
    s_ids, s_labels, s_rows = np.asarray(sample["id"]), np.asarray(sample["label"]), matrix(sample["v"])
    own = rows.filter("_anchor").drop("_anchor").distinct().withColumn("akey", F.xxhash64("id", "label", "v"))
    asked = own.count()
    cells = _cells(s_rows if len(s_rows) else np.zeros((1, 1)), min(PIVOTS, max(1, -(-asked // CELL))), float(square or 0.0))
    base = spark.sparkContext.broadcast((cells, s_ids, s_labels, s_rows))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An anchor's cell, and the score that its k-th positive reaches at least."""
        cells, s_ids, s_labels, s_rows = base.value
        for batch in batches:
            ids, labels, v = np.asarray(batch["id"]), np.asarray(batch["label"]), matrix(batch["v"])
            d = cells.distances(v, True)
            cell = np.where(np.isnan(d).all(1), 0, np.nan_to_num(d, nan=np.inf).argmin(1))
            floor = _sample_floor(v, ids, labels, s_ids, s_labels, s_rows, positives)
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(floor)], [*batch.schema.names, "cell", "floor"])

    own = cut(own.mapInArrow(assigned, "id long, label long, v array<double>, akey long, cell int, floor long"))
    shared = spark.sparkContext.broadcast(cells)
    lit = lambda x: F.lit(x).cast("long")
    first = own.withColumn("ceiling", lit(_MOST)).withColumns({"low": F.array("floor"), "high": F.array("ceiling")})
    reach = spark.sparkContext.broadcast(_bounds(first, shared))
    candidates = rows.drop("_anchor")
    found = _search(first.drop("floor", "ceiling"), candidates, slices, reach, positives, True)
    ranked = Window.partitionBy("akey").orderBy(F.desc("score"), "id")
    found = found.withColumn("slot", F.row_number().over(ranked) - 1).filter(F.col("slot") < positives)
    found = cut(found.select("akey", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    @F.arrow_udf("struct<low:long,high:long>")
    def ends(positive: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in windows(np.asarray(positive), low, high)], ["low", "high"])

    # a slot without a positive has a window that holds nothing
    each = found.withColumn("w", ends("positive_score")).groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("slot", "w.low", "w.high"))).alias("w"))
    pad = lambda name, x: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("w", (i + 1).cast("int"))[name], lit(x)))
    asking = own.drop("floor").join(each, "akey").select("akey", "id", "label", "v", "cell", pad("low", 1).alias("low"), pad("high", 0).alias("high"))
    real = F.arrays_zip("low", "high")
    real = F.filter(real, lambda w: w["low"] <= w["high"])
    asking = cut(asking.withColumns({"floor": F.coalesce(F.array_min(F.transform(real, lambda w: w["low"])), lit(1)), "ceiling": F.coalesce(F.array_max(F.transform(real, lambda w: w["high"])), lit(0))}).filter(F.size(real) > 0))
    reach = spark.sparkContext.broadcast(_bounds(asking, shared))
    other = _search(asking.drop("floor", "ceiling"), candidates, slices, reach, negatives, False)
    ranked = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), "id")
    other = other.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    out = other.join(found, ["akey", "slot"]).join(own.select("akey", F.col("id").alias("anchor_id")), "akey")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _sample_floor(v: np.ndarray, ids: np.ndarray, labels: np.ndarray, s_ids: np.ndarray, s_labels: np.ndarray, s_rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row among the sample's rows of its label, the least number if there are fewer."""
    out = np.full(len(v), _LEAST)
    if len(s_rows) < k or not len(v):
        return out
    s = scores(v, s_rows)
    ok = (labels[:, None] == s_labels) & (ids[:, None] != s_ids)
    best, at = _best(s, ok, k)
    return np.where(at[:, -1] >= 0, best[:, -1], out)
