"""Toxicity by class-conditional Kneser-Ney models of a text's bytes.

Model. Texts are read as bytes, ASCII letters lower-cased, other ASCII but letters as spaces. A shared
model of the last byte of each ORDER-gram is an interpolated Kneser-Ney model of all training rows:
discounted counts at the top, numbers of distinct left contexts below. Each class has its own discounted
top counts and backs off, with a prior mass besides, to the shared model; expressions that are rare in
either class so have the shared probability in both and say nothing. What an ORDER-gram says is the
difference of the two classes' log probabilities, and nothing unless its count in toxic rows is further
than Z standard deviations from what the context's share of toxic rows leads to expect.

Score. Two length-normalised differences of log-likelihood, that of the whole text and that of its most
toxic stretch of SPAN bytes, go through a logistic function. It is fitted on up to CALIBRATION training
rows, those of least hashed id. Counts, totals and the shared model are taken over all ORDER-grams of all training
rows, as relations dealt by their contexts; the driver sees the two-byte level of the shared model (2^16 rows at
most) and the ORDER-grams that say something, which travel to executors. These are as many as the corpus has: none
is left out, and what they take (8 bytes each, and 16 to 32 in a worker's table) grows with their number.

Results. Every row stays, with its columns, and gets a score between 0 and 1, higher for likelier toxic;
null and empty texts score as texts that say nothing. Without training rows of both classes the score is the
share of toxic rows (0 if there is none) for all. Repeated rows each get a score. Several labels of one id
count as toxic if any is; null labels aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import BROADCAST_ROWS, cut, release, small_batches, text_or_empty, trimmed

ORDER = 4
DISCOUNT = 0.75
#: Mass of the shared model in each class's context.
PRIOR = 20.0
Z = 4.0
SPAN = 8
CALIBRATION = 20_000

_READ = np.arange(256, dtype=np.uint8)
_READ[:128] = 32
_READ[97:123] = np.arange(97, 123)
_READ[65:91] = np.arange(97, 123)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each byte, texts set apart by ORDER spaces, and where texts begin."""
    n = len(offsets) - 1
    out = np.full(len(data) + ORDER * n, 32, np.uint32)
    begin = offsets[:-1] + ORDER * np.arange(1, n + 1)
    at = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(offsets))
    out[at] = _READ[data]
    grams = out.copy()
    for i in range(1, ORDER):
        grams[i:] |= out[:-i] << np.uint32(8 * i)
    return grams, begin


@dataclass
class Model:
    """ORDER-grams that say something, sorted, with what each says; and the logistic function's parameters."""

    grams: np.ndarray
    says: np.ndarray
    weights: np.ndarray  # of 1, the whole text's difference and the stretch's

    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """An open-addressed hash table: keys, values, bits; a key's place is its product's top bits or after, no gap between."""
        if not hasattr(self, "_table"):
            bits = max(16, int(2 * len(self.grams)).bit_length())
            keys, values = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.float32)
            place = (self.grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            left = np.arange(len(place))
            while len(left):
                at, first = np.unique(place[left], return_index=True)
                free = keys[at] == 0
                put = left[first[free]]
                keys[at[free]], values[at[free]] = self.grams[put], self.says[put]
                left = np.delete(left, first[free])
                place[left] = (place[left] + np.uint32(1)) & np.uint32(len(keys) - 1)
            self._table = keys, values, bits
        return self._table

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text the two length-normalised differences."""
        out = [np.zeros((0, 2))]
        keys, values, bits = self.table()
        for _, data, offsets in w.runs(column):
            grams, begin = _grams(data, offsets)
            place = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            found = keys[place]
            says = np.where(found == grams, values[place], np.float32(0))
            left = np.flatnonzero((found != grams) & (found != 0))
            while len(left):
                place[left] = (place[left] + np.uint32(1)) & np.uint32(len(keys) - 1)
                found = keys[place[left]]
                hit = found == grams[left]
                says[left[hit]] = values[place[left[hit]]]
                left = left[~hit & (found != 0)]
            total = np.concatenate([[0.0], np.cumsum(says, dtype=np.float64)])
            end = begin + np.diff(offsets)
            whole = (total[end] - total[begin]) / np.maximum(1, end - begin)
            first = np.maximum(np.arange(1, len(total)) - SPAN, 0)
            # a stretch begins in its own text at the earliest
            owner = np.repeat(begin, np.diff(np.concatenate([begin - ORDER, [len(grams)]]))) if len(grams) else first
            stretch = (total[1:] - total[np.maximum(first, owner)]) / SPAN
            stretch[np.arange(len(grams)) < owner] = 0.0
            best = np.maximum.reduceat(stretch, begin - ORDER) if len(grams) else np.zeros(len(begin))
            out.append(np.column_stack([whole, np.maximum(best, 0.0)]))
        return np.concatenate(out)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.features(column) @ self.weights[1:], -700, 700)))


def _shared(grams: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each gram's last byte after the others."""
    if order == 1:
        return 0.999 * counts / counts.sum() + 0.001 / 256
    _, context = np.unique(grams >> np.uint32(8), return_inverse=True)
    total, kinds = np.bincount(context, counts), np.bincount(context)
    lower, at = np.unique(grams & np.uint32((1 << (8 * (order - 1))) - 1), return_inverse=True)
    below = _shared(lower, np.bincount(at).astype(float), order - 1)[at]
    return (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[context] * below) / total[context]


def contrast(counted: DataFrame, usual: float) -> DataFrame:
    """(gram, says) of the grams of ``counted`` (gram, ordinary, toxic) that say something; usual: the toxic share of all counts.

    What one says is its log probability in toxic rows less that in ordinary ones. A context has 256 grams at most, so
    none of the joins and windows deals many rows to one key.
    """
    part = lambda size: F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1).cast("long"))
    context = F.shiftright("gram", 8).alias("context")
    # the shared model's lower orders count distinct left contexts
    third = cut(counted.groupBy(part(3).alias("gram")).agg(F.count("*").alias("n")))
    second = third.groupBy(part(2).alias("gram")).agg(F.count("*").alias("n")).toPandas().sort_values("gram")
    second["below"] = _shared(second["gram"].to_numpy().astype(np.uint32), second["n"].to_numpy(float), 2)
    second = F.broadcast(counted.sparkSession.createDataFrame(second[["gram", "below"]], "lower long, below double"))
    totals = F.broadcast(third.groupBy(context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")))
    third = third.select("gram", "n", context, part(2).alias("lower")).join(second, "lower").join(totals, "context")
    third = third.select(F.col("gram").alias("lower"), ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")).alias("below"))

    over = Window.partitionBy("context")
    ordinary, toxic = F.col("ordinary"), F.col("toxic")
    rows = counted.select("gram", "ordinary", "toxic", context, part(3).alias("lower")).select(
        "*",
        F.count("*").over(over).alias("kinds"),
        *[F.sum(c).over(over).alias(f"{c}_total") for c in ("ordinary", "toxic")],
        *[F.count(F.when(F.col(c) > 0, 1)).over(over).alias(f"{c}_kinds") for c in ("ordinary", "toxic")],
    )
    both, total = ordinary + toxic, F.col("ordinary_total") + F.col("toxic_total")
    rows = rows.join(third, "lower").withColumn("shared", (F.greatest(both - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below")) / total)
    share = (F.col("toxic_total") + PRIOR * usual) / (total + PRIOR)
    expected = both * share
    log = {c: F.log((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + (DISCOUNT * F.col(f"{c}_kinds") + PRIOR) * F.col("shared")) / (F.col(f"{c}_total") + PRIOR)) for c in ("ordinary", "toxic")}
    rows = rows.filter(F.abs(toxic - expected) > Z * F.sqrt(expected * (1 - share) + 0.25))
    return rows.select("gram", (log["toxic"] - log["ordinary"]).cast("float").alias("says")).filter("says <> 0")


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of 1 and of x's columns, by Newton's method with a weak ridge on scaled columns."""
    scale = x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([np.ones(len(x)), x / scale])
    ridge = np.array([1e-6, 0.1, 0.1])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
    return b / np.concatenate([[1], scale])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the rows of ``docs`` that ``labels`` (one id column of the same name, 0/1 labels) covers."""
    own = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_toxic")).filter("_id is not null and _toxic is not null")
    own = own.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    known = own.count()
    seen = F.broadcast(own) if known <= BROADCAST_ROWS else own
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(seen, "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            grams, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            a, b = (np.bincount(at, np.concatenate([h[i] for h in held]), len(grams)).astype(np.int64) for i in (1, 2))
            return pa.record_batch([pa.array(grams.astype(np.int64)), pa.array(a), pa.array(b)], ["gram", "ordinary", "toxic"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, data, offsets in w.runs(batch.column(0)):
                grams, begin = _grams(data, offsets)
                own = np.zeros(len(grams), bool)
                own[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(offsets)), np.diff(offsets))] = True
                toxic = np.repeat(label[first : first + len(begin)] > 0, np.diff(offsets))
                found, at = np.unique(grams[own], return_inverse=True)
                held.append((found, np.bincount(at, ~toxic, len(found)), np.bincount(at, toxic, len(found))))
                size += len(found)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = rows.select("_text", "_toxic").mapInArrow(trimmed(count), "gram long, ordinary long, toxic long")
    counted = cut(counted.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    ordinary, toxic = counted.agg(F.coalesce(F.sum("ordinary"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not (ordinary and toxic):
        share = own.agg(F.avg("_toxic")).first()[0] or 0.0
        odds = np.log(share / (1 - share)) if 0 < share < 1 else (700.0 if share else -700.0)
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), np.array([odds, 0.0, 0.0]))
    found = contrast(counted, toxic / (ordinary + toxic)).toPandas().sort_values("gram")
    model = Model(found["gram"].to_numpy().astype(np.uint32), found["says"].to_numpy(np.float32), np.zeros(3))

    chosen = own.orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION)
    given = spark_broadcast(docs, model)

    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        return pa.array(given.value.features(column).tolist(), pa.list_(pa.float64()))

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    sample = rows.select("_toxic", features(text_or_empty("_text")).alias("x")).toPandas()
    model.weights = _logistic(np.array(sample["x"].tolist()), sample["_toxic"].to_numpy(float))
    return model


def spark_broadcast(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast(model)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score as ``out_col`` (which replaces a column of that name)."""
    given = spark_broadcast(docs, model)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        found = pa.array(given.value.scores(column))
        release()
        return found

    return small_batches(docs).withColumn(out_col, run(text_or_empty(F.col(text_col).cast("string"))))
