"""Mixing sources to target weights by systematic sampling.

Targets. Sources share the size of all documents by weight, but none takes more than MOST times its own size; what
is above that is shared again by weight among the others until none is above: rounds of sums over sources, in which
those above their bound are set to it, until no round sets one more.

Sampling. Every document of a source expects target / source size copies. Expected copies are summed up, one random
offset from 0 to 1 (a hash of source and seed) is added, and each document is emitted once per integer that its stretch
of the sum crosses: its copies are the floor of the expectation or one more, so none is taken more than MOST times.
Documents are in order of size, so that neighbours are alike and the words taken come near the target. The words taken
can miss by about the largest document, which counts where a document is a good part of its source: those of more than
a part in LARGE of their source (LARGE of them at most) expect a whole number of copies each, rounded in order of
falling size with what was rounded before carried on; the others of the source expect what is then left of its target.
A whole number crosses as many integers whatever the offset, so large documents need not be ordered with the others.

The running sum needs no source in one task: documents are counted by source and band of sizes (bands of about
1.6 %), bands by salted parts of PART documents or so, and each part starts from the sum of the parts before it.

Null texts have size 0; a source may be null (one source, last). Rows with equal ids and texts are documents of
their own. In a source of size 0, and for no rows at all, target and taken are 0. Order and offset depend only on
rows and seed: reruns agree.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, WORD_PATTERN, cut, free_name

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of more than such a part of their source expect whole numbers of copies.
LARGE = 100
#: Documents of a band of sizes that one task orders.
PART = 2048


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """``sources`` with their place from 0 by code point, null last, as _place."""
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, start = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        start.append((r["part"], before))
        before += r["count"]
    starts = ordered.sparkSession.createDataFrame(start, "_part long, _start long")
    return ordered.join(F.broadcast(starts), part == F.col("_part")).withColumn("_place", F.col("_start") + low).drop("_at", "_part", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: weights repeat over sources by code point, null last."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    rows = cut(_placed(sources).withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size").cast("double") * most))
    total = rows.agg(F.sum("source_size")).first()[0]
    level, capped = 0.0, -1
    above = F.lit(False)
    while True:
        free, spent, now = rows.agg(F.sum(F.when(~above, F.col("_w"))), F.sum(F.when(above, F.col("_cap"))), F.count(F.when(above, 1))).first()
        if now == capped or free is None:
            break
        capped, level = now, ((total or 0) - (spent or 0.0)) / free
        above = above | (F.col("_w") * F.lit(level) > F.col("_cap"))
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def _large_copies(key, t):
    """The large documents of a source (LARGE rows at most) with whole numbers of copies."""
    t = t.take(pa.compute.sort_indices(t, [("size", "descending"), ("h", "ascending"), ("_id", "ascending")]))
    left, copies = 0.0, []
    for size, rate in zip(t.column("size").to_pylist(), t.column("_rate").to_pylist()):
        least = int(rate)
        given = least if rate == least else min(least + 1, max(least, round((left + rate * size) / size)))
        left += (rate - given) * size
        copies.append(given)
    return t.append_column("copies", pa.array(copies, pa.int32())).drop_columns(["_rate"])


def _copies(rows: DataFrame, seed: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows (_id, source, size, h): with source_size, target and copies; h breaks ties of size."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    rows = rows.withColumn("_band", F.floor(F.log(F.col("size").cast("double") + 1) * 64).cast("long"))
    bands = cut(rows.groupBy("source", "_band").agg(F.sum("size").alias("_size"), F.max("size").alias("_most")))
    sources = cut(bands.groupBy("source").agg(F.sum("_size").cast("long").alias("source_size"), F.max("_most").alias("_most")))
    shares = targets(sources.drop("_most"), weights, most)
    shares = shares.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    shares = cut(shares.withColumnRenamed("source", "_s"))
    n = shares.count()
    small = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df

    # large documents: few, and only of sources that have one
    with_large = sources.filter(F.col("_most") * LARGE > F.col("source_size")).select(F.col("source").alias("_s"))
    with_large = shares.join(small(with_large.withColumnRenamed("_s", "_l")), F.col("_s").eqNullSafe(F.col("_l")), "left_semi")
    is_large = F.col("size") * LARGE > F.col("source_size")
    large = rows.join(small(with_large), same("source", "_s")).filter(is_large).select("_id", "source", "size", "h", "source_size", "target", "_rate")
    schema = large.drop("_rate").withColumn("copies", F.lit(0).cast("int")).schema
    large = cut(large.groupBy("source").applyInArrow(_large_copies, schema))
    used = large.groupBy(F.col("source").alias("_u")).agg(F.sum("size").alias("_size"), F.sum(F.col("size") * F.col("copies")).alias("_taken"))
    rest, budget = F.col("source_size") - F.coalesce("_size", F.lit(0)), F.col("target") - F.coalesce("_taken", F.lit(0))
    rate = F.when(F.col("_size").isNull(), F.col("_rate")).when(rest > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), budget / rest))).otherwise(0.0)
    shares = shares.join(small(used), F.col("_s").eqNullSafe(F.col("_u")), "left").select("_s", "source_size", "target", rate.alias("_rate"))
    shares = cut(shares)

    # the others: places in the order of sizes
    rows = cut(rows.join(small(shares), same("source", "_s")).filter(~is_large).drop("_s"))
    counts = cut(rows.groupBy("source", "_band").agg(F.count("*").alias("_n")))
    named = counts.select(F.col("source").alias("_s"), F.col("_band").alias("_b"), F.ceil(F.col("_n") / PART).alias("_parts"))
    rows = cut(rows.join(named, same("source", "_s") & (F.col("_band") == F.col("_b"))).withColumn("_part", F.pmod(F.col("h"), F.col("_parts"))).drop("_s", "_b", "_parts"))
    parts = rows.groupBy("source", "_band", "_part").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("source").orderBy("_band", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_s"), F.col("_band").alias("_b"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_start"))
    rows = rows.join(parts, same("source", "_s") & (F.col("_band") == F.col("_b")) & (F.col("_part") == F.col("_p"))).drop("_s", "_b", "_p")
    order = Window.partitionBy("source", "_band", "_part").orderBy("size", "h", F.col("_id").asc_nulls_first())
    rank = F.col("_start") + F.row_number().over(order)
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0")), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn("_rank", rank).withColumn("_u", offset)
    copies = F.floor(F.col("_rank") * F.col("_rate") + F.col("_u")) - F.floor((F.col("_rank") - 1) * F.col("_rate") + F.col("_u"))
    names = ["_id", "source", "size", "source_size", "target"]
    return rows.select(*names, copies.cast("int").alias("copies")).union(large.select(*names, "copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = cut(rows.withColumn("h", F.xxhash64("_id", F.lit(seed))))
    return _copies(rows, seed, weights, most).select(F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies. Rows of one id and source share their copies evenly."""
    found = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, weights=weights, most=most)
    # rows of one id, source and size are alike to the mix: the i-th of them gets the i-th number of copies
    i, s, n, c, at, size, copy = (free_name(docs, f"_mix_{x}") for x in ("id", "source", "size", "copies", "at", "own", "copy"))
    given = found.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(c))
    keyed = docs.withColumn(size, n_words(F.col(text_col)))
    on = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(s)) & (F.col(size) == F.col(n))
    given = cut(given)
    first = keyed.join(given.filter(F.size(c) == 1).withColumn(c, F.col(c)[0]), on).select(*keyed.columns, c)
    several = given.filter(F.size(c) > 1)
    if several.isEmpty():
        out = first
    else:
        order = Window.partitionBy(id_col, source_col, size).orderBy(F.xxhash64(text_col))
        rest = keyed.join(several, on).withColumn(at, F.row_number().over(order)).select(*keyed.columns, F.element_at(c, F.col(at)).alias(c))
        out = first.unionByName(rest)
    out = out.filter(F.col(c) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)
