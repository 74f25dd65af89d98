"""Batch retrieval: trigram similarity join, matches of all terms, nearest vectors by inverted-file cells, and their blend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.search import met_postings, tokens

#: Rows whose vectors fit the cells' centres, at most; every row is indexed.
SAMPLE = 4096
#: Rows of one part of a cell: what a task holds.
PART = 4096
#: Queries of one block of the trigram join.
ASKED = 512


def trigram_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, g): distinct trigrams of the lower-case words of letters and digits, each padded by two spaces before and one after; texts without words are left out.

    A trigram is a number of 63 bits: its three code points. A batch's different words are cut once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            named = words.flatten().dictionary_encode()
            cut = []
            for w in named.dictionary.to_pylist():
                c = np.frombuffer(f"  {w} ".encode("utf-32-le"), np.uint32).astype(np.int64)
                cut.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
            at, ends = np.asarray(named.indices), np.cumsum([0, *np.asarray(words.value_lengths())])
            sets = [np.unique(np.concatenate([cut[i] for i in at[m:n]])) for m, n in zip(ends, ends[1:])]
            if sets:
                offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["_id", "g"])

    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return df.select(F.col(key).alias("_id"), words.alias("_w")).filter(F.size("_w") > 0).mapInArrow(run, f"_id {dict(df.dtypes)[key]}, g array<long>")


def trigram_matches(docs: DataFrame, queries: DataFrame, key: str, query_key: str, text: str, least: float = 0.3) -> DataFrame:
    """(query, key, similarity) of all pairs whose sets of trigrams have a Jaccard similarity of ``least`` or more (R2).

    Only documents of a size that some query admits are met. They are dealt to parts, queries to blocks, and each part meets
    each block in one task, which counts common trigrams for all its pairs at once.
    """
    # a file of few row groups would be cut by as few tasks
    d, q = trigram_sets(docs.select(key, text).repartition(key), key, text), trigram_sets(queries, query_key, text)
    sizes = q.agg(F.min(F.size("g")).alias("_lo"), F.max(F.size("g")).alias("_hi"))
    d = d.join(F.broadcast(sizes)).filter((F.size("g") >= F.col("_lo") * least) & (F.size("g") * least <= F.col("_hi")))  # one row
    parts, blocks = -(-docs.count() // PART) or 1, -(-queries.count() // ASKED) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = d.select(F.col("_id").alias(key), F.col("g").alias("_d"), F.pmod(F.xxhash64("_id", "g"), F.lit(parts)).cast("int").alias("_p"), every(blocks).alias("_b"))
    q = q.select(F.col("_id").alias(query_key), F.col("g").alias("_q"), every(parts).alias("_p"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = (t[c].combine_chunks() for t, c in ((left, "_d"), (right, "_q")))
        size = np.asarray(theirs.value_lengths())
        grams, at = np.unique(np.asarray(theirs.flatten()), return_inverse=True)
        has = np.zeros((len(grams) + 1, len(size)), np.int32)  # the last row is of no trigram
        has[at, np.repeat(np.arange(len(size)), size)] = 1
        flat = np.asarray(mine.flatten())
        place = np.searchsorted(grams, flat)
        place[grams[np.minimum(place, len(grams) - 1)] != flat] = len(grams)
        own = np.asarray(mine.value_lengths())
        ends = np.cumsum([0, *own])
        out: list[list] = [[], [], []]
        for i, n in enumerate(own):
            both = has[place[ends[i] : ends[i + 1]]].sum(0)
            share = both / (n + size - both)
            j = np.flatnonzero(share >= least)
            out[0].append(np.full(len(j), i))
            out[1].append(j)
            out[2].append(share[j])
        i, j, share = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({query_key: right[query_key].take(pa.array(j.astype(np.int64))), key: left[key].take(pa.array(i.astype(np.int64))), "similarity": pa.array(share, pa.float64())})

    def both_sides(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows and right.num_rows else pa.table({query_key: right[query_key].slice(0, 0), key: left[key].slice(0, 0), "similarity": pa.array([], pa.float64())})

    schema = f"{query_key} {dict(queries.dtypes)[query_key]}, {key} {dict(docs.dtypes)[key]}, similarity double"
    return d.groupBy("_p", "_b").cogroup(q.groupBy("_p", "_b")).applyInArrow(both_sides, schema)


def term_rank(docs: DataFrame, queries: DataFrame, key: str, query_key: str, text: str) -> DataFrame:
    """(query, key, rank) of documents that hold all of a query's terms: the mean over terms of 0.1 (1 + 1/4 + ... + 1/tf^2) / (pi^2 / 6) (R2).

    Texts move once, by document; terms are met and counted there. The queries' terms are the small side.
    """
    terms = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(text), 1))).alias("term"))
    terms = terms.withColumn("_n", F.count("*").over(Window.partitionBy(query_key)))
    weight = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("tf"), F.lit(256).cast("long"))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / (i * i)) * (0.1 / 1.6449340668482264)
    met = met_postings(docs, key, text, terms, 1).select(key, "term", weight.alias("_v")).join(F.broadcast(terms), "term")
    found = met.groupBy(query_key, key, "_n").agg(F.count("*").alias("_met"), F.sum("_v").alias("_w"))
    return found.filter("_met = _n").select(query_key, key, (F.col("_w") / F.col("_n")).alias("rank"))


def _unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


def fitted_cells(vectors: DataFrame, key: str, vector: str, cells: int = 64, rounds: int = 10) -> np.ndarray:
    """Centres of ``cells`` cells, by k-means on the SAMPLE rows of least hashed key (R6); the first are those of least hash."""
    found = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow()
    x = _unit(found.column(0).combine_chunks())
    centres = x[:cells].copy()
    for _ in range(rounds):
        to = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            mean = x[to == c].sum(0)
            if np.any(mean):
                centres[c] = mean / np.sqrt(mean @ mean)
    return centres


def indexed(vectors: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """(key, cell, unit): every row's cell by cosine, and its unit vector (R6). Rows of null vectors are left out; all vectors have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(1))
                unit = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([batch.column(0), pa.array((x @ centres.T).argmax(1).astype(np.int32)), unit], [key, "cell", "unit"])

    rows = vectors.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, cell int, unit array<double>")


def nearest_batch(index: DataFrame, queries: DataFrame, key: str, centres: np.ndarray, k: int = 20, probes: int | None = None, query: str = "query") -> DataFrame:
    """(query, key, similarity, rank): the k nearest by cosine of each query row, itself excluded.

    index and queries are rows as ``indexed`` gives them. A query looks into the ``probes`` cells whose centres are
    nearest, None: into all, which is exact. Cells are dealt to parts of about PART rows, each part gives its k best per
    query, so neither a crowded cell nor a query's answers meet whole in one task.
    """
    kind = dict(index.dtypes)[key]
    number = pa.int64() if kind == "bigint" else pa.int32()

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(1))
                most = min(probes or len(centres), len(centres))
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                to = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), most).cast(pa.list_(pa.int32()))
                yield pa.record_batch([batch.column(0), batch.column(1), to], [query, "unit", "cells"])

    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))  # a row per cell
    asked = queries.select(key, "unit").mapInArrow(probed, f"{query} {kind}, unit array<double>, cells array<int>")
    asked = asked.select(query, "unit", F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    rows = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            q, x = (_unit(t["unit"].combine_chunks()) for t in (left, right))
            own, ids = np.asarray(left[query]), np.asarray(right[key])
            for first in range(0, len(q), 256):
                s = np.round(q[first : first + 256] @ x.T, 6) + 0.0
                s[own[first : first + 256, None] == ids] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=-1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                i, j = np.nonzero(best > -np.inf)
                out[0].append(own[first + i])
                out[1].append(ids[order[i, j]])
                out[2].append(best[i, j])
        flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({query: pa.array(flat[0]).cast(number), key: pa.array(flat[1]).cast(number), "similarity": pa.array(flat[2], pa.float64())})

    found = asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(run, f"{query} {kind}, {key} {kind}, similarity double")
    ranked = Window.partitionBy(query).orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def hybrid_batch(lexical: DataFrame, nearest: DataFrame, vectors: DataFrame, asked: DataFrame, key: str, query_key: str, weight: float = 0.45, k: int = 15) -> DataFrame:
    """(query, key, score, rank): the k best of each query by (1 - w) lexical + w cosine, scores above 0.

    lexical: (query, key, lex); nearest: (query, key) of each query's k nearest at least; vectors: (key, unit) as ``indexed``
    gives them; asked: (query, unit). A row without a lexical score is among the best only if it is among the k nearest, so
    these and the lexical matches are all candidates; each one's cosine is its own.
    """
    rows = lexical.join(nearest.select(query_key, key).distinct(), [query_key, key], "full").select(query_key, key, F.coalesce("lex", F.lit(0.0)).alias("lex"))
    rows = rows.join(vectors.select(key, F.col("unit").alias("_x")), key, "left").join(asked.select(query_key, F.col("unit").alias("_q")), query_key, "left")
    dot = F.aggregate(F.zip_with("_x", "_q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    score = F.round((1 - weight) * F.col("lex") + weight * F.coalesce(F.round(dot, 6), F.lit(0.0)), 6)
    rows = rows.select(query_key, key, score.alias("score")).filter("score > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)
