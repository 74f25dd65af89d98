"""Label voting, recovery and section detection; fuzzy matching where no built-in expression exists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import relational
from tessera.operators.graph import _cut


def recovered(scores: dict[str, Column], floor: float = 0.5) -> tuple[Column, Column]:
    """Label and confidence of the best score: its share of all times min(1, best / 4); null below the floor."""
    total = F.greatest(sum(scores.values(), F.lit(0.0)), F.lit(1e-9))
    best = F.array_max(F.array(*[F.struct(s.cast("double").alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]))
    confidence = best["s"] / total * F.least(F.lit(1.0), best["s"] / 4)
    return F.when(confidence >= floor, best["k"]), F.round(confidence, 6)


def section_votes(votes: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """Weighted votes per section: the best label, its share as confidence, first label on ties."""
    sums = votes.groupBy(*keys, label).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    rows = sums.withColumn("_t", F.sum("_w").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_w"), label))).filter("_r = 1")
    return rows.select(*keys, F.col(label).alias("label"), F.round(F.col("_w") / F.col("_t"), 6).alias("confidence"))


def canonical_topic(topic: Column, exact: dict[str, str], keywords: list[tuple[str, str]], default: Column) -> Column:
    """Exact name, else the first keyword cascade that matches, else a default."""
    out = default
    for word, name in reversed(keywords):
        out = F.when(F.contains(F.lower(topic), F.lit(word)), name).otherwise(out)
    for raw, name in exact.items():
        out = F.when(topic == raw, name).otherwise(out)
    return out


def longest_keyword(text: Column, topics: dict[str, list[str]]) -> Column:
    """The topic of the longest keyword found; the first of equals; null without one."""
    found = [F.when(F.contains(F.lower(text), F.lit(k)), F.struct(F.lit(len(k)).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t"))) for i, (t, ks) in enumerate(topics.items()) for k in ks]
    return F.array_max(F.array_compact(F.array(*found)))["t"]


def page_context(questions: DataFrame, pages: DataFrame, keys: list[str], number: str, per_page: int = 4, offset: int = 3) -> DataFrame:
    """Questions with the label of the page that their number computes to."""
    at = (F.floor(F.col(number) / per_page) + offset).cast("int")
    return questions.withColumn("page_no", at).join(pages, [*keys, "page_no"], "left")


def best_recogniser(results: DataFrame, keys: list[str], text: str, confidence: str) -> DataFrame:
    """The text of the highest confidence above 0; of equals the least engine text."""
    rows = results.filter(F.col(confidence) > 0)
    return rows.groupBy(*keys).agg(F.max_by(text, F.struct(confidence, text)).alias("text"), F.max(confidence).alias("confidence"))


def page_text(native: Column, recognised: Column, confidence: Column, least: int = 40) -> tuple[Column, Column]:
    """The native layer if it is long enough (counting as confidence 99), else the recognised text."""
    long = F.length(F.coalesce(native, F.lit(""))) >= least
    return F.when(long, native).otherwise(recognised), F.when(long, 99.0).otherwise(confidence)


def merged_blocks(blocks: DataFrame, keys: list[str], x: str, y: str, confidence: str, order: list[str], cell: float = 10.0) -> DataFrame:
    """One block per grid cell, the surest."""
    rows = blocks.withColumn("_x", F.floor(F.col(x) / cell + 0.5)).withColumn("_y", F.floor(F.col(y) / cell + 0.5))
    w = Window.partitionBy(*keys, "_x", "_y").orderBy(F.desc(confidence), *order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_x", "_y", "_r")


def _distance_within(text: str, pattern: str, most: int) -> int | None:
    """Least edit distance of the pattern to a substring of the text, if at most ``most``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != t))
        if min(row) > most:
            return None
    return min(row)


def fuzzy_found(df: DataFrame, text: str, pattern: str, most: int | None = None, out: str = "distance") -> DataFrame:
    """Edit distance of a pattern to the nearest substring, null beyond ``most`` (by length 0, 1 or 2).

    Rows that contain the pattern never reach Python: both halves are separate branches.
    """
    allowed = most if most is not None else 0 if len(pattern) < 4 else 1 if len(pattern) < 8 else 2

    @F.arrow_udf(T.IntegerType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _distance_within(t, pattern, allowed) for t in column.to_pylist()], pa.int32())

    exact = F.coalesce(F.contains(F.col(text), F.lit(pattern)), F.lit(False))
    return df.filter(exact).withColumn(out, F.lit(0)).union(df.filter(~exact).withColumn(out, run(F.col(text))))


def concept_tags(df: DataFrame, key: str, text: str, concepts: list[tuple[str, str, str]], most: int = 20) -> DataFrame:
    """(key, category, tag, at, confidence): dictionary words found, earlier ones surer, at most so many in order of place."""
    found = F.array(*[F.struct(F.instr(F.lower(text), w).alias("at"), F.lit(c).alias("category"), F.lit(t).alias("tag")) for w, t, c in concepts])
    some = F.slice(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), 1, most)
    rows = df.select(key, F.length(text).alias("_n"), F.explode(some).alias("x"))
    return rows.select(key, "x.category", "x.tag", "x.at", F.round(1 - 0.5 * F.col("x.at") / F.col("_n"), 6).alias("confidence"))


def _settled(degree: np.ndarray, near: Callable[[int], tuple[np.ndarray, np.ndarray]], passes: int) -> np.ndarray:
    """Each node's community, by its least node, after single-level greedy moves of the nodes in order; ``near(v)``: v's neighbours and their weights.

    A node goes where its links less what chance gives are most: it stays on ties, else the least community wins.
    """
    whole = degree.sum() or 1.0
    home = np.arange(len(degree))
    total = degree.copy()
    for _ in range(passes):
        live, home = np.unique(home, return_inverse=True)  # numbers stay in order
        total, moved = total[live], False
        for v in range(len(degree)):
            at, weight = near(v)
            links = np.bincount(home[at], weight, len(live))
            own = home[v]
            total[own] -= degree[v]
            gain = links - total * degree[v] / whole
            known = links > 0
            known[own] = True
            gain = np.where(known, gain, -np.inf)
            best = gain.argmax()
            best = own if gain[own] >= gain[best] else best
            moved |= best != own
            home[v] = best
            total[best] += degree[v]
        if not moved:
            break
    first = np.full(len(total), len(home))
    np.minimum.at(first, home, np.arange(len(home)))
    return first[home]


def louvain(edges: DataFrame, graph: str, passes: int = 10) -> DataFrame:
    """(graph, node, community): single-level greedy communities of each graph, nodes in order, named by their least node (K7). Weights are positive, loops say nothing.

    Sequential by definition: a graph's edges are arrays of one task. Where edges are items in the same sessions, ``louvain_shared`` needs none.
    """

    def run(pdf):
        pdf = pdf[pdf["src"] != pdf["dst"]]
        nodes, ends = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
        src, dst = np.split(ends, 2)
        src, dst, weight = np.concatenate([src, dst]), np.concatenate([dst, src]), np.tile(pdf["weight"].to_numpy(float), 2)
        order = np.lexsort((dst, src))
        src, dst, weight = src[order], dst[order], weight[order]
        at = np.searchsorted(src, np.arange(len(nodes) + 1))
        found = _settled(np.bincount(src, weight, len(nodes)), lambda v: (dst[at[v] : at[v + 1]], weight[at[v] : at[v + 1]]), passes)
        return pd.DataFrame({graph: pdf[graph].iloc[0] if len(pdf) else None, "node": nodes, "community": nodes[found]})

    kinds = dict(edges.dtypes)
    return edges.groupBy(graph).applyInPandas(run, f"{graph} {kinds[graph]}, node {kinds['src']}, community {kinds['src']}")


#: Bytes of the sums that are kept for communities of several nodes; with more of them, links are added up anew at each visit.
SUMS = 1 << 29


def _settled_shared(sharing: relational.Sharing, of: np.ndarray, degree: np.ndarray, passes: int) -> np.ndarray | None:
    """``_settled`` of items with bitmaps ``of`` of ``sharing``, in whole millionths; None if the sums would be too many.

    A community of several nodes keeps the sum of its weights to each bitmap, so a visit looks up a number of each such
    community, and only a move counts weights. Nodes that are alone are looked at where one of them can be best: their
    links are 1 at most.
    """
    whole, n, m = float(degree.sum()) or 1.0, len(of), len(sharing.base)
    home, size, alone = np.arange(n), np.ones(n, np.int64), np.ones(n, bool)
    place = np.full(n, -1)  # a community's place among the sums
    sums, total, label = np.zeros((4, m), np.int64), np.zeros(4), np.full(4, n)
    free = list(range(3, -1, -1))
    self_weight = np.where(sharing.size >= sharing.least, 1_000_000, 0)[of]
    for _ in range(passes):
        moved = False
        for v in range(n):
            d, own, at = degree[v], home[v], place[home[v]]
            links = sums[:, of[v]]
            rest = total
            if at >= 0:
                links, rest = links.copy(), total.copy()
                links[at] -= self_weight[v]
                rest[at] -= d
            gain = np.where(links > 0, links - rest * d / whole, -np.inf)
            stay = gain[at] if at >= 0 and links[at] > 0 else -rest[at] * d / whole if at >= 0 else 0.0
            most = gain.max()
            best = label[gain == most].min() if most > -np.inf else n
            weight = None
            if most <= 1e6 and alone.any():
                weight = sharing.weights(of[v])
                others = np.flatnonzero(alone)
                near = weight[of[others]]
                single = np.where((near > 0) & (others != v), near - degree[others] * d / whole, -np.inf)
                i = single.argmax()
                if single[i] > most or (single[i] == most > -np.inf and others[i] < best):
                    most, best = single[i], others[i]
            if stay >= most or best == own:
                continue
            moved = True
            weight = sharing.weights(of[v]) if weight is None else weight
            if at >= 0:
                sums[at] -= weight
                total[at] -= d
                size[own] -= 1
                if not size[own]:
                    total[at], label[at], place[own] = 0.0, n, -1
                    free.append(at)
            alone[v] = False
            to = place[best]
            if to < 0:  # until now a node alone
                if not free:
                    if 2 * sums.nbytes > SUMS:
                        return None
                    free = list(range(2 * len(sums) - 1, len(sums) - 1, -1))
                    sums, total, label = np.vstack([sums, np.zeros_like(sums)]), np.concatenate([total, np.zeros_like(total)]), np.concatenate([label, np.full_like(label, n)])
                to = place[best] = free.pop()
                alone[best] = False
                sums[to], total[to], label[to], size[best] = sharing.weights(of[best]), degree[best], best, 1
            sums[to] += weight
            total[to] += d
            size[best] += 1
            home[v] = best
        if not moved:
            break
    first = np.full(n, n)
    np.minimum.at(first, home, np.arange(n))
    return first[home]


def louvain_shared(rows: DataFrame, session: str, item: str, least: int, passes: int = 10) -> DataFrame:
    """(node, community) as ``louvain`` gives them for the pairs of ``relational.co_occurrence`` weighing by their Jaccard similarity (K7).

    No pairs are made: items are bitmaps of sessions, and weights are counted from different ones; the degrees in all tasks. The
    visits are in order by definition, so one task holds the bitmaps, a few words an item, and SUMS at most; its time is the moves
    times the different bitmaps. Of more than ``relational.SESSIONS`` sessions the pairs are made.
    """
    rows = rows.select(session, item).filter(F.col(session).isNotNull() & F.col(item).isNotNull()).distinct()
    sessions = [r[0] for r in rows.select(session).distinct().limit(relational.SESSIONS + 1).collect()]
    if len(sessions) > relational.SESSIONS:
        pairs = relational.co_occurrence(rows, session, item, least)
        return louvain(pairs.select(F.lit(0).alias("_g"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("jaccard").alias("weight")), "_g").drop("_g")
    bits, words = relational.session_bits(rows, sessions, session, [item])
    bits = _cut(bits)
    names = [f"_w{w}" for w in range(words)]
    met = bits.join(relational.shared_degrees(bits, words, least).select(*names, "_degree").hint("broadcast"), names)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(item)
        items, degree = table[item], table["_degree"].to_numpy()
        maps, of = np.unique(np.stack([table[c].to_numpy() for c in names], 1), axis=0, return_inverse=True)
        of = of.ravel()
        sharing = relational.Sharing([np.ascontiguousarray(m) for m in maps.T], least)
        found = _settled_shared(sharing, of, degree, passes)
        if found is None:

            def near(v: int) -> tuple[np.ndarray, np.ndarray]:
                weight = sharing.weights(of[v])[of]
                weight[v] = 0
                at = np.flatnonzero(weight)
                return at, weight[at].astype(float)

            found = _settled(degree.astype(float), near, passes)
        met = np.flatnonzero(degree > 0)
        return pa.table({"node": items.take(pa.array(met)), "community": items.take(pa.array(found[met]))})

    kind = dict(rows.dtypes)[item]
    return met.groupBy().applyInArrow(run, f"node {kind}, community {kind}")
