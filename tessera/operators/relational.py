"""Filters, joins, aggregates and set operations over question, tag, graph and review relations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sql_round, text_key
from tessera.operators.graph import statistics


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every condition given: column=value, column__ge, column__le, column__in; None means no condition (F1)."""
    ops = {"ge": lambda c, v: c >= v, "le": lambda c, v: c <= v, "in": lambda c, v: c.isin(list(v)), "eq": lambda c, v: c == v}
    tests = [ops[(name.split("__") + ["eq"])[1]](F.col(name.split("__")[0]), v) for name, v in wanted.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def keyword_match(text: Column, keyword: str | None) -> Column:
    """Substring or whole-word match, case aside; an empty keyword matches all (F2)."""
    if not keyword:
        return F.lit(True)
    return F.contains(F.lower(text), F.lit(keyword.lower())) | F.array_contains(F.split(F.lower(text), r"[^a-z0-9]+"), keyword.lower())


def ranked_page(df: DataFrame, text: str, keyword: str, order: list[Column], page: int = 1, size: int = 20, shown: int = 600) -> DataFrame:
    """A page of the matches, ranked by occurrences (substring hits weigh 0.5 more), with the total."""
    size, offset = max(1, min(size, 100)), max(0, (page - 1) * size)
    found = df.filter(keyword_match(F.col(text), keyword))
    lower = F.lower(F.col(text))
    times = (F.length(lower) - F.length(F.replace(lower, F.lit(keyword.lower()), F.lit("")))) / len(keyword)
    found = found.withColumn("rank", F.round(F.log(times + 1) + F.when(times > 0, 0.5).otherwise(0.0), 6))
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(F.desc("rank"), *order).offset(offset).limit(size)
    return rows.join(F.broadcast(total)).withColumn(text, F.left(text, F.lit(shown)))  # one row


def indexed(df: DataFrame, domain: str | None = None, year: int | None = None, round_: int | None = None) -> DataFrame:
    """Lookup by domain and year, domain, or year with its round (1 unless given)."""
    if domain is not None:
        return optional_filter(df, domain=domain, exam_year=year)
    return optional_filter(df, exam_year=year, exam_round=None if year is None else (round_ or 1))


def number_fault(number: Column, least: int = 1, most: int = 38) -> Column:
    """Why a question number can't be one, or null."""
    value = number.try_cast("double")
    return (
        F.when(number.isNull() | (number == ""), "absent")
        .when(value.isNull() | (value != F.floor(value)), "non_integer")
        .when(value >= 1000, "thousands")
        .when(value > 100, "over_100")
        .when(value < least, "below_min")
        .when(value > most, "out_of_range")
    )


def selected_by_threshold(df: DataFrame, score: str, forced: Column, threshold: float, most: int, ties: list[str]) -> DataFrame:
    """Forced rows and those at the threshold, at most so many, forced and high first."""
    rows = df.withColumn("forced", forced).filter(F.col("forced") | (F.col(score) >= threshold))
    rows = rows.orderBy(F.desc("forced"), F.desc(score), *ties).limit(most)  # most rows at most from here on
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("forced"), F.desc(score), *ties)))


def training_eligible(df: DataFrame, confidence: str, quality: str, label: str, least: float, least_quality: float) -> DataFrame:
    """Rows fit for training: confidence unknown or high, quality known and high, label known."""
    return df.filter((F.col(confidence).isNull() | (F.col(confidence) >= least)) & (F.col(quality) >= least_quality) & F.col(label).isNotNull())


def with_tag(df: DataFrame, tags: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows that have any of the tags: a semi-join."""
    return df.join(tags.filter(F.col("name").isin(names)).select(key), key, "left_semi")


def topic_frequency(df: DataFrame, keys: list[str], period: str, difficulty: str) -> DataFrame:
    """Count, periods in order, last period and mean difficulty of each key (A1, A2)."""
    rows = df.filter(F.col(keys[-1]).isNotNull() & (F.col(keys[-1]) != ""))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set(period)), ",").alias("periods"), F.max(period).alias("last_period"), F.round(F.avg(difficulty), 6).alias("avg_difficulty"))


def yearly_map(df: DataFrame, key: str, period: str) -> DataFrame:
    """{period: count} with the total, per key."""
    each = df.groupBy(key, period).agg(F.count("*").alias("n"))
    out = each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(period).cast("string"), "n")))).alias("by_period"), F.sum("n").alias("total"))
    return out


def weakness(wrong: DataFrame, frequency: DataFrame, subject: str, topic: str) -> DataFrame:
    """0.6 of wrong answers, capped at five, and 0.4 of the topic's frequency in its subject's largest."""
    by = wrong.groupBy(subject, topic).agg(F.count("*").alias("wrong"))
    norm = frequency.withColumn("_norm", F.col("total") / F.max("total").over(Window.partitionBy(subject)))
    out = by.join(norm.select(subject, topic, "_norm"), [subject, topic], "left")
    score = 0.6 * F.least(F.col("wrong"), F.lit(5)) / 5.0 + 0.4 * F.coalesce("_norm", F.lit(0.0))
    return out.select(subject, topic, "wrong", F.round(score, 6).alias("weakness"))


def ordered_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], text: Column) -> DataFrame:
    """Each parent with its children's texts in order, an empty string without any (J6, A3): grouped once, then joined."""
    joined = children.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda c: c["_t"]), "|").alias("children"))
    return parents.join(joined, key, "left").withColumn("children", F.coalesce("children", F.lit("")))


def first_by_kind(df: DataFrame, key: str, kind: str, kinds: list[str], value: str, order: list[str]) -> DataFrame:
    """The first value of each kind, a column per kind."""
    return df.groupBy(key).pivot(kind, kinds).agg(F.min_by(value, F.struct(*order)))


def linked_answers(questions: DataFrame, answers: DataFrame, keys: list[str], exam: str, value: str, order: list[str]) -> DataFrame:
    """Questions with their answer (the first of equal keys): linked, missing, or no answer document."""
    first = answers.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("answer"))
    documents = answers.select(exam).distinct().withColumn("_has", F.lit(True))
    out = questions.join(first, keys, "left").join(documents, exam, "left")
    return out.withColumn("status", F.when(F.col("answer").isNotNull(), "linked").when(F.col("_has"), "missing").otherwise("no_answer_doc")).drop("_has")


def backfilled(df: DataFrame, sources: list[tuple[DataFrame, str]], keys: list[str], column: str) -> DataFrame:
    """Nulls of a column filled by key from the first source that has the key (J9, J10, S7, S10); sources are (frame, name)."""
    every = reduce(DataFrame.unionByName, [s.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("_v")).withColumn("_p", F.lit(i)).withColumn("_name", F.lit(n)) for i, (s, n) in enumerate(sources)])
    best = every.groupBy(*keys).agg(F.min(F.struct("_p", "_v", "_name")).alias("_b"))
    out = df.join(best, keys, "left")
    named = F.when(F.col(column).isNotNull(), "own").otherwise(F.coalesce(F.col("_b")["_name"], F.lit("none")))
    return out.withColumn("filled_from", named).withColumn(column, F.coalesce(F.col(column), F.col("_b")["_v"])).drop("_b")


def audit(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Kept, changed, gained, lost, added and removed values between two versions."""
    a, b = before.select(key, F.col(column).alias("_a"), F.lit(True).alias("_in")), after.select(key, F.col(column).alias("_b"), F.lit(True).alias("_out"))
    rows = a.join(b, key, "full")
    state = (
        F.when(F.col("_in").isNull(), "added")
        .when(F.col("_out").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "kept")
        .when(F.col("_a").isNull(), "gained")
        .when(F.col("_b").isNull(), "lost")
        .otherwise("changed")
    )
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


#: Different sessions that fit the words of a bitmap; more are met by a join. Items that one is met with at once, pairs handed out at once, and met by a task.
SESSIONS, BLOCK, PAIRS, TASK_PAIRS = 256, 65_536, 65_536, 1 << 28


def session_bits(rows: DataFrame, sessions: list, session: str, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, _n, _w0, ...): each item's number of sessions, and the sessions as bits of words of 63; and the number of words."""
    place = rows.sparkSession.createDataFrame([(x, i // 63, i % 63) for i, x in enumerate(sessions)], f"`{session}` {dict(rows.dtypes)[session]}, _w int, _b int")
    words = max(1, -(-len(sessions) // 63))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b"))
    word = lambda w: F.coalesce(F.bit_or(F.when(F.col("_w") == w, bit)), F.lit(0).cast("long")).alias(f"_w{w}")
    placed = rows.join(F.broadcast(place), session, "left")  # SESSIONS rows at most
    return placed.groupBy(*keys).agg(F.count("*").alias("_n"), *[word(w) for w in range(words)]), words


class Sharing:
    """Different bitmaps of sessions, and the Jaccard similarities of those that share ``least`` sessions, in whole millionths; ``size``: their sessions, if one counts that has no bit."""

    def __init__(self, maps: list[np.ndarray], least: int, size: np.ndarray | None = None):
        small = len(maps) == 1 and maps[0].max(initial=0) < 1 << 32
        self.maps, self.least = [m.astype(np.uint32 if small else np.uint64) for m in maps], least
        size = sum(np.bitwise_count(m).astype(np.int32) for m in self.maps) if size is None else size
        self.size, self.most = size, int(size.max(initial=0)) + 1
        self.base, self.tables = size.astype(np.intp) * self.most, {}

    def weights(self, i: int) -> np.ndarray:
        """Of bitmap i to all; 0 for those that share less."""
        n = int(self.size[i])
        if n not in self.tables:
            both, other = np.arange(self.most), np.arange(self.most)[:, None]
            found = np.floor(both / np.maximum(n + other - both, 1) * 1e6 + 0.5)
            self.tables[n] = np.where(both >= self.least, found, 0).astype(np.int32).ravel()
        both = np.bitwise_count(self.maps[0] & self.maps[0][i])
        for m in self.maps[1:]:
            both = both.astype(np.int32) + np.bitwise_count(m & m[i])
        return self.tables[n].take(self.base + both, mode="clip")  # none is outside, and this is quicker


def shared_degrees(bits: DataFrame, words: int, least: int) -> DataFrame:
    """(_w0, ..., _items, _links, _degree): each different bitmap of ``session_bits``, its items, and each such item's neighbours and their weights in millionths.

    No pairs are made: bitmaps are dealt to tasks, which hold all of them, a few words each, and hand out a row per bitmap.
    """
    spark = bits.sparkSession
    names = [f"_w{w}" for w in range(words)]
    found = bits.groupBy("_n", *names).agg(F.count("*").alias("_items")).toArrow()
    maps, items = [found[c].to_numpy() for c in names], found["_items"].to_numpy()
    shared = spark.sparkContext.broadcast((maps, items, found["_n"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, items, size = shared.value
        sharing, share = Sharing(maps, least, size), items.astype(float)  # whole numbers below 2^53
        for batch in batches:
            at = batch.column(0).to_numpy()
            links, degree = (np.zeros(len(at), np.int64) for _ in range(2))
            for i, v in enumerate(at):
                weight = sharing.weights(v)
                own = weight[v]
                links[i], degree[i] = share @ (weight > 0) - (own > 0), share @ weight - own
            yield pa.record_batch([*[pa.array(m[at]) for m in maps], pa.array(items[at]), pa.array(links), pa.array(degree)], [*names, "_items", "_links", "_degree"])

    tasks = min(max(1, len(items)), 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, len(items), 1, tasks).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "_items", "_links", "_degree"]))


def co_occurrence_statistics(df: DataFrame, session: str, item: str, least: int = 1) -> DataFrame:
    """One row as ``graph.statistics`` has it of ``co_occurrence`` weighing by Jaccard similarity (A35): pairs are counted, not made.

    Time is the square of the different bitmaps, in tasks that hold these alone. Of more than SESSIONS sessions the pairs are made.
    """
    rows = df.select(session, item).filter(F.col(item).isNotNull()).distinct()
    sessions = [r[0] for r in rows.filter(F.col(session).isNotNull()).select(session).distinct().limit(SESSIONS + 1).collect()]
    if len(sessions) > SESSIONS:
        return statistics(co_occurrence(rows, session, item, least).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("jaccard").alias("weight")))
    bits, words = session_bits(rows, sessions, session, [item])
    each = F.col("_items") * F.col("_links")
    total = shared_degrees(bits, words, least).agg(
        F.coalesce(F.sum(F.when(F.col("_links") > 0, F.col("_items"))), F.lit(0)).alias("nodes"),
        F.coalesce(F.sum(each) / 2, F.lit(0)).cast("long").alias("edges"),
        F.sum((F.col("_items") * F.col("_degree")).cast("decimal(38,0)")).cast("double").alias("_w"),
    )
    return total.select("nodes", "edges", F.round(F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"), F.round(F.try_divide(F.col("_w") / 2e6, "edges"), 6).alias("mean_weight"))


def sharing_pairs(rows: DataFrame, session: str, item: str, least: int, group: list[str] | None = None) -> DataFrame:
    """(group, a, b, together, _n): pairs a < b of a group's items with ``least`` sessions in common, 1 or more, and their numbers of sessions added up.

    rows: different (group, session, item). Items are bitmaps of sessions, a few words each, which pass the driver and are held by all
    tasks; a task meets its items with those after them and hands pairs out as they come, so nothing but the result grows with the
    pairs. Null groups, sessions and items meet none.
    """
    group = group or []
    sessions = [r[0] for r in rows.filter(F.col(session).isNotNull()).select(session).distinct().limit(SESSIONS + 1).collect()]
    if len(sessions) > SESSIONS:
        each = rows.groupBy(*group, item).agg(F.count("*").alias("_n"))
        a, b = rows.select(*group, session, F.col(item).alias("a")), rows.select(*group, session, F.col(item).alias("b"))
        pairs = a.join(b, [*group, session]).filter("a < b").groupBy(*group, "a", "b").agg(F.count("*").alias("together")).filter(F.col("together") >= least)
        out = pairs.join(each.select(*group, F.col(item).alias("a"), F.col("_n").alias("_na")), [*group, "a"]).join(each.select(*group, F.col(item).alias("b"), F.col("_n").alias("_nb")), [*group, "b"])
        return out.select(*group, "a", "b", "together", (F.col("_na") + F.col("_nb")).alias("_n"))
    known = rows.dropna(subset=[*group, item])
    bits, words = session_bits(known, sessions, session, [*group, item])
    found = bits.orderBy(*group, item).toArrow().combine_chunks()  # the order puts a before b
    n, spark = found.num_rows, rows.sparkSession
    values = [found[g].to_numpy() for g in group]
    starts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], 0)) + 1 if group and n else []
    ends = np.repeat([*starts, n], np.diff([0, *starts, n]))
    shared = spark.sparkContext.broadcast((found, ends))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = shared.value
        sessions, maps = held["_n"].to_numpy(), [held[f"_w{w}"].to_numpy().astype(np.uint64) for w in range(words)]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def made() -> pa.RecordBatch:
            x, y, together = (np.concatenate(v) for v in zip(*parts))
            del parts[1:]
            columns = [held[g].take(x).combine_chunks() for g in group] + [held[item].take(v).combine_chunks() for v in (x, y)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(together), pa.array(sessions[x] + sessions[y])], [*group, "a", "b", "together", "_n"])

        for batch in batches:
            for i in batch.column(0).to_pylist():
                for x in {i, n - 1 - i}:  # an early item has many after it, a late one few
                    for begin in range(x + 1, int(ends[x]), BLOCK):
                        at = slice(begin, min(begin + BLOCK, int(ends[x])))
                        both = np.bitwise_count(maps[0][at] & maps[0][x])
                        for m in maps[1:]:
                            both = both.astype(np.int64) + np.bitwise_count(m[at] & m[x])
                        some = np.flatnonzero(both >= least)
                        parts.append((np.full(len(some), x), some + begin, both[some].astype(np.int64)))
                        if sum(len(p[0]) for p in parts) >= PAIRS:
                            yield made()
        yield made()

    half = -(-n // 2)
    tasks = min(max(1, half), max(4 * spark.sparkContext.defaultParallelism, half * n // TASK_PAIRS))
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], f"a {kinds[item]}", f"b {kinds[item]}", "together long", "_n long"])
    return spark.range(0, half, 1, tasks).mapInArrow(run, schema)


def co_occurrence(df: DataFrame, session: str, item: str, least: int = 1) -> DataFrame:
    """Pairs of items in the same sessions, with count, and Jaccard over sessions."""
    pairs = sharing_pairs(df.select(session, item).distinct(), session, item, least)
    return pairs.select("a", "b", "together", sql_round(F.col("together") / (F.col("_n") - F.col("together"))).alias("jaccard"))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Points in [low, high) of the same key (J15, J16): ranges are dealt to buckets of a width, so it is an equi-join."""
    dealt = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    rows = points.withColumn("_bucket", F.floor(F.col(at) / width)).join(dealt, [*keys, "_bucket"])
    return rows.filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], low: str, high: str, width: float) -> DataFrame:
    """Pairs of overlapping intervals (J15): met in the bucket where the later one begins, so each pair once."""
    deal = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys]).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_{low}") / width), F.floor(F.col(f"{p}_{high}") / width))))
    rows = deal(a, "a").join(deal(b, "b"), [*keys, "_bucket"])
    rows = rows.filter((F.col(f"a_{low}") <= F.col(f"b_{high}")) & (F.col(f"b_{low}") <= F.col(f"a_{high}")))
    return rows.filter(F.col("_bucket") == F.floor(F.greatest(f"a_{low}", f"b_{low}") / width)).drop("_bucket")


#: Rows of one block of intervals, and a kind's blocks at most: what is moved and compared grows with the rows, not their square.
INTERVALS, INTERVAL_BLOCKS = 131_072, 8


def _overlap_counts(ids: np.ndarray, low: np.ndarray, high: np.ndarray, x_ids: np.ndarray, x_low: np.ndarray, x_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x, how many overlapping intervals have a greater id, and the greatest such id.

    Those that overlap are those that begin by x's end less those that end before its begin. Both are counted in each of the
    halves, quarters, ... of the intervals by id, by sorted ranks. What ends before it begins is compared one by one.
    """
    n, last = np.zeros(len(x_ids), np.int64), np.full(len(x_ids), np.iinfo(np.int64).min)
    low, high, x_low, x_high = (np.where(np.isnan(v), np.inf, v) for v in (low, high, x_low, x_high))
    order = np.argsort(ids, kind="stable")
    ids, low, high = ids[order], low[order], high[order]
    odd = low > high
    for i in np.flatnonzero(odd):
        met = (ids[i] > x_ids) & (low[i] <= x_high) & (x_low <= high[i])
        n += met
        last = np.where(met, np.maximum(last, ids[i]), last)
    ids, low, high = ids[~odd], low[~odd], high[~odd]
    for i in np.flatnonzero(x_low > x_high):
        met = (ids > x_ids[i]) & (low <= x_high[i]) & (x_low[i] <= high)
        n[i] += met.sum()
        last[i] = max(last[i], ids[met].max(initial=last[i]))
    at = np.flatnonzero(x_low <= x_high)
    if not len(at) or not len(ids):
        return n, last
    at = at[np.argsort(x_ids[at], kind="stable")]
    m = len(ids)
    depth = (m - 1).bit_length()
    begun, ended = np.searchsorted(np.sort(low), x_high[at], "right"), np.searchsorted(np.sort(high), x_low[at], "left")
    levels = []
    place = np.arange(m)
    begins, ends = (np.empty(m, np.int64) for _ in range(2))
    begins[np.argsort(low, kind="stable")] = place
    ends[np.argsort(high, kind="stable")] = place
    for d in range(depth + 1):
        levels.append((np.sort((place >> d) * (m + 1) + begins), np.sort((place >> d) * (m + 1) + ends)))

    def inside(d: int, node: np.ndarray, which) -> np.ndarray:
        return np.searchsorted(levels[d][0], node * (m + 1) + begun[which]) - np.searchsorted(levels[d][1], node * (m + 1) + ended[which])

    first = np.searchsorted(ids, x_ids[at], "right")
    found = np.zeros(len(at), np.int64)
    for d in range(depth + 1):
        alone = np.flatnonzero(first & 1 if d < depth else first == 0)
        found[alone] += inside(d, first[alone], alone)
        first = (first + 1) >> 1
    some = np.flatnonzero(found)
    node = np.zeros(len(some), np.int64)
    for d in range(depth - 1, -1, -1):
        node = 2 * node + 1
        node -= inside(d, node, some) == 0
    n[at] += found
    last[at[some]] = np.maximum(last[at[some]], ids[node])
    return n, last


def overlaps_after(df: DataFrame, keys: list[str], key: str, low: str, high: str) -> DataFrame:
    """(keys, a, n, last): how many intervals of greater key overlap each one, and the greatest of these keys; those without any are left out.

    Pairs are counted, not made: a kind's intervals are dealt to blocks, and each two blocks meet in one task. Keys are integers.
    """
    rows = df.select(*keys, F.col(key).cast("long").alias("_a"), F.col(low).cast("double").alias("_low"), F.col(high).cast("double").alias("_high")).na.drop()
    blocks = rows.groupBy(*keys).agg(F.least(F.ceil(F.count("*") / INTERVALS), F.lit(INTERVAL_BLOCKS)).cast("int").alias("_blocks"))
    rows = rows.join(blocks, keys).withColumn("_own", F.pmod(F.xxhash64("_a"), F.col("_blocks")).cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    x = rows.select(*keys, "_a", "_low", "_high", F.col("_own").alias("_i"), to.alias("_j"))
    y = rows.select(*keys, "_a", "_low", "_high", to.alias("_i"), F.col("_own").alias("_j"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [np.asarray(t[c]) for t in (right, left) for c in ("_a", "_low", "_high")]
        n, last = _overlap_counts(*columns)
        some = np.flatnonzero(n)
        return pa.table({**{k: left[k].take(some) for k in keys}, "a": pa.array(columns[3][some]), "n": pa.array(n[some]), "last": pa.array(last[some])})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "a long, n long, last long"])
    y = y.toDF(*y.columns)  # names of its own
    met = x.groupBy(*keys, "_i", "_j").cogroup(y.groupBy(*keys, "_i", "_j")).applyInArrow(run, schema)
    return met.groupBy(*keys, "a").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def majority(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value, the first seen of equals."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_first", value))
    return counts.withColumn("_r", best).filter("_r = 1").select(*keys, F.col(value).alias("majority"), "n")


def duplicate_groups(df: DataFrame, text: str, key: str, least: int = 8) -> DataFrame:
    """Groups of rows with the same normalised start of the text."""
    hashed = text_key(F.col(text), 120)
    rows = df.withColumn("content", hashed).filter(F.length("content") >= least)
    return rows.groupBy("content").agg(F.count("*").alias("n"), F.min(key).alias("first_id")).filter("n > 1")


def buckets(df: DataFrame, keys: list[str], value: Column, edges: list[tuple[float, float, str]]) -> DataFrame:
    """Counts in named ranges, both ends included."""
    named = reduce(lambda out, e: out.when((value >= e[0]) & (value <= e[1]), e[2]), edges, F.when(F.lit(False), F.lit("")))
    return df.withColumn("bucket", named).filter("bucket is not null").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def weighted_errors(df: DataFrame, key: str, kind: str, weights: dict[str, float]) -> DataFrame:
    """Counts of each kind of error, their weighted sum and the dominant kind."""
    counts = [F.sum((F.col(kind) == k).cast("long")).alias(k) for k in weights]
    out = df.groupBy(key).agg(*counts)
    score = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weights.items()])
    dominant = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(weights)]))["k"]
    return out.withColumn("score", score.cast("double")).withColumn("dominant", dominant)


def shares(df: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Counts, and their share of the whole or of a group, in per cent."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    return out.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(w), 4))


def personal_accuracy(df: DataFrame, keys: list[str], session: str, wrong: Column) -> DataFrame:
    """Sessions, mistakes, and the estimated accuracy of two items to a session."""
    out = df.groupBy(*keys).agg(F.countDistinct(session).alias("sessions"), F.sum(wrong.cast("long")).alias("mistakes"))
    estimate = F.col("sessions") * 2
    return out.withColumn("accuracy", F.round(F.greatest(F.lit(0), estimate - F.col("mistakes")) / estimate, 6))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (T5)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def confusion(predicted: DataFrame, actual: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Hits, false alarms, misses, precision, recall and F1 of two sets per key."""
    p, a = predicted.select(*keys, item).distinct().withColumn("_p", F.lit(1)), actual.select(*keys, item).distinct().withColumn("_a", F.lit(1))
    rows = p.join(a, [*keys, item], "full")
    out = rows.groupBy(*keys).agg(F.sum(F.when(F.col("_p").isNotNull() & F.col("_a").isNotNull(), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("_p").isNull(), 1).otherwise(0)).alias("fn"))
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return out.select(*keys, "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(2 * precision * recall / F.greatest(F.lit(0.001), precision + recall), 6).alias("f1"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last written row of each key (review decisions, IO16)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key doesn't exist yet, one per key (IO9, Z1)."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def neighbours_of(edges: DataFrame, node: str | int) -> DataFrame:
    """(neighbour, type, direction) of a node's edges either way."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("neighbour"), "type", F.lit("out").alias("direction"))
    return out.union(edges.filter(F.col("dst") == node).select(F.col("src").alias("neighbour"), "type", F.lit("in").alias("direction")))


def apportioned(df: DataFrame, keys: list[str], item: str, weight: str, seats: int) -> DataFrame:
    """Seats by largest remainder."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_q", F.col(weight) * F.lit(float(seats)) / F.sum(weight).over(w)).withColumn("_f", F.floor("_q"))
    left = F.lit(seats) - F.sum("_f").over(w)
    rows = rows.withColumn("_left", left).withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), item)))
    return rows.select(*keys, item, (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("long")).cast("long").alias("seats"))
