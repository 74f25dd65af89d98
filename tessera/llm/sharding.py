"""Sharding by Karmarkar-Karp differencing: shards of near equal bytes, indivisible groups.

Groups are equal texts (null is one group, empty text another) and weigh the sum of their rows' sizes, a row's
size being its text's UTF-8 bytes plus one. Differencing takes the two partial partitions with the largest
spread and puts them together in opposite order, the heaviest shard of one on the lightest of the other, until one
is left. It runs over blocks of BLOCK groups or so, dealt by hash, and then over the partitions that these give, FAN
at a time, level by level: a partition of a level is just such a partial partition, so no task ever holds more than
BLOCK groups or FAN partitions, however many rows there are.

Slots number the rows of a shard from 0 without gaps: rows are counted by shard and salted part, parts start where
those before end, and each part of PART rows or so is ordered on its own (by hash of the id, then id, then text).

Laws: the result's law is "bytes". All rows stay; rows that repeat are rows of their own; an empty table gives an
empty result. Groups are told apart by SHA-256.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

BLOCK = 16_384
FAN = 1024
PART = 4096


def difference(parts: list[list[int]]) -> list[list[int]]:
    """For partial partitions (each a list of one weight per shard) the shard that each of their shards goes to.

    Returns for every part a list: shard i of the part -> shard of the whole.
    """
    shards = len(parts[0])
    # an entry: sums in ascending order, and for each of them the tree of (part, shard) leaves
    queue = []
    for p, weights in enumerate(parts):
        order = sorted(range(shards), key=lambda i: (weights[i], i))
        sums = [weights[i] for i in order]
        queue.append((sums[0] - sums[-1], p, sums, [(p, i) for i in order]))
    heapify(queue)
    while len(queue) > 1:
        _, p, a, left = heappop(queue)
        _, _, b, right = heappop(queue)
        joined = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b)))))
        trees = [[left[i], right[shards - 1 - i]] for _, i in joined]
        sums = [s for s, _ in joined]
        heappush(queue, (sums[0] - sums[-1], p, sums, trees))
    out = [[0] * shards for _ in parts]
    # the heaviest shard gets number 0
    for shard, tree in enumerate(reversed(queue[0][3])):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out[node[0]][node[1]] = shard
            else:
                stack += node
    return out


def _groups(key, table):
    table = table.sort_by([("weight", "descending"), ("group", "ascending")])  # rows arrive in any order
    weights = table.column("weight").to_pylist()
    shards = table.column("shards")[0].as_py()
    # groups are partitions with all their weight in their first shard; heavier first keeps ties stable
    to = difference([[x] + [0] * (shards - 1) for x in weights])
    return pa.table({"group": table.column("group"), "weight": table.column("weight"), "block": table.column("block"), "own": pa.array([t[0] for t in to], pa.int64())})


def _partitions(key, table):
    table = table.sort_by("block")
    weights = table.column("weights").to_pylist()
    to = difference(weights)
    total = np.zeros(len(weights[0]), dtype=object)
    for w, t in zip(weights, to):
        for i, s in enumerate(t):
            total[s] += w[i]
    return pa.table({"block": table.column("block"), "to": pa.array(to, pa.list_(pa.int64())), "above": table.column("above"), "total": pa.array([total.tolist()] * len(weights), pa.list_(pa.int64()))})


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """(group, weight) with distinct groups -> (group, shard)."""
    n = groups.count()
    blocks = max(1, -(-n // BLOCK))
    found = groups.select("group", F.col("weight").cast("long"), F.pmod(F.xxhash64("group"), F.lit(blocks)).alias("block"), F.lit(shards).alias("shards"))
    found = cut(found.groupBy("block").applyInArrow(_groups, "group string, weight long, block long, own long"))
    sums = found.groupBy("block", "own").agg(F.sum("weight").alias("s"))
    pairs = sums.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("own", "s"))).alias("m"))
    whole = pairs.select("block", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("weights"))
    found = found.select("group", "block", "own")
    while True:
        above = max(1, -(-blocks // FAN))
        level = whole.withColumn("above", F.pmod(F.col("block"), F.lit(above)))
        level = cut(level.groupBy("above").applyInArrow(_partitions, "block long, to array<long>, above long, total array<long>"))
        step = level.select(F.col("block").alias("_b"), "to", "above")
        # FAN * above rows of one array of a number per shard, the groups' blocks: a shuffle join if large
        found = found.join(step, F.col("block") == F.col("_b")).select("group", F.col("above").alias("block"), F.col("to")[F.col("own").cast("int")].alias("own"))
        if above == 1:
            return found.select("group", F.col("own").cast("int").alias("shard"))
        whole = level.groupBy("above").agg(F.first("total").alias("weights")).withColumnRenamed("above", "block")
        blocks = above


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("group"),
    )
    rows = cut(rows)
    to = cut(assign(rows.groupBy("group").agg(F.sum("size").alias("weight")), shards))
    rows = rows.join(to, "group").withColumn("_h", F.xxhash64("doc_id"))
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    rows = rows.join(F.broadcast(sizes), "shard").withColumn("_part", F.pmod(F.xxhash64("doc_id", "group"), F.col("_parts"))).drop("_parts")
    rows = cut(rows)
    parts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_part").orderBy("_h", "doc_id", "group")
    rows = rows.join(parts, ["shard", "_part"])
    slot = (F.col("_start") + F.row_number().over(order) - 1).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
