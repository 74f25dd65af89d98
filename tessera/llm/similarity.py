"""N-gram Jaccard join: documents whose sets of k-word shingles overlap by a least share, and their components.

Method. Sets of one size band meet in tiles; each set carries a parity bitmap of its hashed shingles, so that
counting the bits in which two bitmaps differ bounds their overlap from above; only pairs which that bound admits
are intersected, exactly, as sorted arrays.

What keeps this linear, without losing a link between different sets:
- Equal sets are one class (a 64-bit id of size and members), so copies never meet.
- A tile is a key that sets share, and a size band. In any fixed order of shingles two sets that are similar enough
  share a shingle among the first n - ceil(t n) + 1 of each, which is even among the first
  n - ceil(2 t n / (1 + t)) + 1 of the smaller; those are the keys, and the join is exact because of them. The order
  puts shingles that are frequent in the corpus last, so lines and passages that many documents share don't make
  tiles. (Any order is right; which shingles count as frequent only changes the work.)
- Bitmaps have 1,024 bits, or 4,096 for large sets: what a tile's row weighs doesn't grow with its set.
- Small blocks of a tile give all pairs that size, place and bitmaps admit. Large ones are worked through in turn,
  only pairs of different components so far being tried: what comes out is a forest of likely links. These are
  intersected, components contracted by the true links, and the tiles which still hold a pair of different components
  go on; the last pass gives all admitted pairs of different components, which are few by then.
- A tile of many rows is first cut into blocks, each row in one. What is then still apart from the tile's largest
  component meets all its rows, in pairs of blocks; rows of the largest component never meet each other again. So a
  group of near copies is dealt in proportion to its rows, and only sets apart from it are dealt more often.
- Near copies mostly share pairs of min-hashes; the first tiles are of these. This only saves work.

Results: one row per input row. Rows without words (null or empty text too) are in no link. Rows that are
equal, or have the same id, each get a row. Component ids are the least non-null id of the component; null
if all its ids are null. Columns of the input other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import BROADCAST_ROWS, cut, free_name, keep_ids, small_batches, trimmed
from tessera.llm.components import components

#: Min-hash pairs of a set.
KEYS = 4
#: Shingles that are ordered last: those found most often, up to so many (1 MB to each worker).
FREQUENT = 1 << 17
#: A shingle found so often at least may be frequent.
OFTEN = 32
#: Rows of a tile that meet in one block; larger tiles are dealt out in pairs of blocks.
BLOCK = 1024
#: Blocks of up to so many rows give all their admitted pairs at once.
SMALL = 8
#: Sets that a task remembers, so as not to repeat copies; beyond it forgets and starts anew.
SEEN = 1 << 20
#: Bytes of sets that are held for one Arrow batch.
HELD_BYTES = 1 << 22
#: Shingles or tile rows that a task holds before it gives them on.
HELD_ROWS = 250_000
#: Bits of the bitmaps of sets up to so many members, and of larger ones.
NARROW, WIDE = 1024, 4096


def least_common(a: int, b: int, num: int, den: int) -> int:
    """Least intersection of sets of sizes a and b with den * |A & B| >= num * |A | B|."""
    return -(-num * (a + b) // (num + den))


def width(n: int) -> int:
    """Bits of the bitmap of a set of n members."""
    return NARROW if n <= NARROW else WIDE


def _profiles(docs: DataFrame, k: int, low: float) -> DataFrame:
    """A row per document: (doc_id, n, sid, keys, bits); and rows (sid=shingle, n=-times) of shingles met often."""
    bound = np.uint64(min(1.0, low) * float(1 << 63) * 1.999)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        found, times = found[times > 2], times[times > 2]
        none = pa.nulls(len(found))
        return pa.record_batch([none.cast(pa.int64()), pa.array(-times), pa.array(found.view(np.int64)), none.cast(pa.list_(pa.int64())), none.cast(pa.binary())], names)

    names = ["doc_id", "n", "sid", "keys", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            n, sid, keys, bits = [], [], [], []
            for s in w.shingle_sets(batch.column(1), k):
                n.append(len(s))
                if len(s):
                    sid.append(w.set_id(s))
                    keys.append(w.min_keys(s, KEYS))
                    bits.append(w.bitmap(s, width(len(s))))
                    held.append(s[: np.searchsorted(s, bound)].copy())
                    count += len(held[-1])
                else:
                    sid.append(None)
                    keys.append(None)
                    bits.append(None)
                if count > HELD_ROWS:
                    yield flush(held)
                    held, count = [], 0
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names)
        yield flush(held)

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, sid long, keys array<long>, bits binary")


def _members(docs: DataFrame, ids: DataFrame, n: int, k: int) -> DataFrame:
    """(sid, members) of the documents of the n distinct ``ids``, and of those without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, members, held = [], [], 0
            for s in w.shingle_sets(batch.column(0), k):
                if len(s):
                    sid.append(w.set_id(s))
                    members.append(s.tobytes())
                    held += s.nbytes
                if held > HELD_BYTES:
                    yield pa.record_batch([pa.array(sid, pa.int64()), pa.array(members, pa.binary())], ["sid", "members"])
                    sid, members, held = [], [], 0
            yield pa.record_batch([pa.array(sid, pa.int64()), pa.array(members, pa.binary())], ["sid", "members"])

    rows = keep_ids(docs, ids, "doc_id", n).union(docs.filter("doc_id is null")).select("text")
    return rows.mapInArrow(trimmed(run), "sid long, members binary")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links (a, b) among the pairs (a, b, da, db) of sets and of documents that have them, by exact intersection."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(w.overlap(x, y) >= least_common(len(x), len(y), num, den))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = cut(pairs.select(F.explode(F.array("da", "db")).alias("doc_id")).filter("doc_id is not null").distinct())
    members = cut(_members(docs, ids, ids.count(), k))
    # documents of one id may have different texts, and documents of one text no id: a pair may come several times
    side = lambda c: members.select(F.col("sid").alias(c), F.col("members").alias("m" + c))
    found = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb")
    return cut(found.mapInArrow(trimmed(exact), "a long, b long"))


def _prefixes(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(tile, part, sid, n, early): the first n - ceil(t n) + 1 shingles of each set, frequent ones last.

    A pair of similar sets shares one that is ``early`` in the smaller set: among its first n - ceil(2 t n / (1 + t)) + 1.
    Frequent shingles are dealt to parts. A set that a task has seen already isn't repeated.
    """
    names = ["tile", "part", "sid", "n", "early"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out, part, owner, size, count, early, held = [], [], [], [], [], [], 0

            def rows() -> pa.RecordBatch:
                own = np.repeat(np.array(owner, np.int64), size)
                hot = np.concatenate(part) if part else np.zeros(0, np.int64)
                tile = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
                return pa.record_batch([pa.array(tile), pa.array(np.where(hot, (own >> 7) & 63, -1)), pa.array(own), pa.array(np.repeat(np.array(count, np.int64), size)), pa.array(np.concatenate(early) if early else np.zeros(0, bool))], names)  # noqa: B023

            for s in w.shingle_sets(batch.column(1), k):
                sid = w.set_id(s) if len(s) else None
                if sid is None or sid in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                n = len(s)
                most = n + (-num * n // den) + 1
                known = np.zeros(n, bool)
                if len(frequent):
                    at = np.searchsorted(frequent, s)
                    at[at == len(frequent)] = 0
                    known = frequent[at] == s
                head = s[~known][:most]
                rare = len(head)
                if rare < most:
                    head = np.concatenate([head, s[known][: most - rare]])
                out.append(head)
                part.append(np.arange(most) >= rare)
                owner.append(sid)
                size.append(most)
                count.append(n)
                early.append(np.arange(most) < n - least_common(n, n, num, den) + 1)
                held += most
                if held > HELD_ROWS:
                    yield rows()
                    out, part, owner, size, count, early, held = [], [], [], [], [], [], 0
            if out:
                yield rows()

    return docs.mapInArrow(trimmed(run), "tile long, part long, sid long, n long, early boolean")


def _met(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(tile, sid, n, early) of shingle tiles: rows which size and place in the set leave a partner in their tile."""
    names = ["tile", "sid", "n", "early"]

    def done(held: list[pa.RecordBatch], whole: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        tile, sid, n, early, part = (t.column(c).to_numpy() for c in ("tile", "sid", "n", "early", "part"))
        fresh = np.ones(len(tile), bool)
        fresh[1:] = (tile[1:] != tile[:-1]) | (sid[1:] != sid[:-1])
        tile, sid, n, early, part = tile[fresh], sid[fresh], n[fresh], early[fresh], part[fresh]
        if whole and len(tile):
            # an early row has a partner if the next row is near in size, any row if the last early row before it is
            change = np.concatenate([[True], tile[1:] != tile[:-1]])
            first = np.maximum.accumulate(np.where(change, np.arange(len(tile)), 0))
            near_next = np.concatenate([~change[1:] & (num * n[1:] <= den * n[:-1]), [False]])
            last = np.maximum.accumulate(np.where(early, np.arange(len(tile)), -1))
            last = np.concatenate([[-1], last[:-1]])
            near_last = (last >= first) & (num * n <= den * n[np.maximum(last, 0)])
            keep = (early & near_next) | near_last | (part >= 0)
            tile, sid, n, early = tile[keep], sid[keep], n[keep], early[keep]
        return pa.record_batch([pa.array(tile), pa.array(sid), pa.array(n), pa.array(early)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, whole = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            change = np.flatnonzero(tile[1:] != tile[:-1]) + 1
            if now != int(tile[0]):
                if held:
                    yield done(held, whole)
                held, whole = [], True
            elif len(change) and not whole:
                yield done([*held, batch.slice(0, int(change[0]))], False)
                batch, change = batch.slice(int(change[0])), change[1:] - change[0]
                held, whole = [], True
            now = int(tile[-1])
            if len(change):
                yield done([*held, batch.slice(0, int(change[-1]))], True)
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
                if sum(b.num_rows for b in held) > HELD_ROWS:  # of so large a tile all rows stay
                    yield done(held, False)
                    held, whole = [], False
        if held:
            yield done(held, whole)

    keyed = _prefixes(docs, k, num, den, frequent).repartition("tile", "part").sortWithinPartitions("tile", "n", "sid")
    return keyed.mapInArrow(trimmed(run), "tile long, sid long, n long, early boolean")


_TILE = ["tile", "band", "x", "y"]


def _bitmaps(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bitmaps folded to the narrow width, the wide ones, and each row's place among these (-1: none)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    wide = np.diff(offsets) > NARROW // 8

    def rows(of: np.ndarray, bits: int) -> np.ndarray:
        chosen = column.filter(pa.array(of))
        return np.frombuffer(b"" if not len(chosen) else chosen.buffers()[2], np.uint64, len(chosen) * bits // 64).reshape(-1, bits // 64)

    large = rows(wide, WIDE)
    narrow = np.empty((len(column), NARROW // 64), np.uint64)
    narrow[~wide] = rows(~wide, NARROW)
    narrow[wide] = np.bitwise_xor.reduce(large.reshape(-1, WIDE // NARROW, NARROW // 64), 1)
    return narrow, large, np.where(wide, np.cumsum(wide) - 1, -1)


def _fits(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: tuple[np.ndarray, np.ndarray, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (i, j) size and bitmaps admit, and in how many bits each of these differs."""
    narrow, large, at = bits
    both = n[i] + n[j]
    least = -(-num * both // (num + den))
    apart = np.bitwise_count(narrow[i] ^ narrow[j]).sum(1, dtype=np.int64)
    ok = np.flatnonzero((num * np.maximum(n[i], n[j]) <= den * np.minimum(n[i], n[j])) & ((both - apart) // 2 >= least))
    more = ok[(at[i[ok]] >= 0) & (at[j[ok]] >= 0)]
    if len(more):
        apart[more] = np.bitwise_count(large[at[i[more]]] ^ large[at[j[more]]]).sum(1, dtype=np.int64)
        ok = ok[(both[ok] - apart[ok]) // 2 >= least[ok]]
    return ok, apart[ok]


def _forest(rows: dict, bits: tuple, num: int, den: int, most: int) -> tuple[list, list, np.ndarray]:
    """Pairs of places in one large block, in order of size: see the module; ``most`` for each set and component, 0: all.

    Then a place of each component as it would be if all pairs were links.
    """
    n, own, early, side, sid = rows["n"], rows["own"], rows["early"], rows["side"], rows["sid"]
    _, root = np.unique(rows["label"], return_inverse=True)
    a, b = [], []
    for i in range(len(n) - 1):
        if not early[i]:
            continue
        last = int(np.searchsorted(n, den * n[i] // num, "right"))
        apart = root[i + 1 : last] != root[i]
        if side[i]:
            apart &= (side[i + 1 : last] != side[i]) & (sid[i + 1 : last] != sid[i])
        at = i + 1 + np.flatnonzero(apart if own[i] else apart & own[i + 1 : last])
        if not len(at):
            continue
        ok, apart = _fits(np.full(len(at), i), at, n, bits, num, den)
        if not len(ok):
            continue
        at = at[ok][np.argsort(apart, kind="stable")]
        if most:
            roots, first = np.unique(root[at], return_index=True)
            chosen = at[first] if most == 1 else np.concatenate([at[root[at] == r][:most] for r in roots.tolist()])
            root[np.isin(root, roots)] = root[i]
        else:
            chosen = at
        a += [i] * len(chosen)
        b += chosen.tolist()
    return a, b, np.unique(root, return_index=True)[1]


def _tile_pairs(tiles: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """(tile, a, b, da, db): each block's pairs (a < b); the tile is null if the block's pairs are all there.

    tiles: (tile, band, x, y, sid, label, n, early, own, side, more, doc_id, bits). A pair of two rows of the band above is
    left to that band; of a block with sides (1 and 2), only pairs across are tried. A block with ``more`` beside it
    gives its components too, each by a pair of one set with itself.
    """
    names = ["tile", "a", "b", "da", "db"]

    def rows(tile: pa.Array, i: np.ndarray, j: np.ndarray, sid: np.ndarray, doc: pa.ChunkedArray) -> pa.RecordBatch:
        i, j = np.where(sid[i] < sid[j], i, j), np.where(sid[i] < sid[j], j, i)
        ends = [pa.concat_arrays(doc.take(pa.array(at)).chunks) if len(at) else pa.array([], pa.int64()) for at in (i, j)]
        return pa.record_batch([tile, pa.array(sid[i]), pa.array(sid[j]), *ends], names)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        key = np.stack([t.column(c).to_numpy() for c in _TILE])
        sid, label, n, early, own, side, more = (t.column(c).to_numpy() for c in ("sid", "label", "n", "early", "own", "side", "more"))
        starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(n)]]))
        bits = _bitmaps(t.column("bits"))
        beside = np.flatnonzero(np.repeat(more[starts] & (sizes <= SMALL), sizes))
        if len(beside):
            yield rows(pa.array(key[0, beside]), beside, beside, sid, t.column("doc_id"))
        left, right = [], []
        for size in range(2, SMALL + 1):
            p, q = np.triu_indices(size, 1)
            of = starts[sizes == size][:, None]
            left.append((of + p).ravel())
            right.append((of + q).ravel())
        i, j = np.concatenate(left), np.concatenate(right)
        some = np.flatnonzero((label[i] != label[j]) & early[i] & (own[i] | own[j]) & (sid[i] != sid[j]) & ((side[i] != side[j]) | (side[i] == 0)))
        i, j = i[some], j[some]
        ok, _ = _fits(i, j, n, bits, num, den)
        if len(ok):
            i, j = i[ok], j[ok]
            _, once = np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])]), axis=1, return_index=True)
            yield rows(pa.nulls(len(once), pa.int64()), i[once], j[once], sid, t.column("doc_id"))
        for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            part = slice(at, at + size)
            narrow, large, place = bits
            rows_of = {"n": n[part], "own": own[part], "early": early[part], "label": label[part], "side": side[part], "sid": sid[part]}
            i, j, alone = _forest(rows_of, (narrow[part], large, place[part]), num, den, most)
            if more[at]:
                i, j = [*i, *alone], [*j, *alone]
            if i:
                yield rows(pa.array(np.full(len(i), key[0, at])), at + np.array(i), at + np.array(j), sid, t.column("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # everything up to the last change of key is whole; the rest waits for the next batch
            key = np.stack([batch.column(c).to_numpy() for c in _TILE])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in _TILE] != key[:, 0].tolist():
                yield from done(held)
                held = []
            if len(change):
                yield from done([*held, batch.slice(0, int(change[-1]))])
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
        if held:
            yield from done(held)

    keyed = tiles.repartition(*_TILE).sortWithinPartitions(*_TILE, "n", "sid")
    return keyed.mapInArrow(trimmed(run), "tile long, a long, b long, da long, db long")


def _dealt(rows: DataFrame, num: int, den: int, way: str, banded: bool) -> DataFrame:
    """Rows (tile, sid, label, n, early) dealt to size bands of their tile, and blocks (x, y) of these.

    Similar sets are in one band or in neighbouring ones: each is dealt to its own (own) and to the one below. Bands
    whose rows are all of one component have nothing to say and go. A band of one block is dealt as it is. Of larger ones
    ``way`` "diagonal" brings each row to one block, and ``more`` says that there are others; "rest" sets the rows that
    aren't of the band's largest component (side 2, in blocks y) against all rows (side 1, in blocks x), so that what is
    dealt grows with the rows times the blocks of those still apart; "all" pairs all blocks, where all links are asked for.
    """
    if banded:
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("long")
        rows = rows.withColumn("_b", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))))
        rows = rows.select("tile", "_b.band", "_b.own", "sid", "label", "n", "early")
    else:
        rows = rows.select("tile", F.lit(0).cast("long").alias("band"), F.lit(True).alias("own"), "sid", "label", "n", "early")
    several = rows.groupBy("tile", "band").agg(F.min("label").alias("_a"), F.max("label").alias("_z"), F.count("*").alias("rows"), F.max("own").alias("_own"), F.max("early").alias("_early"))
    # cut, so that both sides of the join are shuffled and a hot tile's partition can be split
    several = cut(several.filter("_a < _z and _own and _early").select("tile", "band", F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int").alias("_x")))
    rows = rows.join(several, ["tile", "band"])
    # other blocks in each tile, so that sets which one tile's blocks keep apart meet in another's
    mine = F.pmod(F.xxhash64("sid", "tile"), F.col("_x")).cast("int")
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    at = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    kept = ["tile", "band", "sid", "label", "n", "early", "own"]
    one = F.array(at(F.lit(0), F.lit(0), 0))
    more = F.lit(False)
    if way == "diagonal":
        places, more = F.array(at(mine, mine, 0)), F.col("_x") > 1
    elif way == "all":
        places = F.transform(up_to("_x"), lambda o: at(F.least(mine, o), F.greatest(mine, o), 0))
    else:
        large = several.filter("_x > 1")
        each = rows.join(large.select("tile", "band"), ["tile", "band"], "left_semi").groupBy("tile", "band", "label").count()
        main = each.groupBy("tile", "band").agg(F.max(F.struct("count", "label")).alias("_m"), F.sum("count").alias("_rows"))
        main = cut(main.select("tile", "band", F.col("_m")["label"].alias("_main"), F.ceil((F.col("_rows") - F.col("_m")["count"]) / BLOCK).cast("int").alias("_y")))
        rows = rows.join(main, ["tile", "band"], "left")
        across = F.transform(up_to("_y"), lambda y: at(mine, y, 1))
        own_y = F.pmod(F.xxhash64("sid", "tile", F.lit(1)), F.col("_y")).cast("int")
        others = F.when(F.col("label") != F.col("_main"), F.transform(up_to("_x"), lambda x: at(x, own_y, 2))).otherwise(F.filter(across, lambda _: F.lit(False)))
        places = F.when(F.col("_x") > 1, F.concat(across, others)).otherwise(one)
    rows = rows.withColumn("_at", F.explode(places)).withColumn("more", more)
    return rows.select(*kept, "_at.x", "_at.y", "_at.side", "more")


def _small(df: DataFrame, n: int) -> DataFrame:
    """``df`` of n rows of two numbers: broadcast if it is small enough."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Passes over tiles: the way they are dealt, and the pairs of a set and a component that one returns (0: all).
FIRST = (("diagonal", 1),)
WHOLE = (("diagonal", 1), ("rest", 16), ("rest", 0))
EVERY = (("all", 0),)


def _linked(met: DataFrame, moved: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, passes: tuple[tuple[str, int], ...], banded: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """Links found in the tiles of ``met`` (tile, sid, n, early), and ``moved`` with what follows from them.

    moved: (sid, label) of the sets in a component of several. Tiles with a pair whose components are still apart, and
    those of several blocks that aren't of one component, go on to the next pass.
    """
    known = classes.select("sid", "doc_id", "bits")
    links, active, n = None, met, moved.count()
    for at, (way, most) in enumerate(passes):
        rows = active.join(_small(moved, n), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        rows = _dealt(rows, num, den, way, banded).join(known, "sid").select(*_TILE, "sid", "label", "n", "early", "own", "side", "more", "doc_id", "bits")
        pairs = cut(_tile_pairs(rows, num, den, most))
        if pairs.isEmpty():
            break
        each = cut(pairs.filter("a <> b").groupBy("a", "b").agg(F.min("da").alias("da"), F.min("db").alias("db")))
        found = _verified(docs, each, k, num, den)
        links = found if links is None else links.union(found)
        if way == "all":
            break
        moved = components(moved.select(F.col("sid").alias("a"), F.col("label").alias("b")).union(found)).select(F.col("node").alias("sid"), "label")
        n = moved.count()
        if at + 1 == len(passes):
            break
        end = lambda c: _small(moved.select(F.col("sid").alias(c), F.col("label").alias("l" + c)), n)  # noqa: B023, E731
        still = pairs.filter("tile is not null").join(end("a"), "a", "left").join(end("b"), "b", "left")
        still = still.select("tile", F.col("a") == F.col("b"), F.coalesce("la", "a"), F.coalesce("lb", "b")).toDF("tile", "wide", "la", "lb")
        # in a tile of one block only pairs can be apart; the blocks of a larger one may be
        still = still.groupBy("tile").agg(F.max("wide").alias("wide"), F.max(F.col("la") != F.col("lb")).alias("apart"), F.min(F.least("la", "lb")).alias("_a"), F.max(F.greatest("la", "lb")).alias("_z"))
        still = cut(still.filter("apart or (wide and _a < _z)").select("tile"))
        tiles = still.count()
        if not tiles:
            break
        active = cut(active.join(_small(still, tiles), "tile", "left_semi"))
    return links, moved


def _classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rows (doc_id, n_shingles, sid), distinct sets (sid, doc_id, n, bits, keys) and the frequent shingles."""
    share = num / den
    found = cut(_profiles(docs, k, 1.6 * (1 - share) + 0.05))
    rows = found.filter("n >= 0").select("doc_id", F.col("n").alias("n_shingles"), "sid")
    classes = cut(found.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys")))
    often = found.filter("n < 0").groupBy("sid").agg(F.sum(-F.col("n")).alias("times")).filter(F.col("times") >= OFTEN)
    often = often.orderBy(F.desc("times"), "sid").limit(FREQUENT).select("sid").toPandas()["sid"].to_numpy(np.int64)
    frequent = np.sort(often.view(np.uint64))
    return rows, classes, frequent


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _none(df: DataFrame, names: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], names)


def _components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, label) for each row of docs (doc_id, text); the label tells components apart."""
    rows, classes, frequent = _classes(docs, k, num, den)

    # near copies: tiles of min-hash pairs
    keyed = classes.select(F.explode("keys").alias("tile"), "sid", "n", F.lit(True).alias("early"))
    _, moved = _linked(keyed, _none(docs, "sid long, label long"), docs, classes, k, num, den, FIRST)

    # tiles of shingles, of what is still apart
    _, moved = _linked(cut(_met(docs, k, num, den, frequent)), moved, docs, classes, k, num, den, WHOLE)
    return _named(rows, classes, moved)


def _named(rows: DataFrame, classes: DataFrame, moved: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, label) of each of ``rows``, given the sets' components ``moved`` (sid, label)."""
    n = moved.count()
    least = classes.select("sid", "doc_id").join(_small(moved, n), "sid").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    moved = cut(moved.join(least, "label").select("sid", "label", "component_id"))
    named = classes.select("sid", "doc_id").join(_small(moved, n), "sid", "left")
    named = named.select("sid", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("label", "sid").alias("label"))
    out = rows.filter("sid is not null").join(named, "sid").select("doc_id", "n_shingles", "component_id", F.col("sid").alias("set_id"), "label")
    alone = rows.filter("sid is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "sid", F.lit(None).cast("long"))
    return out.union(alone)


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id) for each row: documents linked when den*|A & B| >= num*|A | B|.

    set_id tells the distinct sets apart (null for texts without words). See the module for the method and
    for null, empty, long and repeated rows.
    """
    return _components(_texts(docs, id_col, text_col), k, num, den).drop("label")


def ngram_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links of different sets (a < b, by set_id), and the membership (doc_id, n_shingles, set_id) of each row.

    Every pair of sets that meets in a shingle tile is tried; none is left out for being in one component already, so
    links grow with the square of a group of near copies, as their number does. Rows of one set are linked to each
    other and have all of its links; copies stay one set and add none. set_id is null for texts without words.
    """
    docs = _texts(docs, id_col, text_col)
    rows, classes, frequent = _classes(docs, k, num, den)
    links, _ = _linked(cut(_met(docs, k, num, den, frequent)), _none(docs, "sid long, label long"), docs, classes, k, num, den, EVERY)
    links = _none(docs, "a long, b long") if links is None else links.distinct()
    return links, rows.withColumnRenamed("sid", "set_id")


def link_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, n_links) for each row: the number of other rows that it is linked to, copies included."""
    links, rows = ngram_links(docs, id_col=id_col, text_col=text_col, k=k, num=num, den=den)
    copies = cut(rows.filter("set_id is not null").groupBy("set_id").agg(F.count("*").alias("_copies")))
    ways = links.union(links.select("b", "a")).join(copies.select(F.col("set_id").alias("b"), "_copies"), "b")
    near = ways.groupBy(F.col("a").alias("set_id")).agg(F.sum("_copies").alias("_near"))
    counts = copies.join(near, "set_id", "left").select("set_id", (F.col("_copies") - 1 + F.coalesce("_near", F.lit(0))).alias("n_links"))
    return rows.join(counts, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _set_ids(text: Column, k: int) -> Column:
    """The set_id of each text."""

    @F.arrow_udf("long")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([w.set_id(s) if len(s) else None for s in w.shingle_sets(column, k)], pa.int64())

    return found(text.cast("string"))


def near_duplicates_removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, that of the least id; all columns are kept.

    Rows with the same id and text are one document. Where rows of different texts share an id, the texts decide which
    of them stays. Rows of null id stay only where no member of their component has an id, one of each component.
    """
    found = cut(_components(_texts(docs, id_col, text_col), k, num, den))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    twice = cut(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    mark, sid = free_name(docs, "_kept"), free_name(docs, "_set")
    key = F.col(id_col).cast("long")

    # ids that occur once decide by themselves
    once = found.filter(own & F.col("doc_id").isNotNull()).join(twice, "doc_id", "left_anti").select(F.col("doc_id").alias(mark))
    once = cut(once)
    n = once.count()
    kept = docs.join(F.broadcast(once) if n <= BROADCAST_ROWS else once, key == F.col(mark), "left_semi")

    # the others by their text as well
    odd = docs.filter(key.isNull())
    if not twice.isEmpty():
        odd = odd.union(docs.join(twice.select(F.col("doc_id").alias(mark)), key == F.col(mark), "left_semi"))
    if odd.isEmpty():
        return kept
    # of a component one set stays for an id, the least; texts without words are no component
    sets = found.filter(own).join(twice, "doc_id", "left_semi").union(found.filter("doc_id is null and component_id is null"))
    with_words = sets.filter("set_id is not null").groupBy("doc_id", "label").agg(F.min("set_id").alias(sid)).select(F.col("doc_id").alias(mark), sid)
    without = sets.filter("set_id is null").select(F.col("doc_id").alias(mark), F.col("set_id").alias(sid)).distinct()
    chosen = cut(with_words.union(without))
    name = free_name(docs, "_of")
    odd = odd.withColumn(name, _set_ids(F.col(text_col), k)).alias("l")
    same = key.eqNullSafe(F.col(f"r.{mark}")) & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{sid}"))
    odd = odd.join(chosen.alias("r"), same, "left_semi")
    worded = odd.filter(F.col(name).isNotNull()).dropDuplicates([id_col, name]).drop(name)
    return kept.union(worded).union(odd.filter(F.col(name).isNull()).drop(name).dropDuplicates([id_col, text_col]))
