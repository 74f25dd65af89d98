"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, in DataFrame functions only.

Every paragraph is hashed to a wide vector: 64 bits of each of SEEDS hashes, every bit a lane, and two whole
64-bit hashes besides. A fingerprint is the sum of its paragraphs' vectors, so it doesn't depend on their
order, and adding (taking away) a paragraph's vector inserts (deletes) it. Sums are modulo powers of two: the
whole hashes add modulo 2^64; lanes are packed three to a 64-bit word, 20 bits each, so that one addition adds
three lanes (lanes hold up to 2^20 - 1 paragraphs; beyond that they carry into their neighbours, modulo 2^64,
and stay exact for equality, insertion and deletion but no longer measure likeness).

Paragraphs are what line breaks and sentence ends (., ! or ? before a space) leave, blank ones apart, so that
a text of one long line has several. Equal texts have equal fingerprints; so do texts with the same multiset of
paragraphs, up to the hashes' collisions.

Likeness. A lane with the paragraphs' number n and the sum b of its bit counts as 2b - n, the sum of a random
sign per paragraph. Over all lanes the products' mean of two texts estimates how many paragraphs they share;
likeness is that, relative to the texts' own (a cosine), cut to 0 to 1; 1 for equal fingerprints.

Null texts are empty ones; texts without paragraphs have the zero fingerprint, unlike any other text's (0)
and equal to each other (1). All rows and columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, cut, free_name, text_or_empty

SEEDS = 2
#: Bits apart, and number, of the lanes of a word.
WIDTH, PER_WORD = 20, 3
#: Words of lanes to a hash: shifted by 0 to WIDTH - 1, lanes 0, 20 and 40 of what is left.
SHIFTS = WIDTH
_MASK = sum(1 << (WIDTH * i) for i in range(PER_WORD))
#: Ranges of ids that texts are dealt to where each needs its neighbour: one to so many rows, and so many at least.
RANGE_ROWS, RANGES = 10_000, 256
#: Quantiles of ids at most that ranges lie between; more ranges cut the stretches between them in equal parts.
QUANTILES = 1024

_BREAKS = r"[\n\r\u000B\u000C\u0085  ]+|(?<=[.!?])\s+"


def paragraphs(text: Column) -> Column:
    """The text's paragraphs, blanks at the ends off, in order."""
    return F.filter(F.transform(F.split(text, _BREAKS), F.trim), lambda p: p != "")


def fingerprint(text: Column) -> Column:
    """array<bigint>: the number of paragraphs, two sums of whole hashes, then the words of lanes."""
    hashed = F.transform(paragraphs(text), lambda p: F.struct(*[F.xxhash64(p, F.lit(s)).alias(f"h{s}") for s in range(2)]))
    names = ["n", "a", "b"] + [f"w{s}_{i}" for s in range(SEEDS) for i in range(SHIFTS)]
    # additions wrap around: in the default ANSI mode + would raise on overflow, so sums are of 32-bit halves
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ["n", "a1", "a0", "b1", "b0"] + names[3:]])
    low = F.lit(0xFFFFFFFF).cast("long")

    def add(sums: Column, h: Column) -> Column:
        out = [(sums["n"] + 1).alias("n")]
        for c, s in (("a", "h0"), ("b", "h1")):
            out.append((sums[c + "1"] + F.shiftrightunsigned(h[s], 32)).alias(c + "1"))
            out.append((sums[c + "0"] + h[s].bitwiseAND(low)).alias(c + "0"))
        for s in range(SEEDS):
            for i in range(SHIFTS):
                out.append((sums[f"w{s}_{i}"] + F.shiftrightunsigned(h[f"h{s}"], i).bitwiseAND(F.lit(_MASK).cast("long"))).alias(f"w{s}_{i}"))
        return F.struct(*out)

    def finish(sums: Column) -> Column:
        # (high * 2^32 + low) modulo 2^64
        whole = [F.shiftleft(sums[c + "1"] + F.shiftright(sums[c + "0"], 32), 32).bitwiseOR(sums[c + "0"].bitwiseAND(low)) for c in "ab"]
        return F.array(sums["n"], *whole, *[sums[c] for c in names[3:]])

    return F.aggregate(hashed, zero, add, finish)


def _wrapped_sum(x: Column, y: Column, sign: int) -> Column:
    """x + y or x - y modulo 2^64."""
    low = F.lit(0xFFFFFFFF).cast("long")
    part0 = x.bitwiseAND(low) + sign * y.bitwiseAND(low)
    part1 = F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32) + F.shiftright(part0, 32)
    return F.shiftleft(part1, 32).bitwiseOR(part0.bitwiseAND(low))


def inserted(print_: Column, added: Column) -> Column:
    """Fingerprint of a text with the paragraphs of another fingerprint inserted."""
    return F.zip_with(print_, added, lambda x, y: _wrapped_sum(x, y, 1))


def deleted(print_: Column, removed: Column) -> Column:
    """Fingerprint of a text with the paragraphs of another fingerprint taken away."""
    return F.zip_with(print_, removed, lambda x, y: _wrapped_sum(x, y, -1))


def as_hex(print_: Column) -> Column:
    """16 hex digits a word."""
    return F.array_join(F.transform(print_, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def likeness(x: Column, y: Column) -> Column:
    """0 to 1, from two fingerprints."""
    lane = lambda v, i, n: F.shiftrightunsigned(v, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")) * 2 - n
    words = lambda v: F.slice(v, 4, SEEDS * SHIFTS)

    def product(p: Column, q: Column) -> Column:
        each = F.zip_with(words(p), words(q), lambda v, u: sum(((lane(v, i, p[0]) * lane(u, i, q[0])).cast("double") for i in range(1, PER_WORD)), (lane(v, 0, p[0]) * lane(u, 0, q[0])).cast("double")))
        return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(product(x, x) * product(y, y))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(x, y) / size))).otherwise(0.0)
    return F.when(x == y, 1.0).otherwise(cosine)


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the text's fingerprint as array<bigint>."""
    return docs.withColumn(out_col, fingerprint(text_or_empty(F.col(text_col).cast("string"))))


def with_next(docs: DataFrame, *, id_col: str, value_col: str, derived: dict[str, Column], prefix: str = "next_") -> DataFrame:
    """``docs`` with columns derived from the value, and value and derived columns of the next row.

    Next: ascending id, then value, nulls first; the first row follows the last. Rows are dealt to ranges of
    ids, whose number grows with the rows, and each range is sorted on its own, with a copy of the next range's first
    row at its end. Rows of equal id, and those of null id, are one range.
    """
    at, end, id_ = free_name(docs, "_range"), free_name(docs, "_end"), F.col(id_col)
    keyed = docs.withColumn(at, _range_of(docs, id_col))
    # ids of the ranges' first rows, and the range before each (a row per range): no text is sorted for them
    least = keyed.groupBy(at).agg(F.min(id_).alias("_id"))
    over = Window.orderBy(at)
    last = F.max(at).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    least = cut(least.select(F.col(at).alias("_at"), "_id", F.coalesce(F.lag(at).over(over), last).alias("_before")))
    small = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    starts = keyed.select(at, id_col, value_col).join(small, (F.col(at) == F.col("_at")) & id_.eqNullSafe(F.col("_id")))
    starts = starts.groupBy("_before", id_col).agg(F.min(F.struct(F.col(value_col).isNotNull().alias("k"), F.col(value_col).alias("v")))["v"].alias(value_col))
    starts = starts.select(*[F.col("_before").alias(at) if c == at else F.col(c) if c in (id_col, value_col) else F.lit(None).cast(t).alias(c) for c, t in keyed.dtypes], F.lit(True).alias(end))
    names = [value_col, *derived]
    window = Window.partitionBy(at).orderBy(end, id_.asc_nulls_first(), F.col(value_col).asc_nulls_first())
    rows = keyed.withColumn(end, F.lit(False)).union(starts).withColumns(derived)
    rows = rows.withColumns({f"{prefix}{c}": F.lead(c).over(window) for c in names})
    return rows.filter(~F.col(end)).drop(at, end)


def _range_of(docs: DataFrame, id_col: str) -> Column:
    """The number of the id's range; -1 for null."""
    value = F.col(id_col).cast("double")
    count, least, most = docs.agg(F.count("*"), F.min(value), F.max(value)).first()
    ranges = max(count // RANGE_ROWS, RANGES)
    quantiles = min(ranges, QUANTILES)
    bounds = docs.filter(F.col(id_col).isNotNull()).select(value.alias("v")).approxQuantile("v", [i / quantiles for i in range(1, quantiles)], 0.2 / quantiles)
    bounds = sorted(set(bounds))
    parts = -(-ranges // quantiles)
    place = _place(value, bounds)
    if parts > 1:
        edges = F.array(*map(F.lit, [least, *bounds, most]))
        low, high = F.element_at(edges, place + 1), F.element_at(edges, place + 2)
        share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
        place = place.cast("long") * parts + F.least(F.floor(share * parts), F.lit(parts - 1)).cast("long")
    return F.coalesce(place.cast("long"), F.lit(-1).cast("long"))


def _place(value: Column, bounds: list[float]) -> Column:
    """How many bounds are at most the value, by halving."""
    if not bounds:
        return F.when(value.isNotNull(), 0)

    def between(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(value < bounds[middle], between(a, middle)).otherwise(between(middle + 1, b))

    return F.when(value.isNotNull(), between(0, len(bounds)))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint): each text, and it edited.

    The edited text's last floor(n/2) code points are the first as many (or all) of the next document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col).cast("string")).alias("text"))
    rows = with_next(rows, id_col="doc_id", value_col="text", derived={"fingerprint": fingerprint(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next_fingerprint"))
    return rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
