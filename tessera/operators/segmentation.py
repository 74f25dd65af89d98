"""Text to rows: lines, markers, sections, questions and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(pages: DataFrame, keys: list[str], text: str, noise: str | None = None) -> DataFrame:
    """A row per line, numbered from 0; lines that match the noise pattern and blank ones go (G1)."""
    rows = pages.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    return rows if noise is None else rows.filter(~F.col("line").rlike(noise))


def segments(rows: DataFrame, keys: list[str], boundary: Column, line: str = "line", order: str = "line_no") -> DataFrame:
    """Lines gathered between boundaries; those before the first go."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("segment", F.sum(boundary.cast("int")).over(w)).filter("segment > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return numbered.groupBy(*keys, "segment").agg(F.count("*").alias("n_lines"), F.min(order).alias("first_line"), joined.alias("text"))


def numbered_items(rows: DataFrame, keys: list[str], pattern: str, most: int, line: str = "line", order: str = "line_no") -> DataFrame:
    """Boundaries by item number, the first line of each number, between 1 and most."""
    n = F.regexp_extract(line, pattern, 1)
    found = rows.withColumn("number", F.when(n != "", n.cast("int"))).filter(F.col("number").between(1, most))
    return found.groupBy(*keys, "number").agg(F.min(order).alias("first_line"))


def split_items(pages: DataFrame, keys: list[str], text: str, marker: str) -> DataFrame:
    """The text cut before each marker."""
    parts = F.split(text, f"(?={marker})")
    return pages.select(*keys, F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("pos", "item"))


#: A choice's label at the start of a line, and circled numerals anywhere (fixed values).
LABELLED = r"(?m)^\s*([0-9]{1,2}|[A-Z])[.)]\s+(.*)$"
CIRCLED_CHOICE = "([①②③④⑤⑥⑦⑧⑨⑩])\\s*([^①②③④⑤⑥⑦⑧⑨⑩\\n]*)"


def choices(items: DataFrame, keys: list[str], text: str, pattern: str = LABELLED, least: int = 3) -> DataFrame:
    """Labelled choices of an item: circled numerals if there are enough, else labels that follow each other from the first."""
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("choice"))
    place = lambda x: F.when(x["label"].rlike("^[0-9]+$"), x["label"].cast("int")).otherwise(F.ascii(x["label"]) - 64)
    circled, labelled = pairs(CIRCLED_CHOICE), pairs(pattern)
    follow = F.filter(labelled, lambda x, i: place(x) == place(F.element_at(labelled, 1)) + i)
    chosen = F.when(F.size(circled) >= least, circled).otherwise(follow)
    rows = items.withColumn("_c", chosen).filter(F.size("_c") >= least)
    return rows.select(*keys, F.posexplode("_c").alias("ordinal", "_x")).select(*keys, "ordinal", "_x.label", F.trim("_x.choice").alias("choice"))


def merged_fragments(items: DataFrame, keys: list[str], order: str, text: str, least: int) -> DataFrame:
    """Items shorter than so many characters join the item before, which has grown by then: an ordered fold per page."""
    gathered = items.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("_all"))
    empty = F.array().cast("array<string>")

    def step(done: Column, t: Column) -> Column:
        join = (F.size(done) > 0) & (F.length(t) < least)
        last = F.concat(F.element_at(done, -1), F.lit("\n"), t)
        return F.when(join, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last))).otherwise(F.concat(done, F.array(t)))

    return gathered.select(*keys, F.posexplode(F.aggregate("_all", empty, step)).alias("pos", "item"))


def segmentation_confidence(items: DataFrame, keys: list[str], text: str, short: int = 20) -> DataFrame:
    """Mean of min(1, length / 100), 0.8 of it if over 30 % of the items are fragments, cut to four digits."""
    # whole numbers up to the one division: the mean doesn't depend on the order of the items
    out = items.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.least(F.lit(100), F.length(text))).alias("c"), F.sum((F.length(text) < short).cast("long")).alias("f"))
    points = F.when(F.col("f") * 10 > F.col("n") * 3, F.col("c") * 8).otherwise(F.col("c") * 10)
    return out.select(*keys, "n", (F.floor(points * 10 / F.col("n")) / 10000).alias("confidence"))


def columns_by_gap(boxes: DataFrame, keys: list[str], x: str, gap: float) -> DataFrame:
    """Column numbers of boxes: a new column where x jumps by more than the gap."""
    w = Window.partitionBy(*keys).orderBy(x)
    jump = (F.col(x) - F.lag(x).over(w) > gap).cast("int")
    return boxes.withColumn("column", F.sum(F.coalesce(jump, F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))
